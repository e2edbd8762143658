import random
import re
import time

import pytest

from spanvec.llm import ngram_join as nj


def brute(rows, percent=60):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} - {()})
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    return sorted(((r[0], len(sets[i]), len(near[i]), least.get(comp[i])) for i, r in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "ß", "Of", "THE", "a\x00b", "x\x85y"]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    rows, i = [], 0
    for size, copies, edits in ((40, 60, 6), (80, 25, 20), (12, 20, 2), (300, 8, 70), (5, 10, 1)):
        base = text(size)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
            i += r.choice([1, 1, 1, 0])
    for _ in range(60):
        rows.append((i, " ".join(text(r.randint(1, 60)))))
        i += 1
    same = " ".join(text(30))
    rows += [(i + k, same) for k in range(40)] + [(i, same.upper())] * 2
    return rows + [(None, same), (None, "only null ids"), (None, None), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "two words")]


@pytest.mark.parametrize("seed,tile,block,edges", [(1, 7, 900, 10**6), (2, 2048, 4 << 20, 10**6), (3, 5, 300, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, tile, block, edges):
    for k, v in (("TILE", tile), ("BLOCK_BYTES", block), ("BUCKET_BYTES", 2 * block), ("POST_BYTES", 5 * block)):
        monkeypatch.setattr(nj, k, v)
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, h string, n int")
    assert sorted(map(tuple, nj.jaccard_links(d, driver_edges=edges).collect()), key=str) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (7, "x y"), (None, "x y"), (8, None), (None, None), (9, "p q r")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = nj.keep_one(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([1, 7, None, 8, None, 9], key=str)
    assert nj.jaccard_links(d.limit(0)).count() == 0 and nj.keep_one(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nj.jaccard_links(d, 0)


def test_unlike_texts_of_one_id_are_decided_by_row(spark):
    a, near, b, c = "a b c d e f g h", "a b c d e f g h i", "p q r s t u", "k l m n o"
    rows = [(1, a, "x"), (5, near, "x"), (5, b, "x"), (5, b, "x"), (5, c, "y"), (6, c, "y"), (6, "", "y"), (1, near, "z"), (7, None, "y"), (7, None, "y"), (8, b, "x")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, t string, comp int")
    got = nj.keep_one(d)
    assert got.schema == d.schema
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    kept_a = [x for x in got if x in ((1, a), (1, near))]
    assert len(kept_a) == 1
    assert sorted([x for x in got if x[0] != 1], key=str) == sorted([(5, b), (5, c), (6, ""), (7, None), (7, None)], key=str)


def test_a_third_of_all_rows_is_one_text(spark, monkeypatch):
    monkeypatch.setattr(nj, "max", lambda a, b: min(a, b) if a == 1000 else max(a, b), raising=False)
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(30))
    hot = text()
    rows = [(i, hot if i % 3 == 0 else text()) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in nj.jaccard_links(d).collect()}
    assert all((got[i].n_similar, got[i].component_id) == ((199, 0) if i % 3 == 0 else (0, i)) for i in range(600))
    assert {x.doc_id for x in nj.keep_one(d).collect()} == {0} | {i for i in range(600) if i % 3}


def test_blocks_widen_with_the_input(spark, monkeypatch):
    from spanvec.llm import common

    for k, v in (("BLOCK_BYTES", 300), ("BUCKET_BYTES", 600), ("POST_BYTES", 3000)):
        monkeypatch.setattr(nj, k, v)
    monkeypatch.setattr(common, "PARTS", 8, raising=False)
    made = []
    monkeypatch.setattr(nj, "parts_for", lambda *a: made.append(common.parts_for(*a)) or made[-1])
    rows = corpus(6)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nj.jaccard_links(d).collect()), key=str)
    size = sum(len((t or "").encode()) for _, t in rows)
    # a record for each block and bucket: a quarter of each, where there are many; lists and tiles have their old sizes
    assert size > 300 * 8 * 4 and made == [-(-size // x) for x in (1200, 2400, 3000, 150)]
    assert got == brute(rows)


def shuffled(spark):
    """Bytes of each file of a shuffle that there is now."""
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getPath(): f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}


def scattered(n):
    """Texts of 60 words, of which most shingles occur in two to a dozen of them by chance."""
    r = random.Random(11)
    return [(i, " ".join(f"{r.randrange(150):x}q{r.randrange(2)}" for _ in range(60))) for i in range(n)]


def test_chance_repeats_take_little_room(spark):
    rows = scattered(8000)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = shuffled(spark)
    links = nj._linked(d, nj.PERCENT)
    assert links.count() == 0
    new = sum(v for k, v in shuffled(spark).items() if k not in old)
    assert new < 4 * sum(len(t) for _, t in rows)


def test_shuffles_are_let_go_before_documents_are_joined(spark, monkeypatch):
    def aged(df, what, real=nj.materialise):
        """What was in use at a full collection is not freed by the small ones that follow."""
        table = real(df, what)
        if what == "links":
            spark.sparkContext._jvm.System.gc()
        return table

    monkeypatch.setattr(nj, "materialise", aged)
    d = spark.createDataFrame(scattered(4000), "doc_id long, text string").repartition(4)
    old = shuffled(spark)
    kept = nj.keep_one(d)
    for _ in range(40):
        left = sum(v for k, v in shuffled(spark).items() if k not in old)
        if left < 200_000:
            break
        time.sleep(0.5)
    assert left < 200_000 and kept.count() == 4000
