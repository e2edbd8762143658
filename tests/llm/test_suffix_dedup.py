import hashlib
import random

import pytest

from spanvec.llm import suffix_dedup as sd


def brute(rows, n):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - n + 1):
                w = t[p : p + n]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        if i is not None:
            for p in range(len(t) - n + 1):
                if first[t[p : p + n]] < i:
                    gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "an", "é", "or", "ß", "x"]) for _ in range(r.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared, rows = [text(30), text(12), "a" * 120, "ab" * 60], []
    for i in range(60):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 20)
            t += s[a : a + r.randint(30, 150)] + text(3)
        rows.append((r.choice([i, i, i, 7, -i]), t))
    near = rows[5][1] + shared[0]
    for i in range(100, 130):
        p = r.randint(0, len(near) - 1)
        rows.append((i, near[:p] + "!" + near[p + 1 :]))
    return rows + [(200, near)] * 3 + [(None, near), (None, shared[0]), (201, None), (202, ""), (203, "short")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(sd, "CHUNK", 400)
    monkeypatch.setattr(sd, "PIECE", 70)
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, block string")
    assert sorted(map(tuple, sd.repeated_spans(d).collect()), key=str) == brute(rows, 50)


def test_cut_texts_keep_their_columns(spark):
    rows = corpus(4)
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, block string")
    got = sd.remove_repeats(d)
    assert got.columns == d.columns and got.count() == len(rows)
    spans = {r.doc_id: r for r in sd.repeated_spans(d, spans=True).collect()}
    for r in got.collect():
        if r.doc_id in (200, 110, 203):
            t, s = dict(rows)[r.doc_id].encode(), spans[r.doc_id].spans
            assert r.text == sd._kept(t, [(x.start, x.stop) for x in s]).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert sd.repeated_spans(d.limit(0)).count() == 0


@pytest.mark.parametrize("length", [50, 16, 33])
def test_doubling_over_every_byte(spark, length):
    rows = corpus(5) + [(i, "hot passage of all of them, long enough to count as one " * 2) for i in range(300, 340)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    assert sorted(map(tuple, sd.doubling_spans(d, length).collect()), key=str) == brute(rows, length)
    assert sd.doubling_spans(d.limit(0)).count() == 0


def test_sql_is_brute_force():
    import duckdb

    rows = corpus(6)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(c.execute(sd.ORACLE["op5_suffix_dedup"]).fetchall(), key=str) == brute(rows, 50)


def test_blocks_widen_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 300)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 600)
    monkeypatch.setattr("spanvec.llm.common.PARTS", 8, raising=False)
    rows = corpus(7)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len((t or "").encode()) for _, t in rows)
    got = sd.repeated_spans(d)
    # a record for each block and bucket: a quarter of each, where there are many
    assert size > 300 * 8 * 4 and got.rdd.getNumPartitions() == -(-size // 1200)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 50)
