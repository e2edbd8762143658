import re
from collections import Counter

import numpy as np
import pytest

from spanvec.llm import doc_stats as ds
from spanvec.llm import quality_labels as ql
from spanvec.llm import quality_rules as qr
from spanvec.llm import toxicity as tx

SF = "/root/testdata/sf0.1"
ODD = [None, "", "  \n ", "one", "a b c d e f g h a b c d e f g h", "x\ny\nx\n\n \nx \n", "É#*$%&|<> 日本 \x85 \x1c", "w " * 30_000, "Ab " * 25]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def fixture(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "en", "s", 1, "clash") for i, t in enumerate(ODD)] + [(1, "", "en", "s", 1, "clash")], DOCS)


def brute(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def test_exact_statistics():
    texts = [(t or "").encode() for t in ODD]
    exact, x = ds.stats(texts)
    assert list(zip(*(exact[k].tolist() for k in ds.EXACT))) == [brute(t) for t in ODD]
    assert x.shape == (len(ODD), len(ds.FEATURES)) and np.isfinite(x).all()
    for i, t in enumerate(texts):  # a text's statistics don't depend on its neighbours
        assert np.allclose(ds.stats([t])[1][0], x[i])


def test_rules_keep_the_contract(spark):
    model = qr.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = qr.apply_rules(fixture(spark), model).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        want = brute(ODD[3 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept) and 0 <= r.score <= 1
        assert r.kept == (not r.base_failed and r.score >= 0.5)
    assert qr.apply_rules(fixture(spark).limit(0), model).count() == 0
    rows = qr.apply_rules(spark.read.parquet(f"{SF}/documents.parquet"), model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if qr.held_out(r.doc_id)]
    assert len(held) > 300 and np.mean([(r.score >= 0.5) == (r.quality > 0) for r in held]) > 0.95
    x = np.random.default_rng(1).uniform(0, 1, (400, len(ds.FEATURES)))
    for f in qr.FALLING:
        k, last = ds.FEATURES.index(f), None
        for v in np.linspace(0, 1, 25):
            x[:, k] = v
            s = model.raw(x)
            assert last is None or (s <= last + 1e-12).all()
            last = s


def test_rules_without_labels(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert qr.apply_rules(fixture(spark), qr.fit(fixture(spark), none)).count() == len(ODD) + 1


def test_votes_and_label_model(spark):
    v = ql.votes(ds.stats([(t or "").encode() for t in ODD])[1])
    assert (ql.unpattern(ql.pattern(v)) == v).all()
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.7
    acc = np.linspace(0.65, 0.95, len(ql.LABELLERS))
    right = r.random((len(y), len(acc))) < acc
    made = np.where(r.random(right.shape) < 0.2, 1, np.where(right == y[:, None], 2, 0))
    p, n = np.unique(ql.pattern(made), return_counts=True)
    m = ql.expectation_maximisation(ql.unpattern(p), n.astype(float))
    assert abs(m.prior - 0.7) < 0.03 and np.abs(m.accuracies() - acc).max() < 0.03
    assert np.mean((m.posterior(made) > 0.5) == y) > 0.95
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, scorer = ql.fit(docs)
    rows = ql.classify(docs, model, scorer).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    odd = ql.classify(fixture(spark), model, scorer).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r.score <= 1 and r.kept == bool(r.predicted) for r in odd)
    nothing = fixture(spark).limit(0)
    assert ql.classify(nothing, *ql.fit(nothing)).count() == 0


def test_expectation_maximisation_is_that_of_single_texts():
    r = np.random.default_rng(5)
    v = r.choice(3, (60, len(ql.LABELLERS)), p=[0.3, 0.2, 0.5])
    p, n = np.unique(ql.pattern(v), return_counts=True)
    m = ql.expectation_maximisation(ql.unpattern(p), n.astype(float), rounds=7)
    post = [min(max(0.5 + (sum(x == 2 for x in row) - 2 * sum(x == 0 for x in row)) / (2 * len(row)), 0.05), 0.95) for row in v.tolist()]
    for _ in range(7):
        prior = (sum(post) + 1) / (len(post) + 2)
        table = []
        for c in (0, 1):
            own = [q if c else 1 - q for q in post]
            each = [[sum(q for q, row in zip(own, v.tolist()) if row[k] == vote) + 0.5 for vote in range(3)] for k in range(v.shape[1])]
            table.append([[x / sum(e) for x in e] for e in each])
        post = []
        for row in v.tolist():
            good, bad = prior, 1 - prior
            for k, x in enumerate(row):
                good, bad = good * table[1][k][x], bad * table[0][k][x]
            post.append(good / (good + bad))
    assert abs(m.prior - prior) < 1e-12 and np.allclose(m.table, table, atol=1e-12) and np.allclose(m.posterior(v), post, atol=1e-9)


def test_scorer_is_the_mean_of_words_and_neighbours_change_no_bit():
    r = np.random.default_rng(6)
    scorer = ql.Scorer(r.standard_normal(1 << ql.BITS), -0.3)
    texts = [(t or "").encode() for t in ODD] + ["é b c d".encode()] * 3
    got = scorer.score(texts)
    for t, s in zip(texts, got):
        per_word = [scorer.weight[ql.hashed([w])[0][0]].sum() for w in t.translate(ds.WS).split()]
        assert s == pytest.approx(1 / (1 + np.exp(-(scorer.shift + (sum(per_word) / len(per_word) if per_word else 0)))), abs=1e-12)
    for k in range(len(texts)):
        assert scorer.score(texts[k:] + texts[:k])[0] == got[k] == scorer.score([texts[k]])[0]
    assert (ds.stats([b""] * 70_000 + [b"a a b"])[1][-1] == ds.stats([b"a a b"])[1][0]).all()


def test_forward_pass_step_by_step():
    r = np.random.default_rng(7)
    net = tx.Network(3)
    x, ids = r.standard_normal((30, tx.N_FEATURES)).astype(np.float32), r.integers(0, 30, (5, tx.WINDOW))
    p, H = {k: v.astype(np.float64) for k, v in net.p.items()}, tx.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    for row, got, same in zip(ids, net.logits(x, ids), net.steady(x, ids)):
        states = np.zeros((tx.WINDOW, 2 * H))
        for half, d in enumerate("fb"):
            h = np.zeros(H)
            for t in range(tx.WINDOW) if d == "f" else reversed(range(tx.WINDOW)):
                i, u = x[row[t]].astype(np.float64) @ p[f"x{d}"] + p[f"k{d}"], h @ p[f"u{d}"]
                z, g = sig(i[:H] + u[:H]), sig(i[H : 2 * H] + u[H : 2 * H])
                h = (1 - z) * np.tanh(i[2 * H :] + g * u[2 * H :]) + z * h
                states[t, half * H : (half + 1) * H] = h
        e = np.exp([(np.tanh(s @ p["a"]) @ p["v"])[0] for s in states])
        pooled = sum(a * s for a, s in zip(e / e.sum(), states))
        assert got == pytest.approx((pooled @ p["w"])[0] + p["c"][0], abs=1e-4) == same


def test_gradient():
    r = np.random.default_rng(0)
    net = tx.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = r.standard_normal((40, tx.N_FEATURES)), r.integers(0, 40, (6, tx.WINDOW))
    y, w = np.array([1, 0, 1, 0, 0, 1.0]), np.ones(6)

    def loss():
        q = 1 / (1 + np.exp(-net.logits(x, ids)))
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    g = net.gradient(x, ids, y, w)
    for k, v in net.p.items():
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in v.shape)
            old, e = v[at], 1e-3
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4, k


@pytest.fixture(scope="module")
def model(spark):
    return tx.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_toxicity_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = tx.score_toxicity(docs, model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == tx.held_out(r.doc_id) for r in rows) and all(r.predicted == (r.score >= 0.5) for r in rows)
    pos, neg = (np.array([r.score for r in held if r.toxic == k]) for k in (1, 0))
    assert len(pos) > 50 and (pos[:, None] > neg).mean() > 0.93
    assert (pos >= 0.5).mean() > 0.85 and (neg >= 0.5).mean() < 0.03


def test_toxicity_windows_and_odd_texts(spark, model):
    assert tx.windows(0).tolist() == tx.windows(5).tolist() == [0] and tx.windows(70).tolist() == [0, 16, 32, 38]
    got = tx.score_toxicity(fixture(spark), model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    plain = "that the of and in to " * 3000
    for where in (0, 9000, 17_990):
        w = plain.split()
        w[where : where + 3] = ["stupid", "idiot", "scum"]
        assert model.score([" ".join(w).encode()])[0] > 0.5 > model.score([plain.encode()])[0]
    texts = [(t or "").encode() for t in ODD]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts], atol=1e-5)
    words = "that the of and in to a stupid day was so good for all".split()
    r = np.random.default_rng(2)
    many = [" ".join(r.choice(words, r.integers(1, 400))).encode() for _ in range(40)]
    alone = [model.score([t])[0] for t in many]
    for k in (0, 1, 7):  # equal texts have equal scores, bit for bit, whatever stands beside them
        assert model.score(many[k:] + texts + many[:k])[: len(many) - k].tolist() == alone[k:]
    kept = tx.without_toxic(fixture(spark), model)
    assert kept.columns == fixture(spark).columns and kept.count() == sum(r.score < 0.5 for r in got)
    none = tx.fit(fixture(spark), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert len({r.score for r in tx.score_toxicity(fixture(spark), none).collect()}) == 1
