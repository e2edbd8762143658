import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanvec.llm import packing, suffix_dedup, toxicity

from .test_ngram_join import brute as links
from .test_scans import words

SF = "/root/testdata/sf0.001"


def cut(rows, n=suffix_dedup.LENGTH):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(i, first.get(b[p : p + n], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = True
        out.append((i, None if t is None else bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


def clean(rows, bench):
    grams = set()
    for b in bench:
        w = words(b)
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w = words(t)
        if not any(tuple(w[k : k + s]) in grams for s in sizes for k in range(len(w) - s + 1)):
            out.append((i, t))
    return out


def test_every_stage_is_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.orderBy("doc_id").collect()
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    top = max(r.doc_id for r in base)
    long = max(base, key=lambda r: len(r.text)).text
    extra = [(top + 1, long), (top + 2, long[:2000] + " zz " + long[2000:]), (top + 3, None), (top + 4, ""), (top + 5, "né wörds " * 20 + bench[0]), (top + 6, "you stupid idiot scum " * 9), (top + 7, base[0].text[:300] + " tail")]
    rows = [tuple(r) for r in base] + [(i, t, "en", "s", len(t or "")) for i, t in extra]
    d = tmp_path / "sf"
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"file://{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"file://{d}/{t}.parquet")
    sf = f"file://{d}"

    stages, now = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        f(spark, now, sf).write.parquet(f"file://{tmp_path}/{name}")
        stages[name] = now = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert name == "packing" or now.columns == docs.columns
    got = lambda name: sorted((r.doc_id, r.text) for r in stages[name].collect())
    key = lambda r: (r[0], r[1] or "")

    want = sorted([(r[0], r[1]) for r in rows], key=key)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    want = [(i, t) for i, t in want if model.score([(t or "").encode()])[0] < 0.5]
    assert sorted(got("toxicity"), key=key) == want and top + 6 not in dict(want) and top + 4 in dict(want)
    comp = {r[0]: r[3] for r in links(want)}
    want = [(i, t) for i, t in want if comp[i] == i]
    assert got("ngram_join") == want
    assert top + 1 not in dict(want) and top + 3 in dict(want)
    want = cut(want)
    assert got("suffix_dedup") == want
    n = {r.doc_id: r for r in stages["suffix_dedup"].collect()}
    changed = [i for i, t in want if t != {r[0]: r[1] for r in rows}[i]]
    assert changed and all(n[i].n_chars == len(n[i].text) for i in changed)
    want = clean(want, bench)
    assert got("decontamination") == want and top + 5 not in dict(want)
    tok, pieces = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), set()
    for i, t in want:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k in packing.lengths(len(ids)):
            pieces.add((i, at, k, zlib.crc32(ids[at : at + k].tobytes()), len(ids)))
            at += k
    last = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in last.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()} == pieces
    assert last.select(F.countDistinct("sequence_id")).first()[0] == len(pieces)
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0]) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "packing"]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for t, df in (("documents", docs.limit(0)), ("labels", spark.read.parquet(f"{SF}/labels.parquet").limit(0)), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet").limit(0))):
        df.write.parquet(f"file://{tmp_path}/sf/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/sf").count() == 0


def test_stages_that_compare_documents_widen_their_blocks(spark, monkeypatch):
    from spanvec.llm import common, ngram_join

    made = []
    monkeypatch.setattr(common, "PARTS", 8, raising=False)
    for m in (ngram_join, suffix_dedup):
        monkeypatch.setattr(m, "BLOCK_BYTES", 300)
        monkeypatch.setattr(m, "BUCKET_BYTES", 600)
        monkeypatch.setattr(m, "parts_for", lambda *a: made.append(common.parts_for(*a)) or made[-1])
    rows = [(i, " ".join(f"word{i * k % 97}x{i % 60}" for k in range(1, 13))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    comp = {r[0]: r[3] for r in links(rows)}
    assert sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SF).collect())) == [r for r in rows if comp[r[0]] == r[0]]
    assert sorted(map(tuple, corpus_pipeline.cut_repeats(spark, docs, SF).collect())) == cut(rows)
    assert size > 300 * 8 * 4 and made[:2] == made[-2:] == [-(-size // 1200), -(-size // 2400)]
