import json
from pathlib import Path

import pytest

from spanvec import api
from spanvec.__main__ import main
from spanvec.operators import search, verify
from spanvec.sources import packfile, tables


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, text string")


BASE = [(0, "hello"), (1, "paris is france")]


def test_pack(spark, tmp_path):
    d = f"{tmp_path}/p"
    m = api.build_pack(rows(spark, *BASE), d, lists=4, log=(said := []).append)
    assert m["n_vectors"] == 2 and m["shards"][0]["n_lists"] == 2 and json.loads(said[0])["ok"]
    p = api.open_pack(spark, d)
    best = p.search_text("hello", 2)
    assert best[0]["id"] == 0 and best[0]["text"] == "hello" and best[0]["score"] == pytest.approx(1, abs=1e-3)
    assert [r["id"] for r in p.search_text("paris is france", 1, probe=None)] == [1]
    vec = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, vector array<double>")
    with pytest.raises(Exception, match="must have 64 numbers"):
        p.search(vec).collect()
    assert p.export(f"{tmp_path}/x.pack")["n_vectors"] == 2 and packfile.verify_pack(f"{tmp_path}/x.pack", deep=True)
    assert api.inspect_pack(spark, d).first().id_max == 1 and api.verify_pack(d) == m
    private, public = verify.new_keys(spark)
    api.sign_manifest(spark, d, private)
    assert api.manifest_signed(spark, d, public)
    Path(d, "manifest.json").write_text(json.dumps(m | {"seed": 5}))
    assert not api.manifest_signed(spark, d, public)
    with pytest.raises(ValueError, match="exists"):
        api.build_pack(rows(spark, *BASE), d)
    with pytest.raises(ValueError, match="no vectors"):
        api.build_pack(rows(spark, *BASE).limit(0), f"{tmp_path}/none")
    next(Path(d, "meta").glob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="was changed"):
        api.verify_pack(d)


def test_shards_agree_with_one(spark, tmp_path):
    many = rows(spark, *((i, f"text {i}") for i in range(90)))
    api.build_pack(many, f"{tmp_path}/one", lists=1)
    m = api.build_pack(many, f"{tmp_path}/three", lists=4, shard_size=40)
    assert [s["n_vectors"] for s in m["shards"]] == [40, 40, 10]
    q = many.where("id % 50 = 0").selectExpr("id AS qid", "text")
    a, b = (api.open_pack(spark, f"{tmp_path}/{n}") for n in ("one", "three"))
    ids = lambda p, probe: sorted((r.qid, r.rn, r.id) for r in p.search(q, 5, probe).collect())
    assert ids(a, None) == ids(b, None) == ids(b, 4) == ids(a, 1)


def test_recall_is_that_of_the_hits(spark, tmp_path):
    many = rows(spark, *((i, f"text {i}") for i in range(400)))
    api.build_pack(many, f"{tmp_path}/p", lists=4, shard_size=250)
    p = api.open_pack(spark, f"{tmp_path}/p")
    q = p.queries(many.where("id % 20 = 0").selectExpr("id AS qid", "text")).cache()
    ids = lambda probe: {(r.qid, r.id) for r in p.hits(q, 5, probe).collect()}
    want = ids(None)
    got = {r.probe: r.recall for r in p.recall(q, 5).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == 1 and got[1] < 1
    assert all(abs(got[n] - len(ids(n) & want) / len(want)) < 1e-9 for n in (1, 2, 3))
    assert search.least_probe(p.recall(q, 5), 0.9) == min(n for n in got if got[n] >= 0.9)


def test_versions_on_disk(spark, tmp_path):
    s, t = f"{tmp_path}/set", str(tmp_path)
    api.build_packset_base(rows(spark, (0, "hello v0"), (1, "paris is france"), (2, "delete me")), s, lists=2)
    api.build_delta(s, rows(spark, (0, "hello v1"), (7, "delta add")), [], f"{t}/d1", lists=2)
    api.build_delta(s, rows(spark, (0, "hello v2")), [2], f"{t}/d2", lists=2)
    api.build_delta(s, None, [1], f"{t}/d3")
    for n in (1, 2, 3):
        assert len(api.promote_delta(s, f"{t}/d{n}")["deltas"]) == n
    got = {r["id"]: r["text"] for r in api.open_pack(spark, s).search_text("hello v2", 10)}
    assert got == {0: "hello v2", 7: "delta add"}
    assert [r.n_vectors for r in api.inspect_pack(spark, s).orderBy("seq").collect()] == [3, 2, 1, 0]
    api.rebase_packset(spark, s, f"{t}/new", lists=2)
    assert {r["id"]: r["text"] for r in api.open_pack(spark, f"{t}/new").search_text("hello v2", 10)} == got
    q = spark.createDataFrame([(0, "hello v2"), (1, "delta add")], "qid long, text string")
    assert api.run_canary(spark, s, f"{t}/new", q, 2, 0.5, 0.5)["passed"] and not api.run_canary(spark, s, f"{t}/new", q, 2, 1.01, 1.01)["passed"]
    assert [d["seq"] for d in api.revert_packset(s, 1)["deltas"]] == [1]
    assert {r["id"] for r in api.open_pack(spark, s).search_text("x", 10)} == {0, 1, 2, 7}
    with pytest.raises(ValueError, match="taken"):
        api.update_packset_manifest(s, "deltas/0001.delta", 1)
    api.build_packset_base(rows(spark, (9, "alt doc")), f"{t}/alt", lists=1)
    with pytest.raises(ValueError, match="another base"):
        api.promote_delta(f"{t}/alt", f"{t}/d1")
    assert len(api.create_packset(s, [f"{t}/d1", f"{t}/d2"], f"{t}/copy")["deltas"]) == 2
    f = next(Path(s, "base", "vectors").rglob("*.parquet"))
    f.write_bytes(f.read_bytes() + b"x")
    with pytest.raises(ValueError, match="Base hash mismatch"):
        api.open_packset(spark, s)


def test_published_layout(spark, tmp_path):
    many = rows(spark, *((i * 3, f"text {i}") for i in range(300)))
    m = api.build_pack(many, f"{tmp_path}/files", lists=4, shard_size=170, layout="files")
    assert [s["n_vectors"] for s in m["shards"]] == [170, 130] and m["n_lists"] == 4 and m["created"].endswith("Z")
    api.build_pack(many, f"{tmp_path}/tables", lists=4, shard_size=170)
    q = many.where("id % 50 = 0").selectExpr("id AS qid", "text")
    a, b = (api.open_pack(spark, f"{tmp_path}/{n}") for n in ("files", "tables"))
    ids = lambda p, probe: sorted((r.qid, r.rn, r.id, round(r.score, 9)) for r in p.search(q, 5, probe).collect())
    assert ids(a, None) == ids(a, 4) == ids(b, None) and ids(a, 1) == ids(b, 1) != ids(b, 4)
    assert json.loads(a.search_text("text 7", 1)[0]["meta"]) == {"id": 21, "text": "text 7"} and a.search_text("text 7", 1)[0]["shard"] == 0
    api.verify_pack(f"{tmp_path}/files", deep=True)
    i = api.inspect_pack(spark, f"{tmp_path}/files").orderBy("seq").collect()
    assert [(r.n_vectors, r.dim, r.magic) for r in i] == [(170, 64, packfile.MAGIC), (130, 64, packfile.MAGIC)] and i[0].bytes == (tmp_path / "files" / i[0].file).stat().st_size
    assert a.hits(a.queries(q.limit(1)), 5, 1).count() == 5
    odd = [r["id"] for r in b.search_text("text 7", 5, None, where="text LIKE '%1'")]
    assert len(odd) == 5 and all(x // 3 % 10 == 1 for x in odd)
    assert odd == [r["id"] for r in a.search_text("text 7", 5, 4, where="get_json_object(meta, '$.text') LIKE '%1'")]
    with pytest.raises(ValueError, match="exists"):
        api.build_pack(many, f"{tmp_path}/files", layout="files")
    # a folder without a manifest, and what isn't whole
    alone = tmp_path / "alone"
    alone.mkdir()
    data = (tmp_path / "files" / i[0].file).read_bytes()
    (alone / "pack.bin").write_bytes(data)
    with pytest.raises(ValueError, match="no manifest"):
        api.open_pack(spark, str(alone))
    (alone / "pack.meta.jsonl").write_text('{"id": 0, "text": "old"}\n{"id": 0, "text": "new"}\n')
    p = api.open_pack(spark, str(alone))
    assert p.vectors.count() == 170 and json.loads(p.search_text("text 0", 1)[0]["meta"])["text"] == "new"
    assert api.verify_pack(str(alone), deep=True) == {}
    (alone / "pack.bin").write_bytes(data[:-40])
    with pytest.raises(ValueError):
        api.verify_pack(str(alone))
    at, _ = next(o for o in packfile.read_offsets(f"{tmp_path}/files/{i[0].file}") if o[1])
    (alone / "pack.bin").write_bytes(data[:at] + b"\xff\xff\x00\x00" + data[at + 4 :])
    api.verify_pack(str(alone))
    with pytest.raises(ValueError, match="too short"):
        api.verify_pack(str(alone), deep=True)


def test_published_packset(spark, tmp_path):
    s, t = f"{tmp_path}/set", str(tmp_path)
    api.build_packset_base(rows(spark, (0, "hello v0"), (1, "paris is france"), (2, "delete me")), s, lists=1)
    api.build_delta(s, rows(spark, (0, "hello v1"), (7, "delta add")), [2], f"{t}/d1", lists=1)
    api.promote_delta(s, f"{t}/d1")
    api.verify_pack(s, deep=True)
    m = main(["publish", s, f"{t}/out"], spark)
    assert [d["seq"] for d in m["deltas"]] == [1] and set(m["base"]) == {"path", "file", "meta", "sha256_file", "sha256_meta"}
    got = [(r["id"], json.loads(r["meta"])["text"]) for r in api.open_pack(spark, f"{t}/out").search_text("hello v1", 10)]
    assert dict(got) == {0: "hello v1", 7: "delta add", 1: "paris is france"} and got[0][0] == 0
    api.verify_pack(f"{t}/out", deep=True)
    assert [(r.seq, r.n_vectors) for r in api.inspect_pack(spark, f"{t}/out").orderBy("seq").collect()] == [(0, 3), (1, 2)]
    q = spark.createDataFrame([(0, "hello v1")], "qid long, text string")
    assert api.run_canary(spark, s, f"{t}/out", q, 3)["avg_overlap"] == 1
    dead = tmp_path / "out" / m["deltas"][0]["tombstones"]
    dead.write_text('{"id": 1}\n')
    for f in (lambda: api.open_pack(spark, f"{t}/out"), lambda: api.verify_pack(f"{t}/out")):
        with pytest.raises(ValueError, match="Delta 1 tombstones hash mismatch"):
            f()
    assert api.open_packset(spark, f"{t}/out", verify=False).tombstones.first().id == 1


def test_a_dataset_agrees_with_itself_at_any_k(spark, tmp_path):
    api.build_pack(rows(spark, *((i, f"text {i}") for i in range(400))), f"{tmp_path}/p", lists=4)
    q = spark.createDataFrame([(0, "text 3"), (1, "what")], "qid long, text string")
    r = api.run_canary(spark, f"{tmp_path}/p", f"{tmp_path}/p", q, k=300)
    assert r["avg_overlap"] == r["min_overlap"] == 1 and r["passed"]
    p = api.open_pack(spark, f"{tmp_path}/p")
    summary = api.fidelity_report(p, p.queries(q), f"{tmp_path}/r", "own", k=10, probe=4)
    assert summary["passed"] and not summary["failures"]
    report = json.loads((tmp_path / "r" / "own_fidelity.json").read_text())
    assert [m["overlap"] for m in report["metrics"]] == [1, 1] and "all thresholds are met" in (tmp_path / "r" / "own_fidelity.md").read_text()
    assert not api.fidelity_report(p, p.queries(q), f"{tmp_path}/r", "one", k=40, probe=1)["passed"]


def test_other_sources(spark, tmp_path):
    wiki = spark.createDataFrame([("12", "T1", "u", "some text"), ("3", "T2", "u", " "), ("4", "T3", "u", "more")], "id string, title string, url string, text string")
    wiki.write.parquet(f"{tmp_path}/w")
    m = api.build_from_articles(spark, f"{tmp_path}/w", f"{tmp_path}/p", lists=1)
    assert m["n_vectors"] == 2 and api.open_pack(spark, f"{tmp_path}/p").search_text("more", 1)[0]["title"] == "T3"
    v = spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(10)], "id long, emb array<double>, other string")
    v.write.parquet(f"{tmp_path}/e")
    shards = tables.embedded_shards(spark, f"{tmp_path}/e", 4)
    assert sorted((r.id, r.shard) for r in shards.collect()) == [(i, i // 4) for i in range(10)]
    tables.write_embeddings(shards, f"{tmp_path}/dump")
    assert tables.embedded(spark, f"{tmp_path}/dump").count() == 10
    tables.write_csv(spark.createDataFrame([(1, 'a "b", c')], "id long, text string"), f"{tmp_path}/c.csv")
    assert tables.load(spark, f"{tmp_path}/c.csv").first().text == 'a "b", c'


def test_large_pack_loses_no_row(spark, tmp_path):
    v = spark.range(120_000).selectExpr("id * 7 % 120000 AS id", "CASE WHEN id % 3 = 0 THEN 2 ELSE id % 5 END AS list_id", "array(double(id), 1D) AS v")
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "list_id long, c array<double>")
    h = packfile.write_pack(v, c, f"{tmp_path}/x")
    assert h["n_vectors"] == 120_000 == packfile.verify_pack(f"{tmp_path}/x", deep=True)["n_vectors"]
    got = packfile.read_pack(spark, f"{tmp_path}/x")
    assert got.count() == got.select("id").distinct().count() == 120_000
    assert got.groupBy("list_id").count().exceptAll(v.groupBy("list_id").count()).count() == 0
    with pytest.raises(ValueError, match="no centroid for list 4"):
        packfile.write_pack(v, c.where("list_id < 4"), f"{tmp_path}/y")


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,text\n0,hello\n1,paris is france\n")
    assert main(["build", f"{tmp_path}/t.csv", f"{tmp_path}/p", "--lists", "4"], spark)["n_vectors"] == 2
    assert main(["search", f"{tmp_path}/p", "hello", "--k", "1"], spark)[0]["id"] == 0
    assert main(["verify", f"{tmp_path}/p"], spark) and main(["inspect", f"{tmp_path}/p"], spark) and main(["diagnose"], spark)
    assert main(["verify", f"{tmp_path}/p", "--deep"], spark)
    private, public = verify.new_keys(spark)
    (tmp_path / "k.pem").write_text(f"-----BEGIN PRIVATE KEY-----\n{private}\n-----END PRIVATE KEY-----\n")
    (tmp_path / "pub").write_text(public)
    (tmp_path / "other").write_text(verify.new_keys(spark)[1])
    main(["sign", f"{tmp_path}/p", f"{tmp_path}/k.pem", "--out", f"{tmp_path}/s.sig"], spark)
    assert main(["verify", f"{tmp_path}/p", "--pubkey", f"{tmp_path}/pub", "--sig", f"{tmp_path}/s.sig"], spark)
    with pytest.raises(ValueError, match="isn't signed"):
        main(["verify", f"{tmp_path}/p", "--pubkey", f"{tmp_path}/other", "--sig", f"{tmp_path}/s.sig"], spark)
    assert main(["build", f"{tmp_path}/t.csv", f"{tmp_path}/f", "--lists", "4", "--max-rows", "1", "--layout", "files"], spark)["n_vectors"] == 1
    (tmp_path / "q.jsonl").write_text('{"text": "hello"}\n')
    assert main(["fidelity", f"{tmp_path}/p", f"{tmp_path}/q.jsonl", f"{tmp_path}/r", "--k", "2"], spark)["passed"]
    main(["packset", "base", f"{tmp_path}/t.csv", f"{tmp_path}/s", "--lists", "1"], spark)
    main(["packset", "delta", f"{tmp_path}/s", f"{tmp_path}/t.csv", f"{tmp_path}/d", "--delete", "1", "--lists", "1"], spark)
    assert len(main(["packset", "promote-delta", f"{tmp_path}/s", f"{tmp_path}/d"], spark)["deltas"]) == 1
    assert main(["packset", "revert", f"{tmp_path}/s", "0"], spark)["deltas"] == []
