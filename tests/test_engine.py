import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanvec.functions import hashing, texts, vectors
from spanvec.operators import build, quality, registry, search, verify, versions
from spanvec.sources import packfile, storage, tables
from spanvec.streaming import ingest

HAND = [(0, 100, [1.0, 0.0, 0.0, 0.0]), (0, 101, [0.9, 0.1, 0.0, 0.0]), (1, 200, [0.0, 1.0, 0.0, 0.0])]
CENTROIDS = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])]


def hand(spark):
    v = spark.createDataFrame(HAND, "list_id long, id long, v array<double>").withColumn("shard", F.lit(0).cast("long"))
    return v, spark.createDataFrame(CENTROIDS, "list_id long, c array<double>")


def ask(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(rows)], "qid long, q array<double>")


def test_half_equals_numpy(spark):
    r = np.random.default_rng(0)
    x = np.concatenate((r.standard_normal(3000), r.standard_normal(500) * 1e-5, r.standard_normal(500) * 1e-7, r.standard_normal(200) * 3e4, [0.0, -0.0, 65504.0, 65519.9, 65520.0, -7e4, 2**-24, 2**-25, 2**-26, 6.1e-5]))
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(vectors.half(F.col("x"))).toPandas().iloc[:, 0]
    with np.errstate(over="ignore"):
        assert np.array_equal(got.to_numpy(), x.astype(np.float16).astype(np.float64))
    bits = spark.range(65536).select("id", vectors.half_bits(F.col("id")).alias("v")).toPandas().sort_values("id").v.to_numpy()
    assert np.array_equal(bits, np.arange(65536, dtype=np.uint16).view(np.float16).astype(np.float64), equal_nan=True)


def test_normalize_refuses_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "a array<double>")
    with pytest.raises(Exception, match="zero vector"):
        df.select(vectors.normalize(F.col("a"))).collect()


def test_generator(spark):
    start, dim = 123456789, 24
    h, want = start, []
    for _ in range(dim):
        h = (h * 1664525 + 1013904223) % 2**32
        want.append(h / (2**32 - 1) - 0.5)
    want = np.array(want) / np.linalg.norm(want)
    assert np.allclose(spark.range(1).select(hashing.lcg_vector(F.lit(start).cast("long"), dim)).first()[0], want)


def test_hand_made_search(spark):
    v, c = hand(spark)
    q = ask(spark, [1, 0, 0, 0])
    got = search.ivf_topk(v, c, q, 3, 2).orderBy("rn").collect()
    assert [r.id for r in got] == [100, 101, 200] and [r.score for r in got] == pytest.approx([1.0, 0.9, 0.0])
    assert [r.id for r in search.ivf_topk(v, c, q, 3, 1).orderBy("rn").collect()] == [100, 101]
    assert [r.id for r in search.ivf_topk(v, c, q, 3, 2, max_scan=1).orderBy("rn").collect()] == [100, 200]
    assert search.exact_topk(v.limit(0), q, 3).count() == 0 and search.exact_topk(v, q.limit(0), 3).count() == 0
    assert search.presets(1024) == {"fast": 32, "balanced": 128, "safe": 193, "default": 193} and search.presets(1)["default"] == 1
    assert search.check_k(1000) == 1000
    for k, cap in ((0, None), (300, 256)):
        with pytest.raises(ValueError):
            search.check_k(k, cap)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 12), st.integers(1, 60), st.booleans())
def test_best_keeps_ties(seed, k, n, coarse):
    r = np.random.default_rng(seed)
    s = r.standard_normal((3, n)).round(0 if coarse else 6)
    ids = r.permutation(n)
    row, col = search._best(s, ids, k)
    for i in range(3):
        mine = sorted(((-s[i, c], ids[c]) for c in col[row == i]))[:k]
        assert mine == sorted((-s[i, c], ids[c]) for c in range(n))[:k]


def test_blocks_and_large_lists(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 5))
    v = spark.createDataFrame([(i % 4, i, i % 3, row.tolist()) for i, row in enumerate(x)], "list_id long, id long, shard long, v array<double>").repartition(2).cache()
    q = ask(spark, *x[:23])
    want = {(i, int(j)) for i in range(23) for j in np.lexsort((np.arange(300), np.arange(300) % 3, -(x @ x[i])))[:4]}
    cen = search.lists_of(build.centroids_of(v)).df
    per_shard = search.lists_of(v.select("shard", "list_id").distinct().join(cen, "list_id")).df
    ids = lambda df: {(h.qid, h.id) for h in df.collect()}
    rows = lambda df: sorted(map(tuple, df.select("qid", "rn", "shard", "id").collect()))
    probes = lambda c, n: sorted(map(tuple, search.coarse(q, c, n).collect()))
    near = rows(search.ivf_topk(v, cen, q, 4, 2))
    few, clamped, by_shard = probes(cen, 2), probes(cen, 9000), probes(per_shard, 3)
    assert len(clamped) == 23 * 4 and len(probes(cen, 0)) == 23 and len(by_shard) == 23 * 9
    scan = rows(search.ivf_topk(v, cen, q, 4, 3, max_scan=7))
    for broadcast in (True, False):  # the sizes that are checked decide how, never what
        if not broadcast:
            for name, value in (("QUERY_BYTES", 0), ("CENTROID_BYTES", 0), ("FEW", 5), ("TILE_ROWS", 40), ("TILE_QUERIES", 7), ("SCORES", 100), ("HELD", 50), ("NAMED_LISTS", 1)):
                monkeypatch.setattr(search, name, value)
        assert ids(search.exact_topk(v, q, 4)) == want == ids(search.ivf_topk(v, cen, q, 4, 4)) == ids(search.ivf_topk(v, per_shard, q, 4, 99))
        assert rows(search.ivf_topk(v, cen, q, 4, 2)) == near and near != rows(search.exact_topk(v, q, 4))
        assert (probes(cen, 2), probes(cen, 9000), probes(per_shard, 3)) == (few, clamped, by_shard)
        assert rows(search.ivf_topk(v, cen, q, 4, 3, max_scan=7)) == scan
        assert search.scan_topk(v, q, 400).count() == 23 * 300 and search.exact_topk(v, q, 300).count() == 23 * 300
    monkeypatch.setattr(search, "QUERY_BYTES", 1 << 20)
    assert rows(search.ivf_topk(v, cen, q, 4, 2)) == near  # a broadcast join where the filter would name too many lists


def test_an_index_reads_the_probed_lists_alone(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 4))
    v = spark.createDataFrame([(0, i % 8, i, row.tolist()) for i, row in enumerate(x)], "shard long, list_id long, id long, v array<double>")
    build.write_layout(v, f"{tmp_path}/l")
    on_disk = spark.read.parquet(f"{tmp_path}/l")
    plan = search.ivf_topk(on_disk, build.centroids_of(v), ask(spark, x[3]), 5, 1)._jdf.queryExecution().toString()
    physical = plan[plan.index("Physical Plan") :]
    assert "PartitionFilters: [" in physical and "list_id" in physical[physical.index("PartitionFilters") :].split("]")[0]
    assert physical.count("Exchange hashpartitioning") == 1 and "hashpartitioning(qid" in physical  # k rows a query and task, no vector


def test_assign_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    x, c = r.standard_normal((200, 3)), r.standard_normal((30, 3))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    cen = spark.createDataFrame([(i * 3, row.tolist()) for i, row in enumerate(c)], "list_id long, c array<double>")
    want = [(i, 3 * int(((c - x[i]) ** 2).sum(axis=1).argmin())) for i in range(200)]
    got = lambda: sorted((r.id, r.list_id) for r in build.assign(v, cen).collect())
    assert got() == want
    monkeypatch.setattr(search, "CENTROID_BYTES", 7 * 32)
    assert got() == want
    with pytest.raises(ValueError, match="no centroids"):
        build.assign(v, cen.limit(0))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_lose_no_row(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for n, parts in ((1_000_000, 1), (1_000_000, 64), (300_000, 7)):
            df = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("k")).repartition(parts)
            got = tables.numbered(df, ["k"], start=5)
            r = got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
            assert tuple(r) == (n, n, 5, n + 4)
            a, b = got.alias("a"), got.alias("b")
            assert a.join(b, F.col("a.id") + 1 == F.col("b.id")).where("a.k >= b.k").count() == 0
        same = tables.numbered(spark.range(1000).selectExpr("1 AS k"), ["k"])
        assert sorted(r.id for r in same.collect()) == list(range(1000)) and tables.numbered(spark.range(0), ["id"], "at").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def tier(spark, rows):
    return spark.createDataFrame([(s, 0, i, v) for s, i, v in rows], "seq long, shard long, id long, v array<double>")


def test_tiers(spark):
    base = [(0, 0, [1.0, 0.0]), (0, 1, [0.9, 0.1]), (0, 2, [0.0, 1.0]), (0, 3, [0.8, 0.2])]
    t = tier(spark, base + [(1, 0, [0.1, 0.9]), (2, 0, [0.2, 0.8]), (2, 2, [0.0, 1.0])])
    dead = spark.createDataFrame([(2,)], "id long")
    q = ask(spark, [1, 0])
    got = [(r.seq, r.id) for r in versions.tiered_hits(t, dead, q, 10).orderBy("rn").collect()]
    assert got == [(2, 0), (0, 1), (0, 3)]
    assert [(r.seq, r.id) for r in versions.tiered_hits(versions.revert(t, 1), dead, q, 10, strict=True).orderBy("rn").collect()] == [(1, 0), (0, 1), (0, 3)]
    assert versions.next_seq(t).first()[0] == 3 and versions.next_seq(tier(spark, base)).first()[0] == 1
    assert {(r.id, tuple(r.v)) for r in versions.rebase(t, dead).collect()} == {(0, (0.2, 0.8)), (1, (0.9, 0.1)), (3, (0.8, 0.2))}


def test_strict_finds_k_where_there_are_k(spark):
    rows = [(0, i, [1.0 - i / 100, 0.0]) for i in range(40)] + [(1, i, [-1.0, 0.0]) for i in range(30)]
    dead = spark.createDataFrame([(i,) for i in range(30, 35)], "id long")
    got = [(r.seq, r.id) for r in versions.tiered_hits(tier(spark, rows), dead, ask(spark, [1, 0]), 35, strict=True).orderBy("rn").collect()]
    assert got == [(1, i) for i in range(30)] + [(0, i) for i in range(35, 40)]


def test_metrics_match_definitions(spark):
    cases = [([1, 2, 3, 4], [2, 1, 4, 9]), ([1, 2], []), ([], []), ([5], [5]), ([1, 2, 3], [3, 2, 1])]
    hits = lambda k: spark.createDataFrame([(i, r + 1, x) for i, c in enumerate(cases) for r, x in enumerate(c[k])], "qid long, rn long, id long")
    got = {r.qid: r for r in quality.compare(hits(0), hits(1), spark.range(len(cases)).toDF("qid"), 4).collect()}
    for i, (a, b) in enumerate(cases):
        m = [x for x in a if x in b]
        pairs = [(p, q) for p in range(len(m)) for q in range(p + 1, len(m))]
        tau = sum(math.copysign(1, b.index(m[q]) - b.index(m[p])) for p, q in pairs) / len(pairs) if len(m) > 1 else 1.0
        assert got[i].overlap == pytest.approx(len(m) / 4) and got[i].tau == pytest.approx(tau)
        assert got[i].jaccard == pytest.approx(len(m) / len({*a, *b}) if a or b else 1.0)
    with pytest.raises(Exception, match="canary needs queries"):
        quality.canary(hits(0), hits(1), spark.range(0).toDF("qid"), 4).collect()


def test_pack_round_trip(spark, tmp_path):
    v, c = hand(spark)
    c = c.union(spark.createDataFrame([(2, [0.0, 0.0, 1.0, 0.0])], c.schema))
    p = str(tmp_path / "a.pack")
    info = packfile.write_pack(v, c, p)
    got = sorted((r.list_id, r.id, r.v) for r in packfile.read_pack(spark, p).collect())
    assert got == [(a, b, np.array(x, np.float16).astype(float).tolist()) for a, b, x in HAND]
    assert [r.id for r in packfile.read_pack(spark, p, [1]).collect()] == [200] and packfile.read_pack(spark, p, []).count() == 0
    assert packfile.verify_pack(p, deep=True)["n_vectors"] == 3 and packfile.read_centroids(p)[1].tolist() == [0, 1, 0, 0]
    counts = build.list_counts(v, 3)
    assert [(r.offset, r.length) for r in build.offsets(counts, 4, 3).orderBy("list_id").collect() if r.n] == [o for o in packfile.read_offsets(p) if o[1]]
    assert info["offset_table_pos"] + 48 == (tmp_path / "a.pack").stat().st_size
    data = (tmp_path / "a.pack").read_bytes()
    for name, bad in (("magic", b"\0" * 8 + data[8:]), ("short", data[:32]), ("table", data[:36] + b"\0" * 8 + data[44:]), ("cut", data[:64])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(ValueError):
            packfile.verify_pack(str(tmp_path / name))
    at = packfile.read_offsets(p)[0][0]
    (tmp_path / "count").write_bytes(data[:at] + struct.pack("<I", 999) + data[at + 4 :])
    assert len(packfile.read_list(str(tmp_path / "count"), at, 36, 4)[0]) == 0
    with pytest.raises(ValueError):
        packfile.verify_pack(str(tmp_path / "count"), deep=True)
    assert packfile.offsets_table(spark, p).count() == 3


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 1000), st.integers(-5, 1000), st.integers(-5, 1000))
def test_offset_rule(size, offset, length):
    bad = offset < 0 or length < 0 or (length != 0 and offset + length > size)
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    assert bad == bool(s.range(1).select(verify.bad_entry(F.lit(size), F.lit(offset), F.lit(length))).first()[0])


def test_digests_and_signatures(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"hello")
    import hashlib

    good = hashlib.sha256(b"hello").hexdigest()
    rows = spark.createDataFrame([(f"{tmp_path}/f", good), (f"{tmp_path}/f", "0"), (f"{tmp_path}/gone", good)], "path string, sha256 string")
    assert {(r.path.rsplit("/", 1)[1], r.sha256 == good) for r in verify.digest_mismatches(spark, rows).collect()} == {("f", False), ("gone", True)}
    private, public = verify.new_keys(spark)
    s = verify.sign(spark, b"manifest", private)
    assert verify.signed_by(spark, b"manifest", s, public) and not verify.signed_by(spark, b"other", s, public)
    assert verify.diagnose(spark)["spark"]


def test_shared_folders_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(storage, "_MADE", [])
    monkeypatch.setattr(storage, "_ROOTS", [])
    t = storage.materialise(spark.range(9), "x")
    (path,) = storage._MADE
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and t.count() == 9
    with monkeypatch.context() as m:
        m.setattr(storage, "_OWNER", -1)
        storage.release()
        assert storage.exists(path)
    storage.release()
    assert not storage.exists(path) and not storage._MADE


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "local-cluster[3,2,1024]"

    monkeypatch.setattr(storage, "_MADE", [])
    monkeypatch.setattr(storage, "_ROOTS", [])
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session, "x")
    Session.sparkContext.master = "local[2]"
    a, b = storage.shared_dir(Session, "x"), storage.shared_dir(Session, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] and storage.exists(a.rsplit("/", 1)[0])
    storage.release()
    assert not storage.exists(a.rsplit("/", 1)[0])


def test_storage(spark, tmp_path):
    storage.write_bytes(f"{tmp_path}/a/b.txt", b"one")
    storage.write_bytes(f"{tmp_path}/a/b.txt", b"two")
    (tmp_path / "a" / "_SUCCESS").write_text("")
    want = [("b.txt", 3)]
    assert storage.files(f"{tmp_path}/a") == want and storage.names(f"file://{tmp_path}/a", ".txt") == ["b.txt"] and storage.names(f"{tmp_path}/none") == []
    assert storage.read_bytes(storage.qualified(spark, f"{tmp_path}/a/b.txt")) == b"two"
    one = storage.folder_digest(f"{tmp_path}/a")
    storage.copy(f"{tmp_path}/a", f"{tmp_path}/c")
    assert storage.folder_digest(f"file:{tmp_path}/c") == one
    limit, storage.DRIVER_BYTES = storage.DRIVER_BYTES, 0
    try:
        assert storage.folder_digest(f"{tmp_path}/c") == one  # in tasks
    finally:
        storage.DRIVER_BYTES = limit
    storage.delete(f"{tmp_path}/c")
    assert not storage.exists(f"{tmp_path}/c")


def test_other_file_systems_go_through_hadoop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "local", lambda path: None)
    root = f"file://{tmp_path}"
    storage.write_bytes(f"{root}/a/b.txt", b"one")
    storage.write_bytes(f"{root}/a/b.txt", b"two")
    assert storage.read_bytes(f"{root}/a/b.txt") == b"two" and storage.files(f"{root}/a") == [("b.txt", 3)] and "b.txt" in storage.names(f"{root}/a")
    storage.copy(f"{root}/a", f"{root}/c")
    assert storage.exists(f"{root}/c/b.txt")
    monkeypatch.setattr(storage, "_from_uri", lambda uri: uri)  # a bucket is looked up over the network
    assert storage.arrow("s3a://bucket/x") == "s3://bucket/x" and storage.arrow("hdfs://host/x") == "hdfs://host/x"
    storage.delete(f"{root}/c")
    assert not storage.exists(f"{root}/c")


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,text\n0,hello\n1,paris is france\n")
    df = tables.load(spark, f"{tmp_path}/t.csv")
    assert [(r.id, r.text) for r in df.orderBy("id").collect()] == [(0, "hello"), (1, "paris is france")]
    with pytest.raises(ValueError, match="no column"):
        tables.need_columns(df, "body")
    with pytest.raises(ValueError):
        tables.load(spark, "x.txt")
    with pytest.raises(ValueError):
        tables.first_rows(df, 0, "id")
    with pytest.raises(Exception, match="whole numbers"):
        tables.with_ids(spark.createDataFrame([(-1,)], "k long"), "k", []).collect()
    assert sorted(r.at for r in tables.numbered(spark.range(1000).repartition(7), ["id"], "at").where("at = id").collect()) == list(range(1000))
    (tmp_path / "m.jsonl").write_text('{"id": 1, "a": "x"}\n\n{"a": "no id"}\n{"id": 1, "a": "y"}\n')
    assert [(r.id, json.loads(r.meta)["a"]) for r in tables.read_metadata(spark, f"{tmp_path}/m.jsonl").collect()] == [(1, "y")]
    assert tables.read_tombstones(spark, f"{tmp_path}/none").count() == 0
    tables.write_tombstones(spark.createDataFrame([(3,), (1,), (3,)], "id long"), f"{tmp_path}/dead")
    assert sorted(r.id for r in tables.read_tombstones(spark, f"{tmp_path}/dead").collect()) == [1, 3]
    (tmp_path / "q.jsonl").write_text('{"text": "hello"}\n{"other": 1}\n{"vector": [1, 2]}\n')
    assert [(r.text, r.vector) for r in tables.read_queries(spark, f"{tmp_path}/q.jsonl").orderBy("qid").collect()] == [("hello", None), (None, [1.0, 2.0])]
    (tmp_path / "p").mkdir()
    with pytest.raises(ValueError):
        tables.manifest(str(tmp_path / "p"))
    tables.write_manifest(f"{tmp_path}/p/x.manifest.json", {"schema_version": 2, "shards": [{"name": "s", "file": "a", "meta": "m"}]})
    assert tables.manifest_shards(spark, tables.manifest(str(tmp_path / "p"))).first().file == "a"
    meta = tables.metadata(df, "text", snippets=True)
    tables.write_metadata(meta, f"{tmp_path}/meta")
    assert tables.read_metadata(spark, f"{tmp_path}/meta").count() == 2


def test_texts(spark):
    r = spark.createDataFrame([("a  b\n\tc", None, "<&\"'>", "1, 2.5\n-3e1")], "a string, n string, h string, v string")
    got = r.select(texts.one_line(F.col("a")), texts.stringify(F.col("n")), texts.escape_html(F.col("h")), texts.parse_vector(F.col("v")), texts.title(F.col("n"), F.lit(""), F.lit(7))).first()
    assert tuple(got) == ("a b c", "None", "&lt;&amp;&quot;&#39;&gt;", [1.0, 2.5, -30.0], "(id=7)")
    with pytest.raises(Exception):
        r.select(texts.parse_vector(F.col("a"))).collect()


def test_registry(spark):
    c = registry.empty(spark)
    c["orgs"] = registry.insert(c["orgs"], spark.createDataFrame([(1, "o")], registry.SCHEMAS["orgs"]), ["name"])
    with pytest.raises(Exception, match="409"):
        registry.insert(c["orgs"], spark.createDataFrame([(2, "o")], registry.SCHEMAS["orgs"]), ["name"]).collect()
    twice = spark.createDataFrame([(3, "p"), (4, "p"), (5, "q")], registry.SCHEMAS["orgs"])
    with pytest.raises(Exception, match="409"):
        registry.insert(c["orgs"], twice, ["name"]).collect()
    assert registry.insert(c["orgs"], twice.where("org_id > 3"), ["name"]).count() == 3
    assert registry.log(c, "me", "create", "o", 1.0)["audit"].count() == 1
    assert bytes(spark.range(1).select(registry.byte_range(F.lit(b"abcdef"), 1, 3)).first()[0]) == b"bcd"
    with pytest.raises(ValueError):
        registry.byte_range(F.lit(b""), 3, 1)


def test_layout_and_training(spark, tmp_path):
    v, _ = hand(spark)
    build.write_layout(v, f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").where("list_id = 1").first().id == 200
    with pytest.raises(ValueError):
        build.effective_lists(4, 0)
    assert build.effective_lists(4, 2) == 2 and build.shard_lists(100, 390) == 10
    c = build.train(v, 2, seed=3)
    assert build.assign(v, c).select("list_id").distinct().count() == 2


def test_clusters_are_about_as_tight_as_lloyds(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.standard_normal((150, 4)) * 0.2 + m for m in r.standard_normal((6, 4)) * 3])
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    c = build.train(v, 6, seed=7)
    cen = {row.list_id: np.array(row.c) for row in c.collect()}
    inertia = sum(((x[row.id] - cen[row.list_id]) ** 2).sum() for row in build.assign(v, c).select("id", "list_id").collect())

    def lloyd(seed):
        m = x[np.random.default_rng(seed).choice(len(x), 6, replace=False)]
        for _ in range(20):
            d = ((x[:, None] - m) ** 2).sum(axis=2)
            m = np.stack([x[d.argmin(axis=1) == k].mean(axis=0) if (d.argmin(axis=1) == k).any() else m[k] for k in range(6)])
        return ((x[:, None] - m) ** 2).sum(axis=2).min(axis=1).sum()

    runs = [lloyd(s) for s in range(10)]
    assert inertia <= max(runs) * 1.001 and inertia < ((x - x.mean(axis=0)) ** 2).sum() / 3


def test_stream_becomes_deltas(spark, tmp_path):
    rows = [(0, 5, [0.0, 1.0], False), (0, 1, [0.0, 0.0], True)]
    spark.createDataFrame(rows, "shard long, id long, v array<double>, deleted boolean").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("shard long, id long, v array<double>, deleted boolean").json(f"{tmp_path}/in")
    ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    base = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.5, 0.5])], "shard long, id long, v array<double>")
    t, dead = ingest.tiers(base, f"{tmp_path}/out")
    assert sorted((r.seq, r.id) for r in versions.tiered_hits(t, dead, ask(spark, [1, 0]), 5).collect()) == [(0, 2), (1, 5)]
