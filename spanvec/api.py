"""Datasets on disk: build, open, search, version, verify.

A pack is a folder: vectors by shard and list, centroids, metadata (all Parquet) and manifest.json with counts and a
SHA-256 of each part. A packset is a folder with a base pack, numbered delta packs and a root manifest; deltas hold added
and changed rows and tombstones. Manifests are written aside and renamed, so a reader sees the old or the new one.

The published layout is read and written too: a binary file and a file of JSON lines for each shard, under a manifest or,
for a single shard, under the names pack.*; a packset is such a base with such deltas, tombstones and digests of the files.
Paths may be of any file system that Spark reaches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hash_embedding
from .functions.texts import stringify
from .functions.vectors import doubles, half_vector, normalize
from .operators import build as b
from .operators import quality, search, verify, versions
from .sources import packfile, storage, tables
from .sources.storage import folder_digest

DIM = 64
Embedder = Callable[[Column], Column]


@contextmanager
def timed(event: str, detail: dict, sink: Callable[[str], None] | None = None):
    """Tells sink one JSON line when the block ends, well or not."""
    began, ok = time.time(), False
    try:
        yield
        ok = True
    finally:
        if sink:
            sink(json.dumps({"event": event, "seconds": round(time.time() - began, 3), "ok": ok, **detail}))


def embedder(dim: int = DIM, seed: int = 0) -> Embedder:
    """Hash vectors: equal texts meet, when building and when asking. Any function from a text column to array<double> does instead, such as a pandas_udf around a model."""
    return lambda text: hash_embedding(text, dim, seed)


def build_pack(
    rows: DataFrame, out: str, text_col: str = "text", id_col: str | None = "id", vector_col: str | None = None, lists: int = 1024, seed: int = 0,
    embed: Embedder | None = None, shard_size: int = 0, max_rows: int | None = None, meta_cols: list[str] | None = None, log: Callable[[str], None] | None = None,
    layout: str = "tables",
) -> dict:
    """Embeds rows, clusters each shard and writes the pack; returns its manifest.

    vector_col takes ready vectors instead of texts. shard_size makes shards of so many consecutive ids' positions, each
    with its own lists. No row is cut off unless max_rows says so. layout "files" writes the published layout.
    """
    if layout not in ("tables", "files"):
        raise ValueError("layout is tables or files")
    if layout == "files":
        if storage.exists(out):
            raise ValueError(f"{out} exists")
        own = storage.shared_dir(rows.sparkSession, "pack")
        build_pack(rows, own, text_col, id_col, vector_col, lists, seed, embed, shard_size, max_rows, meta_cols, log)
        m = Pack(rows.sparkSession, own, embed).publish(out)
        storage.delete(own)
        return m
    with timed("build_pack", {"out": out}, log):
        tables.need_columns(rows, vector_col or text_col)
        if max_rows is not None:
            rows = tables.first_rows(rows, max_rows, id_col or text_col)
        rows = tables.with_ids(rows, id_col, [c for c in rows.columns if c != vector_col])
        if storage.exists(out):
            raise ValueError(f"{out} exists")
        vec = doubles(F.col(vector_col)) if vector_col else (embed or embedder(seed=seed))(stringify(F.col(text_col)))
        if shard_size > 0:
            rows = tables.ranges(tables.numbered(rows, ["id"], "__at"), shard_size, "__at").drop("__at", "shard_name")
        else:
            rows = rows.withColumn("shard", F.lit(0).cast("long"))
        rows.select("shard", "id", normalize(vec).alias("v")).write.parquet(f"{out}/.embedded")
        spark, shards = rows.sparkSession, []
        flat = spark.read.parquet(f"{out}/.embedded")
        meta = tables.metadata(rows.drop(*([vector_col] if vector_col else [])).drop("shard"), text_col, meta_cols, text=text_col in rows.columns)
        meta.write.parquet(f"{out}/meta")
        # clustering is by shard; their number is the build's choice, not the data's
        for s in b.shard_stats(flat).orderBy("shard").collect():
            own = flat.where(F.col("shard") == s.shard)
            n = b.effective_lists(lists, s.n_vectors)
            if shard_size > 0:
                n = b.shard_lists(n, s.n_vectors)
            cen = search.lists_of(b.train(own, n, seed))
            cen.df.withColumn("shard", F.lit(s.shard).cast("long")).write.mode("append").parquet(f"{out}/centroids")
            stored = b.assign(own, cen).withColumn("v", half_vector(F.col("v")))
            stored.repartition("list_id", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("list_id", "id").write.mode("append").partitionBy("shard", "list_id").parquet(f"{out}/vectors")
            shards.append({"name": f"pack.shard{s.shard:03d}", "shard": s.shard, "n_vectors": s.n_vectors, "n_lists": n, "id_min": s.id_min, "id_max": s.id_max})
        storage.delete(f"{out}/.embedded")
        if not shards:
            raise ValueError("there are no vectors")
        dim = spark.read.parquet(f"{out}/centroids").select(F.size("c")).first()[0]
        m = {"schema_version": 2, "created": tables.now_iso(), "dim": dim, "metric": "dot", "seed": seed, "n_vectors": sum(s["n_vectors"] for s in shards), "n_lists": max(s["n_lists"] for s in shards), "shards": shards}
        m["sha256"] = {k: folder_digest(f"{out}/{k}") for k in ("vectors", "centroids", "meta")}
        tables.write_manifest(f"{out}/manifest.json", m)
        return m


class Pack:
    """An opened pack: .vectors (shard, list_id, id, v), .centroids (shard, list_id, c), .meta (id, ...) and a manifest that has dim and shards."""

    meta_keys: tuple[str, ...] = ("id",)

    def __init__(self, spark: SparkSession, folder: str, embed: Embedder | None = None):
        self.spark, self.folder, self.manifest = spark, folder, tables.manifest(folder)
        self._embed_by(embed)
        self.vectors = spark.read.parquet(f"{folder}/vectors").select(F.col("shard").cast("long").alias("shard"), F.col("list_id").cast("long").alias("list_id"), "id", "v")
        self.centroids = spark.read.parquet(f"{folder}/centroids").select(F.col("shard").cast("long").alias("shard"), "list_id", "c")
        self.meta = spark.read.parquet(f"{folder}/meta")

    def _embed_by(self, embed: Embedder | None) -> None:
        self.dim = self.manifest["dim"]
        self.embed = embed or embedder(self.dim, self.manifest.get("seed", 0))

    def queries(self, texts: DataFrame) -> DataFrame:
        """(qid, q) of (qid, text) or (qid, vector), where vectors have the pack's length and are normalised."""
        if "vector" in texts.columns:
            v = F.when(F.size("vector") == self.dim, doubles(F.col("vector"))).otherwise(F.raise_error(F.lit(f"vectors must have {self.dim} numbers")).cast("array<double>"))
            return texts.select(F.col("qid").cast("long").alias("qid"), normalize(v).alias("q"))
        return texts.select(F.col("qid").cast("long").alias("qid"), self.embed(F.col("text")).alias("q"))

    def hits(self, queries: DataFrame, k: int = 10, probe: int | None = 8, max_scan: int = 0, where: str | Column | None = None) -> DataFrame:
        """qid, shard, id, score, rn. probe lists of each shard are read, None reads everything. where is a condition on the metadata, which is met before the k best are taken."""
        k = search.check_k(k)
        vectors = self.vectors if where is None else search.where_meta(self.vectors, self.meta, where, self.meta_keys).select(*self.vectors.columns)
        if probe is None:
            return search.exact_topk(vectors, queries, k)
        return search.ivf_topk(vectors, self.centroids, queries, k, probe, max_scan)

    def recall(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """probe, recall: the share of the exact best that hits() finds by the number of lists probed in each shard. search.least_probe() chooses from it."""
        q = search.asked(queries)
        every = max(s["n_lists"] for s in self.manifest["shards"])
        return search.probe_recall(search.exact_topk(self.vectors, q, search.check_k(k)), self.vectors, search.coarse(q, self.centroids, every))

    def search(self, texts: DataFrame, k: int = 10, probe: int | None = 8, where: str | Column | None = None) -> DataFrame:
        """Hits of (qid, text) or (qid, vector) with their metadata."""
        return search.with_meta(self.hits(self.queries(texts), k, probe, where=where), self.meta, self.meta_keys)

    def search_text(self, text: str, k: int = 5, probe: int | None = 8, where: str | Column | None = None) -> list[dict]:
        q = self.spark.createDataFrame([(0, text)], "qid long, text string")
        return [r.asDict() for r in self.search(q, k, probe, where).orderBy("rn").collect()]

    def export(self, path: str, shard: int = 0) -> dict:
        """The shard as one binary file."""
        own = self.vectors.where(F.col("shard") == shard)
        return packfile.write_pack(own, self.centroids.where(F.col("shard") == shard).select("list_id", "c"), path)

    def _meta_of(self, shard: int) -> DataFrame:
        """The shard's metadata, a JSON line a row."""
        ids = self.vectors.where(F.col("shard") == shard).select("id").distinct()
        own = self.meta.where(F.col("shard") == shard) if "shard" in self.meta_keys else self.meta.join(ids, "id", "left_semi")
        line = F.col("meta") if isinstance(self, FilePack) else F.to_json(F.struct("id", *[c for c in own.columns if c != "id"]), {"ignoreNullFields": "false"})
        return own.select("id", line.alias("value"))

    def publish(self, out: str, key: str = "file", ending: str = "pack", prefix: str = "") -> dict:
        """Writes the published layout: a binary file and one of JSON lines for each shard, and a manifest that names them. key and ending are those that the reader asks for."""
        shards = []
        for s in self.manifest["shards"]:
            name = f"{prefix}{s['name']}"
            h = self.export(f"{out}/{name}.{ending}", s["shard"])
            write_lines(self._meta_of(s["shard"]), f"{out}/{name}.meta.jsonl")
            shards.append({"name": s["name"], key: f"{name}.{ending}", "meta": f"{name}.meta.jsonl", "n_vectors": h["n_vectors"], "n_lists": h["n_lists"]})
        m = {"schema_version": 2, "version": 1, "created": tables.now_iso(), "dim": self.dim, "seed": self.manifest.get("seed", 0), "n_vectors": sum(s["n_vectors"] for s in shards), "n_lists": max(s["n_lists"] for s in shards), "shards": shards}
        tables.write_manifest(f"{out}/pack.manifest.json", m)
        return m


def write_lines(lines: DataFrame, path: str) -> None:
    """(id, value) as one file of lines in the order of id: tasks write parts, whose bytes are strung together."""
    parts = storage.shared_dir(lines.sparkSession, "lines")
    lines.orderBy("id").select("value").write.text(parts)
    fs, where = storage.arrow(storage.qualified(lines.sparkSession, path))
    own, inside = storage.arrow(parts)
    with fs.open_output_stream(where, compression=None) as out:
        for name, _ in storage.files(parts):
            with own.open_input_stream(f"{inside}/{name}", compression=None) as f:
                while part := f.read(4 << 20):
                    out.write(part)
    storage.delete(parts)


def published_shards(folder: str) -> tuple[list[dict], dict]:
    """(name, file, meta) of each shard, and the manifest: the one that lies there, or for a folder without one that of its only pack.* file."""
    m = tables.manifest(folder) if tables.manifest_name(folder) else {}
    if m.get("shards"):
        return [{"name": s["name"], "file": s[tables.index_key(s)], "meta": s["meta"]} for s in m["shards"]], m
    found = [n for n in storage.names(folder) if n.startswith("pack.") and not n.endswith((".jsonl", ".json", ".sig"))]
    if len(found) != 1 or not storage.exists(f"{folder}/pack.meta.jsonl"):
        raise ValueError(f"no manifest and no pack in {folder}")
    return [{"name": "pack", "file": found[0], "meta": "pack.meta.jsonl"}], m


class FilePack(Pack):
    """An opened pack of the published layout. .meta holds shard, id and the JSON line; of equal ids in a shard the last line counts."""

    meta_keys = ("shard", "id")

    def __init__(self, spark: SparkSession, folder: str, embed: Embedder | None = None, shards: list[dict] | None = None):
        self.spark, self.folder = spark, folder
        shards, m = (shards, {}) if shards is not None else published_shards(folder)
        heads = [packfile.read_header(storage.qualified(spark, f"{folder}/{s['file']}")) for s in shards]
        if len({h["dim"] for h in heads}) != 1:
            raise ValueError("shards of several dimensions")
        about = [{"shard": i, "name": s["name"], "n_vectors": h["n_vectors"], "n_lists": h["n_lists"]} for i, (s, h) in enumerate(zip(shards, heads))]
        self.manifest = {k: v for k, v in m.items() if k != "shards"} | {"dim": heads[0]["dim"], "n_vectors": sum(h["n_vectors"] for h in heads), "shards": about}
        self._embed_by(embed)
        for i, s in enumerate(shards):
            at, path = F.lit(i).cast("long").alias("shard"), f"{folder}/{s['file']}"
            own = (packfile.read_pack(spark, path).select(at, "list_id", "id", "v"), packfile.pack_centroids(spark, path).select(at, "list_id", "c"), tables.read_metadata(spark, f"{folder}/{s['meta']}").select(at, "id", "meta"))
            self.vectors, self.centroids, self.meta = own if not i else (x.unionByName(y) for x, y in zip((self.vectors, self.centroids, self.meta), own))


def open_pack(spark: SparkSession, folder: str, embed: Embedder | None = None) -> Pack | PackSet:
    """A pack or packset of either layout, from its folder alone."""
    m = tables.manifest(folder) if tables.manifest_name(folder) else {}
    if m.get("schema_version") == 3:
        return open_packset(spark, folder, embed)
    return Pack(spark, folder, embed) if storage.exists(f"{folder}/vectors") else FilePack(spark, folder, embed)


def _entries(m: dict) -> list[tuple[str, dict]]:
    return [("Base", m["base"]), *((f"Delta {d['seq']}", d) for d in m["deltas"])]


def _published(m: dict) -> bool:
    """Whether a packset's manifest is of the published layout, which names files."""
    return "meta" in m["base"]


def _check_entry(folder: str, who: str, e: dict) -> None:
    """The digests that a packset's manifest states."""
    if "sha256" in e and folder_digest(f"{folder}/{e['path']}") != e["sha256"]:
        raise ValueError(f"{who} hash mismatch")
    for k, want in e.items():
        if k.startswith("sha256_"):
            name = e[k.removeprefix("sha256_")]
            if not storage.exists(f"{folder}/{name}") or storage.file_digest(storage.qualified(storage._session(), f"{folder}/{name}")) != want:
                raise ValueError(f"{who} {k.removeprefix('sha256_')} hash mismatch")


def verify_pack(folder: str, deep: bool = False) -> dict:
    """The manifest, after every digest that it states, every part that it names and the structure of binary files are checked; deep counts the rows of each list."""
    m = tables.manifest(folder) if tables.manifest_name(folder) else {}
    if m.get("schema_version") == 3:
        for who, e in _entries(m):
            _check_entry(folder, who, e)
            for k in ("meta", "tombstones") if _published(m) else ():
                if k in e and not storage.exists(f"{folder}/{e[k]}"):
                    raise ValueError(f"{who} has no {k}")
            if _published(m):
                packfile.verify_pack(f"{folder}/{e[tables.index_key(e)]}", deep)
            elif who == "Base" or e["rows"]:
                verify_pack(f"{folder}/{e['path']}" + ("" if who == "Base" else "/pack"), deep)
        return m
    if not storage.exists(f"{folder}/vectors"):
        for s in published_shards(folder)[0]:
            packfile.verify_pack(f"{folder}/{s['file']}", deep)
            if not storage.exists(f"{folder}/{s['meta']}"):
                raise ValueError(f"no {s['meta']} in {folder}")
        return m
    for k, want in m.get("sha256", {}).items():
        if not storage.exists(f"{folder}/{k}") or folder_digest(f"{folder}/{k}") != want:
            raise ValueError(f"{k} of {folder} was changed")
    if deep:
        p = Pack(storage._session(), folder)
        counted = {r.shard: r.n for r in p.vectors.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        if counted != {s["shard"]: s["n_vectors"] for s in m["shards"]} or p.vectors.where(F.size("v") != p.dim).limit(1).count():
            raise ValueError(f"vectors of {folder} aren't those of its manifest")
    return m


def inspect_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each shard of a pack, or each tier of a packset; of binary files their headers and sizes too."""
    m = tables.manifest(folder) if tables.manifest_name(folder) else {}
    files = "seq long, name string, file string, bytes long, sha256 string, " + ", ".join(f"{x} long" for x in packfile.FIELDS)

    def row(i: int, name: str, file: str) -> tuple:
        path = storage.qualified(spark, f"{folder}/{file}")
        h = packfile.verify_pack(path)
        return (i, name, file, h["file_size"], storage.file_digest(path), *(h[x] for x in packfile.FIELDS))

    if m.get("schema_version") == 3 and _published(m):
        return spark.createDataFrame([row(e.get("seq", 0), who, e[tables.index_key(e)]) for who, e in _entries(m)], files)
    if m.get("schema_version") == 3:
        rows = [(0, "base", tables.manifest(f"{folder}/base")["n_vectors"])] + [(d["seq"], d["path"], tables.manifest(f"{folder}/{d['path']}/pack")["n_vectors"] if d["rows"] else 0) for d in m["deltas"]]
        return spark.createDataFrame(rows, "seq long, name string, n_vectors long")
    if not storage.exists(f"{folder}/vectors"):
        return spark.createDataFrame([row(i, s["name"], s["file"]) for i, s in enumerate(published_shards(folder)[0])], files)
    return spark.createDataFrame([(s["name"], s["n_vectors"], s["n_lists"], s["id_min"], s["id_max"]) for s in m["shards"]], "name string, n_vectors long, n_lists long, id_min long, id_max long")


def sign_manifest(spark: SparkSession, folder: str, private: str, out: str | None = None) -> str:
    """Writes the Ed25519 signature of the manifest's bytes, beside it unless out says where. private: base64 or PEM."""
    out = out or f"{folder}/manifest.sig"
    storage.write_bytes(out, verify.sign(spark, storage.read_bytes(f"{folder}/{tables.manifest_name(folder)}"), private).encode())
    return out


def manifest_signed(spark: SparkSession, folder: str, public: str, signature: str | None = None) -> bool:
    return verify.signed_by(spark, storage.read_bytes(f"{folder}/{tables.manifest_name(folder)}"), storage.read_bytes(signature or f"{folder}/manifest.sig").decode(), public)


# Packsets


def _root(folder: str) -> dict:
    m = tables.manifest(folder)
    if m.get("schema_version") != 3:
        raise ValueError(f"{folder} is no packset")
    return m


def build_packset_base(rows: DataFrame, folder: str, **options) -> dict:
    build_pack(rows, f"{folder}/base", **options)
    m = {"schema_version": 3, "base": {"path": "base", "sha256": folder_digest(f"{folder}/base")}, "deltas": []}
    tables.write_manifest(f"{folder}/manifest.json", m)
    return m


def _base_of(folder: str) -> str:
    return f"{folder}/base" if storage.exists(f"{folder}/base") else folder


def build_delta(base_dir: str, rows: DataFrame | None, delete_ids: Iterable[int] = (), out: str = "", **options) -> dict:
    """A delta on the packset's or pack's base: a pack of added and changed rows, and tombstones."""
    n = 0
    if storage.exists(out):
        raise ValueError(f"{out} exists")
    if rows is not None and not rows.isEmpty():
        n = build_pack(rows, f"{out}/pack", **options)["n_vectors"]
    gone = sorted({int(i) for i in delete_ids})
    storage.write_bytes(f"{out}/tombstones.jsonl", "".join(json.dumps({"id": i}) + "\n" for i in gone).encode())
    m = {"schema_version": 3, "base_sha256": folder_digest(_base_of(base_dir)), "rows": n, "tombstones": len(gone)}
    m["sha256"] = {k: folder_digest(f"{out}/{k}") for k in ("pack",) if n} | {"tombstones.jsonl": storage.file_digest(storage.qualified(storage._session(), f"{out}/tombstones.jsonl"))}
    tables.write_manifest(f"{out}/manifest.json", m | {"deltas": []})
    return m


def update_packset_manifest(folder: str, delta_dir: str, seq: int) -> dict:
    """Adds the delta that lies in the packset under seq. It must be built on this base, and seq be new."""
    m = _root(folder)
    d = json.loads(storage.read_bytes(f"{folder}/{delta_dir}/manifest.json"))
    if d["base_sha256"] != m["base"]["sha256"]:
        raise ValueError("the delta was built on another base")
    if seq < 1 or seq in {x["seq"] for x in m["deltas"]}:
        raise ValueError(f"seq {seq} is taken or not positive")
    entry = {"seq": seq, "path": delta_dir, "rows": d["rows"], "tombstones": d["tombstones"], "sha256": folder_digest(f"{folder}/{delta_dir}")}
    m["deltas"] = sorted([*m["deltas"], entry], key=lambda x: x["seq"])
    tables.write_manifest(f"{folder}/manifest.json", m)
    return m


def promote_delta(folder: str, delta_dir: str) -> dict:
    """Copies the delta into the packset under the next seq."""
    m = _root(folder)
    seq = max([0, *(d["seq"] for d in m["deltas"])]) + 1
    to = f"deltas/{seq:04d}.delta"
    storage.delete(f"{folder}/{to}")  # left by a promotion that was reverted
    storage.copy(delta_dir, f"{folder}/{to}")
    return update_packset_manifest(folder, to, seq)


def create_packset(base_dir: str, delta_dirs: Iterable[str], out: str) -> dict:
    """A packset from a base pack and deltas in their order."""
    if storage.exists(f"{out}/base"):
        raise ValueError(f"{out} has a base")
    storage.copy(_base_of(base_dir), f"{out}/base")
    m = {"schema_version": 3, "base": {"path": "base", "sha256": folder_digest(f"{out}/base")}, "deltas": []}
    tables.write_manifest(f"{out}/manifest.json", m)
    for d in delta_dirs:
        m = promote_delta(out, d)
    return m


def revert_packset(folder: str, to_seq: int) -> dict:
    """Forgets the deltas after to_seq; their files stay."""
    m = _root(folder)
    m["deltas"] = [d for d in m["deltas"] if d["seq"] <= to_seq]
    tables.write_manifest(f"{folder}/manifest.json", m)
    return m


class PackSet:
    """An opened packset of either layout: .tiers (seq, shard, id, v), .tombstones (id), and the metadata of a tier's row. verify=False leaves the digests to verify_pack()."""

    def __init__(self, spark: SparkSession, folder: str, embed: Embedder | None = None, verify: bool = True):
        m = self.manifest = _root(folder)
        for who, e in _entries(m) if verify else ():
            _check_entry(folder, who, e)
        self.spark, self.folder = spark, folder
        if _published(m):
            pack = lambda e: FilePack(spark, folder, embed, [{"name": "pack", "file": e[tables.index_key(e)], "meta": e["meta"]}])
            packs = [(e.get("seq", 0), pack(e)) for _, e in _entries(m)]
            gone = [f"{folder}/{d['tombstones']}" for d in m["deltas"] if storage.exists(f"{folder}/{d['tombstones']}")]
        else:
            packs = [(0, Pack(spark, f"{folder}/base", embed))] + [(d["seq"], Pack(spark, f"{folder}/{d['path']}/pack", embed)) for d in m["deltas"] if d["rows"]]
            gone = [f"{folder}/{d['path']}/tombstones.jsonl" for d in m["deltas"] if d["tombstones"]]
        base = packs[0][1]
        self.packs, self.queries, self.dim = packs, base.queries, base.dim
        rows, meta = [], []
        for seq, p in packs:
            s = F.lit(seq).cast("long").alias("seq")
            rows.append(p.vectors.select(s, "shard", "id", "v"))
            meta.append(p.meta.drop("shard").select(s, *[c for c in p.meta.columns if c != "shard"]))
        self.tiers, self.meta = rows[0], meta[0]
        for r, x in zip(rows[1:], meta[1:]):
            self.tiers, self.meta = self.tiers.unionByName(r), self.meta.unionByName(x, allowMissingColumns=True)
        self.tombstones = spark.read.schema("id long").json(gone).where("id is not null").distinct() if gone else spark.createDataFrame([], "id long")

    def hits(self, queries: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
        return versions.tiered_hits(self.tiers, self.tombstones, queries, search.check_k(k), strict)

    def search(self, texts: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
        return search.with_meta(self.hits(self.queries(texts), k, strict), self.meta, ("seq", "id"))

    def search_text(self, text: str, k: int = 5) -> list[dict]:
        q = self.spark.createDataFrame([(0, text)], "qid long, text string")
        return [r.asDict() for r in self.search(q, k).orderBy("rn").collect()]

    def publish(self, out: str, key: str = "file", ending: str = "pack") -> dict:
        """Writes the published layout: base and deltas as binary files with their metadata, tombstones, and a root manifest with digests of all."""

        def entry(pack: Pack, path: str, more: dict) -> dict:
            if len(pack.manifest["shards"]) != 1:
                raise ValueError("a published packset has one shard a tier")
            s = pack.publish(f"{out}/{path}", key, ending)["shards"][0]
            e = {key: f"{path}/{s[key]}", "meta": f"{path}/{s['meta']}"} | more
            return e | {f"sha256_{k}": storage.file_digest(storage.qualified(self.spark, f"{out}/{v}")) for k, v in e.items() if k in (key, "meta", "tombstones")}

        m = {"schema_version": 3, "created": tables.now_iso(), "base": {"path": "base"} | entry(self.packs[0][1], "base", {}), "deltas": []}
        by_seq = dict(self.packs[1:])
        for d in self.manifest["deltas"]:
            if d["seq"] not in by_seq:
                raise ValueError(f"delta {d['seq']} has no rows, and a published delta has")
            path = f"deltas/{d['seq']:04d}.delta"
            old = f"{self.folder}/{d['tombstones']}" if _published(self.manifest) else f"{self.folder}/{d['path']}/tombstones.jsonl"
            storage.write_bytes(f"{out}/{path}/tombstones.jsonl", storage.read_bytes(old))
            m["deltas"].append({"seq": d["seq"]} | entry(by_seq[d["seq"]], path, {"tombstones": f"{path}/tombstones.jsonl"}))
        tables.write_manifest(f"{out}/pack.manifest.json", m)
        return m


def open_packset(spark: SparkSession, folder: str, embed: Embedder | None = None, verify: bool = True) -> PackSet:
    return PackSet(spark, folder, embed, verify)


def rebase_packset(spark: SparkSession, folder: str, out: str, text_col: str = "text", **options) -> dict:
    """A new packset whose base is the old one with all deltas applied, without tombstoned rows."""
    p = open_packset(spark, folder)
    rows = versions.rebase(p.meta, p.tombstones).drop("seq")
    return build_packset_base(rows, out, text_col=text_col, id_col="id", **options)


def build_from_articles(spark: SparkSession, path: str, out: str, max_rows: int | None = None, **options) -> dict:
    """A pack of a local mirror of encyclopedia articles."""
    return build_pack(tables.articles(spark, path, max_rows=max_rows), out, **options)


def fidelity_report(pack: Pack, queries: DataFrame, folder: str, name: str, k: int = 10, probe: int = 8, max_scan: int = 0) -> dict:
    """Compares hits with the exact ones for queries (qid, q), and writes name_fidelity.json - a summary and each query's metrics, which are as many as queries - and name_fidelity.md."""
    q = search.asked(queries)
    m = storage.materialise(quality.compare(search.exact_topk(pack.vectors, q, k), pack.hits(q, k, probe, max_scan), q.df, k), "fidelity")
    detail = {"dataset": name, "k": k, "probe": probe, "max_scan": max_scan, "n_vectors": pack.manifest["n_vectors"], "created": tables.now_iso()}
    summary, text = quality.report(quality.gate(m).first().asDict(), detail)
    storage.write_bytes(f"{folder}/{name}_fidelity.json", json.dumps({"summary": summary, "metrics": [r.asDict() for r in m.orderBy("qid").collect()]}, indent=2).encode())
    storage.write_bytes(f"{folder}/{name}_fidelity.md", text.encode())
    return summary


def run_canary(spark: SparkSession, base_dir: str, candidate_dir: str, queries: DataFrame, k: int = 5, least: float = 0.7, avg: float = 0.8) -> dict:
    """Compares both datasets' hits for queries (qid, text or vector)."""
    def hits(folder: str) -> DataFrame:
        p = open_pack(spark, folder)
        return p.hits(p.queries(queries), k, None) if isinstance(p, Pack) else p.hits(p.queries(queries), k)

    return quality.canary(hits(base_dir), hits(candidate_dir), queries, k, least, avg).first().asDict()
