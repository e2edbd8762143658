"""Batch search: queries in blocks against all vectors, exactly or by the nearest lists.

Arrow batches are scored by one matrix product and a task keeps only each query's best, so the shuffle carries k rows
a query and task whatever the number of vectors. Queries, and the lists they probe, go to the tasks as one broadcast
up to QUERY_BYTES, a size that is checked; beyond, vectors and queries meet in tiles by a shuffle. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise

#: Bytes of queries - vectors, and their probes - that may be broadcast.
QUERY_BYTES = 64 << 20
#: Bytes of centroids that may be broadcast.
CENTROID_BYTES = 256 << 20
#: Rows of one tile's vectors, and of its queries.
TILE_ROWS, TILE_QUERIES = 200_000, 20_000
#: Rows of a table that reach the driver before its size is asked for: at most FEW times the longest vector.
FEW = 1024
#: Numbers in one matrix of scores, and rows that a task holds before it drops what is not among the best.
SCORES, HELD = 4 << 20, 1 << 20
#: Lists up to which the scan's filter names each of them; more are a broadcast join.
NAMED_LISTS = 1000


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each query's k best; all of equal scores at the edge stay, so that ids decide later."""
    n = scores.shape[1]
    if n <= k:
        r, c = np.divmod(np.arange(scores.size), n)
        return r, c
    edge = np.partition(scores, n - k, axis=1)[:, n - k]
    r, c = np.nonzero(scores >= edge[:, None] - 1e-12)
    if len(r) > 2 * k * len(scores):  # many ties: the least ids stay
        o = np.lexsort((ids[c], -scores[r, c], r))
        first = np.searchsorted(r[o], np.arange(len(scores)))
        keep = o[(np.arange(len(o)) - first[r[o]]) < k]
        r, c = r[keep], c[keep]
    return r, c


class _Held:
    """Of rows (keys..., ties..., score) the k best for equal keys: the greatest scores, then the least ties."""

    def __init__(self, k: int, names: list[str], keys: int):
        self.k, self.names, self.keys = k, names, keys
        self.parts: list[tuple] = []
        self.rows = self.limit = 0

    def add(self, *cols: np.ndarray) -> None:
        self.parts.append(cols)
        self.rows += len(cols[0])
        if self.rows > max(HELD, self.limit):
            self.prune()

    def prune(self) -> None:
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        o = np.lexsort((*cols[self.keys : -1][::-1], -cols[-1], *cols[: self.keys][::-1]))
        cols = [c[o] for c in cols]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[: self.keys]], axis=0)))
        at = np.arange(len(o))
        keep = at - np.maximum.accumulate(np.where(new, at, 0)) < self.k
        self.parts = [tuple(c[keep] for c in cols)]
        self.rows = int(keep.sum())
        self.limit = 2 * self.rows

    def table(self) -> pa.Table:
        if len(self.parts) > 1:
            self.prune()
        cols = self.parts[0] if self.parts else [np.zeros(0, np.int64)] * (len(self.names) - 1) + [np.zeros(0)]
        return pa.table([pa.array(c) for c in cols], names=self.names)

    def score(self, qid: np.ndarray, q: np.ndarray, keys: list[np.ndarray], ties: list[np.ndarray], v: np.ndarray) -> None:
        """All queries against vectors of one group."""
        if not len(v) or not len(q):
            return
        order = ties[-1] if len(ties) == 1 else np.argsort(np.lexsort(ties[::-1]))
        step = max(1, SCORES // len(v))
        for i in range(0, len(q), step):
            s = q[i : i + step] @ v.T
            r, c = _best(s, order, self.k)
            self.add(qid[i : i + step][r], *(x[c] for x in keys), *(x[c] for x in ties), s[r, c])


def _groups(cols: list[np.ndarray], n: int) -> Iterator[np.ndarray]:
    """Rows of equal cols."""
    if not cols:
        yield np.arange(n)
        return
    o = np.lexsort(cols[::-1])
    cut = np.flatnonzero(np.concatenate(([True], np.any([c[o][1:] != c[o][:-1] for c in cols], axis=0), [True]))) if n else [0]
    for i, j in zip(cut[:-1], cut[1:]):
        yield o[i:j]


def ranked(hits: DataFrame, k: int, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """hits with rank rn <= k within by, in a total order."""
    w = Window.partitionBy(*by).orderBy(*(order or [F.desc("score"), F.asc("shard"), F.asc("id")]))
    return hits.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= k)


class Held:
    """A table of keys and vectors that is computed once; .arrays has both, in order of the keys, where their size, which is checked, is at most limit bytes."""

    def __init__(self, df: DataFrame, keys: list[str], vector: str, limit: int):
        df = df.select(*(F.col(c).cast("long").alias(c) for c in keys), F.col(vector).cast("array<double>").alias(vector))
        some = df.limit(FEW + 1).toArrow()
        if some.num_rows <= FEW:
            self.df, self.rows = df.sparkSession.createDataFrame(some.cast(_arrow_schema(keys, vector))), some.num_rows
            self.dim = max((len(x) for x in some.column(vector).to_pylist()[:1]), default=0)
        else:
            self.df, some = materialise(df, "vectors"), None
            self.rows, self.dim = self.df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
        self.arrays = None
        if self.rows * (self.dim + len(keys)) * 8 <= limit:
            t = self.df.toArrow() if some is None else some
            cols = [t.column(c).to_numpy() for c in keys]
            o = np.lexsort(cols[::-1])
            self.arrays = (*(c[o] for c in cols), matrix(t.column(vector)).reshape(self.rows, self.dim)[o])


def _arrow_schema(keys: list[str], vector: str) -> pa.Schema:
    return pa.schema([*((c, pa.int64()) for c in keys), (vector, pa.list_(pa.float64()))])


def asked(queries: DataFrame | Held) -> Held:
    return queries if isinstance(queries, Held) else Held(queries, ["qid"], "q", QUERY_BYTES)


def _tiles(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def scan_topk(vectors: DataFrame, queries: DataFrame | Held, k: int, by: tuple[str, ...] = ("shard",), ties: tuple[str, ...] = ()) -> DataFrame:
    """The k best of each group of by and query, by dot product, of vectors (by..., ties..., id, v) and queries (qid, q); equal scores go by ties and id. Vectors are read once."""
    q, keys, more = asked(queries), list(by), [*ties, "id"]
    names = ["qid", *keys, *more, "score"]
    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", score double"
    found = vectors.select(*(F.col(c).cast("long").alias(c) for c in [*keys, *more]), "v")

    def scored(held: _Held, table, qid: np.ndarray, qs: np.ndarray) -> None:
        col = {c: table.column(c).to_numpy() for c in [*keys, *more]}
        v = matrix(table.column("v"))
        for at in _groups([col[c] for c in keys], len(v)):
            held.score(qid, qs, [col[c][at] for c in keys], [col[c][at] for c in more], v[at])

    if q.arrays is not None:
        b = vectors.sparkSession.sparkContext.broadcast(q.arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(k, names, 1 + len(keys))
            for batch in batches:
                scored(held, batch, *b.value)
            yield from held.table().to_batches()

        hits = found.mapInArrow(run, schema)
    else:
        vt, qt = _tiles(vectors.count(), TILE_ROWS), _tiles(q.rows, TILE_QUERIES)
        left = found.select("*", F.pmod(F.xxhash64(*keys, "id"), F.lit(vt)).alias("vt"), F.explode(F.sequence(F.lit(0), F.lit(qt - 1))).alias("qt"))
        right = q.df.select("*", F.pmod(F.xxhash64("qid"), F.lit(qt)).cast("int").alias("qt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vt - 1).cast("long"))).alias("vt"))

        def tile(a: pa.Table, c: pa.Table) -> pa.Table:
            held = _Held(k, names, 1 + len(keys))
            if a.num_rows and c.num_rows:
                scored(held, a, c.column("qid").to_numpy(), matrix(c.column("q")))
            return held.table()

        hits = left.groupBy("vt", "qt").cogroup(right.groupBy("vt", "qt")).applyInArrow(tile, schema)
    return ranked(hits, k, ["qid", *keys], [F.desc("score"), *(F.asc(c) for c in more)]).drop("rn")


def exact_topk(vectors: DataFrame, queries: DataFrame | Held, k: int) -> DataFrame:
    """qid, id, shard, score, rn: the k best over all shards, ties by shard and id."""
    return ranked(scan_topk(vectors, queries, k, by=(), ties=("shard",)), k, ["qid"])


def _nearest(qid: np.ndarray, qs: np.ndarray, keys: list[np.ndarray], cen: np.ndarray, probe: int) -> Iterator[list[np.ndarray]]:
    """qid, keys... and rank of the nearest lists."""
    step = max(1, SCORES // max(1, len(cen)))
    for at in _groups(keys[:-1], len(cen)) if len(cen) else ():
        n = min(probe, len(at))
        for i in range(0, len(qid), step):
            s = qs[i : i + step] @ cen[at].T
            r, x = _best(s, keys[-1][at], n)
            o = np.lexsort((keys[-1][at][x], -s[r, x], r))
            r, x = r[o], x[o]
            rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(s)))[r]
            keep = rank < n
            yield [qid[i : i + step][r[keep]], *(y[at][x[keep]] for y in keys), rank[keep] + 1]


def _probes(q: Held, c: Held, probe: int) -> pa.Table | None:
    """The probes where queries, lists and scores are few enough for the driver."""
    if q.arrays is None or c.arrays is None or q.rows * max(c.rows, 1) > SCORES:
        return None
    found = list(_nearest(*q.arrays, list(c.arrays[:-1]), c.arrays[-1], max(1, probe)))
    names = ["qid", *(x for x in c.df.columns if x == "shard"), "list_id", "prn"]
    cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(x, pa.int64()) for x in cols], names=names)


def coarse(queries: DataFrame | Held, centroids: DataFrame | Held, probe: int) -> DataFrame:
    """qid, list_id, prn: the probe lists - one at least, all at most - whose centroids, which aren't normalised, have the greatest dot products. Where centroids has a shard, each shard's lists are probed and a column names it."""
    q, c = asked(queries), lists_of(centroids)
    few = _probes(q, c, probe)
    if few is not None:
        return q.df.sparkSession.createDataFrame(few)
    by, probe = [x for x in c.df.columns if x == "shard"], max(1, probe)
    cols = [*by, "list_id"]
    if c.arrays is None:
        far = c.df.select(*by, F.col("list_id").alias("id"), F.col("c").alias("v"))
        top = ranked(scan_topk(far, q, probe, by=tuple(by)), probe, ["qid", *by], [F.desc("score"), F.asc("id")])
        return top.select("qid", *by, F.col("id").alias("list_id"), F.col("rn").alias("prn"))
    b = q.df.sparkSession.sparkContext.broadcast(c.arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *keys, cen = b.value
        for batch in batches:
            for found in _nearest(batch.column("qid").to_numpy(), matrix(batch.column("q")), keys, cen, probe):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["qid", *cols, "prn"])

    return q.df.mapInArrow(run, "qid long, " + "".join(f"{x} long, " for x in cols) + "prn long")


def lists_of(centroids: DataFrame | Held) -> Held:
    if isinstance(centroids, Held):
        return centroids
    return Held(centroids, [*(x for x in centroids.columns if x == "shard"), "list_id"], "c", CENTROID_BYTES)


def first_of_lists(vectors: DataFrame, max_scan: int) -> DataFrame:
    """The first max_scan vectors of each shard's list, in order of id; 0 means all. Tasks drop what can't be among them before the shuffle."""
    if max_scan <= 0:
        return vectors
    names = vectors.columns
    shard, at, key = (names.index(c) for c in ("shard", "list_id", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, x, i = (b.column(k).to_numpy(zero_copy_only=False) for k in (shard, at, key))
            o = np.lexsort((i, x, s))
            new = np.concatenate(([True], (s[o][1:] != s[o][:-1]) | (x[o][1:] != x[o][:-1])))
            place = np.arange(len(o))
            yield b.take(pa.array(np.sort(o[place - np.maximum.accumulate(np.where(new, place, 0)) < max_scan])))

    w = Window.partitionBy("shard", "list_id").orderBy("id")
    return vectors.mapInArrow(run, vectors.schema).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_scan).drop("__n")


def probed_only(vectors: DataFrame, lists: list[tuple[int, ...]], cols: list[str]) -> DataFrame:
    """vectors of those lists alone. The filter is on columns of the scan, so folders or row groups of other lists aren't read."""
    if len(lists) > NAMED_LISTS:
        named = vectors.sparkSession.createDataFrame(lists, ", ".join(f"{c} long" for c in cols))
        return vectors.join(F.broadcast(named), cols, "left_semi")
    if len(cols) == 1:
        return vectors.where(F.col(cols[0]).isin([x for (x,) in lists]))
    shards: dict[int, list[int]] = {}
    for s, x in lists:
        shards.setdefault(s, []).append(x)
    which = F.lit(False)
    for s, xs in shards.items():
        which = which | ((F.col(cols[0]) == s) & F.col(cols[1]).isin(xs))
    return vectors.where(which)


def fine(vectors: DataFrame, probes: DataFrame | pa.Table, queries: DataFrame | Held, k: int, max_scan: int = 0) -> DataFrame:
    """qid, shard, id, score: each query's k best of the lists it probes, ties by shard and id.

    Where queries and probes are at most QUERY_BYTES, a size that is checked, vectors are filtered to the probed lists at
    their scan and scored there, without a shuffle. Beyond, lists meet their queries by a shuffle, in tiles, so that
    neither a list of many vectors nor one of many queries is one task's.
    """
    q = asked(queries)
    few = probes if isinstance(probes, pa.Table) else None
    cols = [c for c in ("shard", "list_id") if c in (probes.column_names if few is not None else probes.columns)]
    names, schema = ["qid", "shard", "id", "score"], "qid long, shard long, id long, score double"
    if few is None:
        probes = materialise(probes.select("qid", *cols), "probes")
    order = [F.desc("score"), F.asc("shard"), F.asc("id")]
    need = [F.col(c).cast("long").alias(c) for c in ("shard", "list_id", "id")] + [F.col("v")]
    n = few.num_rows if few is not None else probes.count()
    if q.arrays is not None and n * 8 * (1 + len(cols)) + q.rows * 8 * (q.dim + 1) <= QUERY_BYTES:
        p = few if few is not None else probes.toArrow()
        keys = [p.column(c).to_numpy() for c in cols]
        row = np.searchsorted(q.arrays[0], p.column("qid").to_numpy())
        by_list = {tuple(int(x[at[0]]) for x in keys): row[at] for at in _groups(keys, len(row))} if len(row) else {}
        b = vectors.sparkSession.sparkContext.broadcast((by_list, *q.arrays))
        near = first_of_lists(probed_only(vectors.select("shard", "list_id", "id", "v"), list(by_list), cols), max_scan).select(*need)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, (lists, qid, qs) = _Held(k, names, 1), b.value
            for batch in batches:
                col = {c: batch.column(c).to_numpy() for c in ("shard", "list_id", "id")}
                v = matrix(batch.column("v"))
                for at in _groups([col[c] for c in cols], len(v)):
                    rows = lists.get(tuple(int(col[c][at[0]]) for c in cols))
                    if rows is not None:
                        held.score(qid[rows], qs[rows], [], [col["shard"][at], col["id"][at]], v[at])
            yield from held.table().to_batches()

        return ranked(near.mapInArrow(run, schema), k, ["qid"], order).drop("rn")
    if few is not None:
        probes = vectors.sparkSession.createDataFrame(few.select(["qid", *cols]))
    near = first_of_lists(vectors.select("shard", "list_id", "id", "v"), max_scan).select(*need)
    parts = lambda df, each: df.groupBy(*cols).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / each)).cast("int").alias("n"))
    n = parts(vectors, TILE_ROWS).withColumnRenamed("n", "vs").join(parts(probes, TILE_QUERIES).withColumnRenamed("n", "qs"), cols)
    n = materialise(n, "tiles")
    left = near.join(n, cols).select(*near.columns, F.pmod(F.xxhash64("id"), F.col("vs")).cast("int").alias("vt"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qt"))
    right = probes.join(q.df, "qid").join(n, cols).select(*cols, "qid", "q", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int").alias("qt"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vt"))

    def tile(a: pa.Table, c: pa.Table) -> pa.Table:
        held = _Held(k, names, 1)
        if a.num_rows and c.num_rows:
            held.score(c.column("qid").to_numpy(), matrix(c.column("q")), [], [a.column("shard").to_numpy(), a.column("id").to_numpy()], matrix(a.column("v")))
        return held.table()

    hits = left.groupBy(*cols, "vt", "qt").cogroup(right.groupBy(*cols, "vt", "qt")).applyInArrow(tile, schema)
    return ranked(hits, k, ["qid"], order).drop("rn")


def ivf_topk(vectors: DataFrame, centroids: DataFrame | Held, queries: DataFrame | Held, k: int, probe: int, max_scan: int = 0) -> DataFrame:
    """qid, shard, id, score, rn over vectors (shard, list_id, id, v): the nearest lists - of each shard, where centroids has one - are scanned and all shards merged."""
    q, c = asked(queries), lists_of(centroids)
    few = _probes(q, c, probe)
    return ranked(fine(vectors, coarse(q, c, probe) if few is None else few, q, k, max_scan), k, ["qid"])


def probe_recall(hits: DataFrame, vectors: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, recall: the share of hits - each query's exact best - that the probe nearest lists hold, for each number of lists in probes. probes is coarse() of all lists; it has a shard where each shard has lists of its own."""
    keys = [c for c in ("shard", "list_id") if c in probes.columns]
    at = hits.select("qid", "shard", "id").join(vectors.select("shard", "id", "list_id"), ["shard", "id"]).join(probes.select("qid", *keys, "prn"), ["qid", *keys])
    n = probes.select("prn").distinct().join(at.groupBy("prn").agg(F.count(F.lit(1)).alias("n")), "prn", "left").crossJoin(hits.agg(F.count(F.lit(1)).alias("total")))
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("prn").rowsBetween(Window.unboundedPreceding, 0))
    return n.select(F.col("prn").cast("long").alias("probe"), (so_far / F.col("total")).alias("recall"))


def least_probe(recalls: DataFrame, least: float = 0.9) -> int | None:
    """The fewest lists of that recall; None if no number of lists in recalls has it, and everything is to be read."""
    return recalls.where(F.col("recall") >= least).agg(F.min("probe")).first()[0]


def scan_counts(vectors: DataFrame, probes: DataFrame, max_scan: int = 0) -> DataFrame:
    """qid, scanned: vectors read for each query, over all shards."""
    n = vectors.groupBy("shard", "list_id").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("n", F.least("n", F.lit(max_scan)) if max_scan > 0 else F.col("n"))
    lists = n.groupBy("list_id").agg(F.sum("n").alias("n"))
    return probes.join(lists, "list_id", "left").groupBy("qid").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("scanned"))


def presets(n_lists: int) -> dict[str, int]:
    """Probes of the presets, and which of them is the default."""
    p = {k: max(1, min(n_lists, int(x + 0.5))) for k, x in (("fast", n_lists * 0.03125), ("balanced", n_lists * 0.125), ("safe", n_lists / 5.3))}
    return p | {"default": p["safe" if n_lists >= 1024 else "balanced"]}


def confidence(hits: DataFrame, least: float = 0.45, margin: float = 0.03) -> DataFrame:
    """qid, s1, s2, low_score, low_margin from ranked hits; without a second hit there is no margin to warn of."""
    least = min(1.0, max(0.0, least))
    s = lambda n: F.max(F.when(F.col("rn") == n, F.col("score")))
    out = hits.where("rn <= 2").groupBy("qid").agg(s(1).alias("s1"), s(2).alias("s2"))
    return out.withColumns({"low_score": F.col("s1") < least, "low_margin": F.coalesce(F.col("s1") - F.col("s2") < margin, F.lit(False))})


def with_meta(hits: DataFrame, meta: DataFrame, keys: tuple[str, ...] = ("shard", "id")) -> DataFrame:
    """Late join: only the hits' metadata is read; a missing row leaves nulls."""
    return hits.join(meta, list(keys), "left")


def where_meta(vectors: DataFrame, meta: DataFrame, condition: str | Column, keys: tuple[str, ...] = ("shard", "id")) -> DataFrame:
    """vectors of the ids whose metadata meets condition: what is filtered out takes no place among the k best. A vector without metadata isn't there."""
    return vectors.join(meta.where(condition).select(*keys).distinct(), list(keys), "left_semi")


def check_k(k: int, cap: int | None = None) -> int:
    """k, which is positive and, where a caller has a cap, at most that: more is an error, never fewer rows than were asked for."""
    if k < 1:
        raise ValueError("k must be positive")
    if cap is not None and k > cap:
        raise ValueError(f"k must be at most {cap}")
    return k
