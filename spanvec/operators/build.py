"""Index building: list counts, clustering, assignment, layout of the binary file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialise
from . import search
from .search import Held, lists_of, matrix

HEADER = 72


def effective_lists(requested: int, n: int) -> int:
    if n <= 0:
        raise ValueError("there are no vectors")
    return max(1, min(requested, n))


def shard_lists(requested: int, n: int) -> int:
    """At least 39 vectors a list, where there are so many."""
    return min(requested, max(1, n // 39), n)


def centroids_of(vectors: DataFrame) -> DataFrame:
    """list_id, c: the mean vector of each list. A batch of rows sends a sum for each of its lists; only those meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists, at = np.unique(b.column("list_id").to_numpy(), return_inverse=True)
                v = matrix(b.column("v"))
                o = np.argsort(at, kind="stable")
                sums = np.add.reduceat(v[o], np.searchsorted(at[o], np.arange(len(lists))), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.bincount(at)), pa.array(list(sums), pa.list_(pa.float64()))], ["list_id", "n", "s"])

    sums = vectors.select(F.col("list_id").cast("long").alias("list_id"), "v").mapInArrow(run, "list_id long, n long, s array<double>")
    at = sums.select("list_id", "n", F.posexplode("s").alias("pos", "x")).groupBy("list_id", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return at.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))


def single_list(vectors: DataFrame) -> DataFrame:
    """All vectors in list 0."""
    return vectors.withColumn("list_id", F.lit(0).cast("long"))


def train(vectors: DataFrame, n_lists: int, seed: int = 1234, rounds: int = 20) -> DataFrame:
    """list_id, c by k-means over all vectors; one list is the mean."""
    if n_lists == 1:
        return centroids_of(single_list(vectors))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n_lists, seed=seed, maxIter=rounds, initMode="random", featuresCol="f").fit(vectors.select(array_to_vector("v").alias("f")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "list_id long, c array<double>")


def assign(vectors: DataFrame, centroids: DataFrame | Held) -> DataFrame:
    """vectors with list_id: the centroid of the least Euclidean distance, the least list of equals.

    Centroids up to CENTROID_BYTES, a size that is checked, are broadcast; more go from task to task through the shared
    folder, a block of that size at a time, and each vector keeps the best so far.
    """
    held = lists_of(centroids)
    keep = [c for c in vectors.columns if c != "list_id"]
    if not held.rows:
        raise ValueError("there are no centroids")
    each = max(1, search.CENTROID_BYTES // (8 * (held.dim + 1)))
    if held.arrays is not None:
        blocks = [held.arrays]
    else:
        first = [r[0] for r in held.df.select("list_id").orderBy("list_id").collect()][::each]  # ids alone, 8 bytes a list
        blocks = [((held.df.where(F.col("list_id") >= lo) if hi is None else held.df.where((F.col("list_id") >= lo) & (F.col("list_id") < hi))), None) for lo, hi in zip(first, [*first[1:], None])]
    kind = {f.name: f.dataType.simpleString() for f in vectors.select(*keep).schema}
    base = ", ".join(f"`{c}` {kind[c]}" for c in keep)
    out = vectors.select(*keep)
    for i, block in enumerate(blocks):
        if block[1] is None:
            t = block[0].orderBy("list_id").toArrow()
            block = (t.column("list_id").to_numpy(), matrix(t.column("c")))
        b, last = vectors.sparkSession.sparkContext.broadcast(block), i == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], b=b, first=i == 0, last=last) -> Iterator[pa.RecordBatch]:
            lists, c = b.value
            half = (c * c).sum(axis=1)
            step = max(1, search.SCORES // len(c))
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column("v"))
                best, far = np.empty(len(v), np.int64), np.empty(len(v))
                for k in range(0, len(v), step):
                    d = half - 2 * (v[k : k + step] @ c.T)
                    x = d.argmin(axis=1)
                    best[k : k + step], far[k : k + step] = lists[x], d[np.arange(len(x)), x]
                cols = [batch.column(k) for k in range(len(keep))]
                if not first:
                    was = batch.column(len(keep) + 1).to_numpy()
                    best, far = np.where(far < was, best, batch.column(len(keep)).to_numpy()), np.minimum(far, was)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(best), *([] if last else [pa.array(far)])], [*keep, "list_id", *([] if last else ["__far"])])

        out = out.mapInArrow(run, f"{base}, list_id long" + ("" if last else ", __far double"))
        if not last:
            out = materialise(out, "assigned")  # one block of centroids is held at a time
            b.destroy()
    return out


def lloyd(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """One step: assign, then means; a list that nobody chose keeps its centroid."""
    held = lists_of(centroids)
    new = centroids_of(assign(vectors, held)).select("list_id", F.col("c").alias("new"))
    return held.df.join(new, "list_id", "left").select("list_id", F.coalesce("new", "c").alias("c"))


def list_counts(vectors: DataFrame, n_lists: int) -> DataFrame:
    """list_id, n for every list, empty ones too."""
    spark = vectors.sparkSession
    n = vectors.groupBy(F.col("list_id").cast("long").alias("list_id")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(n_lists).select(F.col("id").alias("list_id")).join(n, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def offsets(counts: DataFrame, dim: int, n_lists: int) -> DataFrame:
    """list_id, n, start (vectors before), offset and length in bytes. counts has n_lists rows, so a running sum over it is small."""
    w = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    length = F.lit(4) + F.col("n") * (8 + 2 * dim)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    return counts.select("list_id", "n", before(F.col("n")).alias("start"), (before(length) + HEADER + 4 * n_lists * dim).alias("offset"), length.cast("long").alias("length"))


def write_layout(vectors: DataFrame, path: str) -> None:
    """Parquet by shard and list, rows of a list in order of id; readers prune to the probed lists. A large list spreads over files of its own."""
    vectors.repartition("shard", "list_id", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("shard", "list_id", "id").write.partitionBy("shard", "list_id").parquet(path)


def shard_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("shard").agg(F.count(F.lit(1)).alias("n_vectors"), F.min("id").alias("id_min"), F.max("id").alias("id_max"))
