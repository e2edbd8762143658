"""Versioned datasets: an immutable base (seq 0), ordered deltas, and tombstones, as rows with a seq.

The search order is by tier, not by score: all hits of a newer delta come before any of an older one, and the base comes
last. A tombstone hides its id in every tier whatever its seq. Ids that any delta holds are overridden in the base only,
so an older delta's row shows if the newer one wasn't hit; strict=True hides those as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import ranked, scan_topk

OVER_FETCH = 5


def overridden(tiers: DataFrame) -> DataFrame:
    return tiers.where("seq > 0").select("id").distinct()


def live_base(tiers: DataFrame) -> DataFrame:
    """Base rows that no delta holds."""
    return tiers.where("seq = 0").join(overridden(tiers), "id", "left_anti")


def without_tombstones(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    return rows.join(tombstones.select("id").distinct(), "id", "left_anti")


def tiered_hits(tiers: DataFrame, tombstones: DataFrame, queries: DataFrame, k: int, strict: bool = False) -> DataFrame:
    """qid, seq, shard, id, score, rn over tiers (seq, shard, id, v). strict searches only each id's newest row, without tombstoned ones, so it finds k wherever there are k."""
    order = [F.desc("seq"), F.desc("score"), F.asc("shard"), F.asc("id")]
    if strict:
        newest = tiers.groupBy("id").agg(F.max("seq").alias("seq"))
        live = without_tombstones(tiers.join(newest, ["id", "seq"]), tombstones)
        return ranked(scan_topk(live, queries, k, by=("seq", "shard")), k, ["qid"], order).select("qid", "seq", "shard", "id", "score", "rn")
    hits = scan_topk(tiers, queries, OVER_FETCH * k, by=("seq", "shard"))
    hits = ranked(hits, OVER_FETCH * k, ["qid", "seq"]).drop("rn")
    hits = without_tombstones(hits, tombstones)
    base = hits.where("seq = 0").join(overridden(tiers), "id", "left_anti")
    hits = hits.where("seq > 0").unionByName(base)
    seen = Window.partitionBy("qid", "id").orderBy(*order)
    hits = hits.withColumn("__first", F.row_number().over(seen)).where("__first = 1").drop("__first")
    return ranked(hits, k, ["qid"], order).select("qid", "seq", "shard", "id", "score", "rn")


def revert(tiers: DataFrame, to_seq: int) -> DataFrame:
    """The dataset as of to_seq; nothing is deleted."""
    return tiers.where(F.col("seq") <= to_seq)


def next_seq(tiers: DataFrame) -> DataFrame:
    return tiers.where("seq > 0").agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("long").alias("next_seq"))


def promote(tiers: DataFrame, delta: DataFrame) -> DataFrame:
    """tiers with delta's rows under the next seq."""
    seq = F.lit(next_seq(tiers).first()[0]).cast("long")
    return tiers.unionByName(delta.withColumn("seq", seq).select(*tiers.columns))


def rebase(tiers: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One base again: the newest row of each id, without any tombstoned one."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    new = tiers.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumn("seq", F.lit(0).cast("long"))
    return without_tombstones(new.select(*tiers.columns), tombstones)
