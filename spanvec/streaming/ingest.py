"""Delta ingestion from a stream: each micro-batch becomes the next delta, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import exists


def start(rows: DataFrame, folder: str, checkpoint: str):
    """Writes the streaming rows (shard, id, v, deleted) under folder: deltas by seq, tombstones by seq. A batch that runs again overwrites its own seq."""

    def write(batch: DataFrame, epoch: int) -> None:
        seq = epoch + 1
        batch.where("not deleted").select("shard", "id", "v").write.mode("overwrite").parquet(f"{folder}/deltas/seq={seq}")
        batch.where("deleted").select("id").write.mode("overwrite").parquet(f"{folder}/tombstones/seq={seq}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tiers(base: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(seq, shard, id, v) of the base and every delta, and the tombstones."""
    spark = base.sparkSession
    rows = base.select(F.lit(0).cast("long").alias("seq"), "shard", "id", "v")
    gone = spark.createDataFrame([], "id long")
    if exists(f"{folder}/deltas"):
        d = spark.read.parquet(f"{folder}/deltas").select(F.col("seq").cast("long").alias("seq"), "shard", "id", "v")
        rows = rows.unionByName(d)
        gone = spark.read.parquet(f"{folder}/tombstones").select("id").distinct()
    return rows, gone
