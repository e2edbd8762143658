"""The tables of the registered queries, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles, half_vector, normalize

#: Every row whose id is divisible by this is a query.
EVERY = 50
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, shard, list_id, u (unit length), v (as stored, in half precision)."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), (F.col("vec_id") % 3).cast("long").alias("shard"), F.col("label").cast("long").alias("list_id"), normalize(doubles(F.col("embedding"))).alias("u")
    )
    return e.withColumn("v", half_vector(F.col("u")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(f"id % {EVERY} = 0").select(F.col("id").alias("qid"), F.col("u").alias("q"))


def tiers(spark: SparkSession, sf_dir: str, base: str = "id % 10 < 7") -> tuple[DataFrame, DataFrame]:
    """Base and two deltas whose vectors are borrowed from later ids, and tombstones. base: which vectors it holds."""
    v = vectors(spark, sf_dir)
    rows = v.where(base).select(F.lit(0).cast("long").alias("seq"), "shard", "id", "v")

    def delta(seq: int, where: str, shift: int) -> DataFrame:
        ids = v.where(where).select("id", "shard")
        return ids.join(v.select((F.col("id") - shift).alias("id"), "v"), "id").select(F.lit(seq).cast("long").alias("seq"), "shard", "id", "v")

    return rows.unionByName(delta(1, "id % 100 = 6 or id % 250 = 5", 1)).unionByName(delta(2, "id % 100 = 6", 2)), v.where("id % 17 = 0").select("id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_SCALE = "pow(2.0, 10 - greatest(floor(log2(abs(a))), -14))"
U = """e AS (SELECT vec_id::BIGINT AS id, (vec_id % 3)::BIGINT AS shard, label::BIGINT AS list_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT id, shard, list_id, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x))) AS u FROM e)"""
V = f"""{U},
v AS MATERIALIZED (SELECT id, shard, list_id, u, list_transform(u, lambda a: CASE WHEN a = 0 THEN a ELSE round_even(a * {_SCALE}, 0) / {_SCALE} END) AS v FROM u),
q AS MATERIALIZED (SELECT id AS qid, u AS q FROM u WHERE id % {EVERY} = 0)"""
#: Centroids of the labels' lists.
C = """c AS MATERIALIZED (SELECT list_id, list(x ORDER BY pos) AS c FROM (SELECT list_id, pos, avg(x) AS x FROM (SELECT list_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM v) GROUP BY ALL) GROUP BY list_id)"""
T = """t AS MATERIALIZED (SELECT 0::BIGINT AS seq, shard, id, v FROM v WHERE id % 10 < 7
  UNION ALL SELECT 1, a.shard, a.id, b.v FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 100 = 6 OR a.id % 250 = 5
  UNION ALL SELECT 2, a.shard, a.id, b.v FROM v a JOIN v b ON b.id = a.id + 2 WHERE a.id % 100 = 6),
dead AS (SELECT id FROM v WHERE id % 17 = 0)"""
#: The same with a base of all vectors.
T_ALL = T.replace(" WHERE id % 10 < 7", "")


def exact(k: int = K, name: str = "exact") -> str:
    return f"""s_{name} AS MATERIALIZED (SELECT qid, id, shard, list_inner_product(q, v) AS score FROM q, v),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, shard, id) AS rn FROM s_{name}) WHERE rn <= {k})"""


def probed(probe: int, name: str = "p") -> str:
    return f"""{name} AS MATERIALIZED (SELECT qid, q, list_id, prn FROM (SELECT qid, q, list_id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(q, c) DESC, list_id) AS prn FROM q, c) WHERE prn <= {probe})"""


def ivf(probe: int, k: int = K, name: str = "ivf", scan: int = 0) -> str:
    where = f"WHERE n <= {scan}" if scan else ""
    return f"""{probed(probe, "p_" + name)},
l_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard, list_id ORDER BY id) AS n FROM v) {where}),
{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, id, shard, list_inner_product(q, v) AS score, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(q, v) DESC, shard, id) AS rn FROM p_{name} JOIN l_{name} USING (list_id)) WHERE rn <= {k})"""


def tiered(k: int = K, name: str = "tiered", seqs: str = "true") -> str:
    return f"""x_{name} AS (SELECT * FROM t WHERE {seqs}),
h_{name} AS MATERIALIZED (SELECT * FROM (SELECT qid, seq, shard, id, list_inner_product(q, v) AS score, row_number() OVER (PARTITION BY qid, seq ORDER BY list_inner_product(q, v) DESC, shard, id) AS n FROM q, x_{name}) WHERE n <= {5 * k}),
a_{name} AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY seq DESC, score DESC, shard) AS first FROM h_{name}
  WHERE id NOT IN (SELECT id FROM dead) AND (seq > 0 OR id NOT IN (SELECT id FROM x_{name} WHERE seq > 0))),
{name} AS (SELECT * FROM (SELECT qid, seq, shard, id, score, row_number() OVER (PARTITION BY qid ORDER BY seq DESC, score DESC, shard, id) AS rn FROM a_{name} WHERE first = 1) WHERE rn <= {k})"""
