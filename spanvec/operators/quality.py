"""Index quality: overlap, Jaccard and Kendall's tau of ranked lists, gates, canaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_lists(hits: DataFrame, name: str) -> DataFrame:
    """qid and its ids in order of rank; k ids a query at most."""
    return hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda s: s["id"]).alias(name))


def overlap(a: Column, b: Column, k: int) -> Column:
    """Common ids over k, however few there are."""
    return F.size(F.array_intersect(a, b)) / F.lit(k)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def kendall(a: Column, b: Column) -> Column:
    """Over the common ids; 1 if there are fewer than two."""
    common = F.filter(a, lambda x: F.array_contains(b, x))
    pos = F.transform(common, lambda x: F.array_position(b, x).cast("double"))
    n = F.size(pos)
    pairs = F.flatten(F.transform(pos, lambda p, i: F.transform(F.slice(pos, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: F.signum(q - p))))
    return F.when(n < 2, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n * (n - 1) / 2))


def compare(truth: DataFrame, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, overlap, jaccard, tau for every query, also where nothing was found."""
    none = F.array().cast("array<bigint>")
    both = queries.select("qid").join(id_lists(truth.where(F.col("rn") <= k), "a"), "qid", "left").join(id_lists(found.where(F.col("rn") <= k), "b"), "qid", "left")
    both = both.select("qid", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    a, b = F.col("a"), F.col("b")
    return both.select("qid", F.when(F.size(a) == 0, 0.0).otherwise(overlap(a, b, k)).alias("overlap"), jaccard(a, b).alias("jaccard"), kendall(a, b).alias("tau"))


def gate(metrics: DataFrame, avg: float = 0.90, least: float = 0.70, tau: float = 0.80) -> DataFrame:
    """One row: averages, the least overlap, and whether all thresholds are met."""
    m = metrics.agg(F.avg("overlap").alias("avg_overlap"), F.min("overlap").alias("min_overlap"), F.avg("jaccard").alias("avg_jaccard"), F.avg("tau").alias("avg_tau"), F.count(F.lit(1)).alias("n_queries"))
    return m.withColumn("passed", (F.col("avg_overlap") >= avg) & (F.col("min_overlap") >= least) & (F.col("avg_tau") >= tau))


def report(gated: dict, detail: dict, avg: float = 0.90, least: float = 0.70, tau: float = 0.80) -> tuple[dict, str]:
    """The gate's row with what failed, and the same in Markdown."""
    failures = [f"{k} {gated[k]:.3f} < {t}" for k, t in (("avg_overlap", avg), ("min_overlap", least), ("avg_tau", tau)) if gated[k] is None or gated[k] < t]
    summary = gated | detail | {"failures": failures}
    lines = [f"# Fidelity of {detail.get('dataset', 'the index')}", "", *(f"- {k}: {v:.3f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in summary.items() if k not in ("failures", "passed"))]
    return summary, "\n".join([*lines, f"- passed: {summary['passed']} ({'; '.join(failures) or 'all thresholds are met'})", ""])


def canary(base: DataFrame, candidate: DataFrame, queries: DataFrame, k: int, least: float = 0.7, avg: float = 0.8) -> DataFrame:
    """One row: do the candidate's hits agree with the base's? Two empty results agree. No queries is an error."""
    none = F.array().cast("array<bigint>")
    both = queries.select("qid").join(id_lists(base, "a"), "qid", "left").join(id_lists(candidate, "b"), "qid", "left")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    o = both.select(F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(overlap(a, b, k)).alias("o"))
    m = o.agg(F.avg("o").alias("avg_overlap"), F.min("o").alias("min_overlap"), F.count(F.lit(1)).alias("n_queries"))
    checked = F.when(F.col("n_queries") == 0, F.raise_error(F.lit("a canary needs queries")).cast("boolean"))
    return m.withColumn("passed", checked.otherwise((F.col("avg_overlap") >= avg) & (F.col("min_overlap") >= least)))


def sample_queries(queries: DataFrame, n: int, seed: int = 42, key: str = "qid") -> DataFrame:
    """n queries in the order of a seeded hash: the same ones wherever it runs."""
    return queries.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)).limit(n)
