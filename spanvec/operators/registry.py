"""A catalog of published versions: organisations, projects, versions and an audit log as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "orgs": "org_id long, name string",
    "projects": "project_id long, org_id long, name string",
    "versions": "version_id long, project_id long, version string, path string, sha256 string, created_at double",
    "audit": "actor string, action string, details string, created_at double",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}


def insert(table: DataFrame, rows: DataFrame, unique: list[str]) -> DataFrame:
    """table with rows; a row whose unique columns are in the table or in another row is an error when it is read. As in a database, nulls differ from each other."""
    known = [F.col(c).isNotNull() for c in unique]
    seen = rows.select(*unique, F.lit(0).alias("__old"), F.lit(1).alias("__new")).union(table.select(*unique, F.lit(1), F.lit(0)))
    for k in known:
        seen = seen.where(k)
    clash = seen.groupBy(*unique).agg(F.sum("__old").alias("__old"), F.sum("__new").alias("__new")).where("__new > 1 or (__new > 0 and __old > 0)")
    marked = rows.join(clash.select(*unique, F.lit(True).alias("__there")), unique, "left")
    checked = marked.withColumn("__ok", F.when(F.col("__there"), F.raise_error(F.lit("409: it exists")).cast("boolean")).otherwise(True)).where("__ok")
    return table.unionByName(checked.select(*table.columns))


def project_of(catalog: dict[str, DataFrame], org: str, project: str) -> DataFrame:
    o, p = catalog["orgs"], catalog["projects"]
    return p.join(o.where(F.col("name") == org).select("org_id"), "org_id").where(F.col("name") == project).select("project_id")


def list_versions(catalog: dict[str, DataFrame], org: str, project: str) -> DataFrame:
    """The project's versions, the newest first, then by name."""
    v = catalog["versions"].join(F.broadcast(project_of(catalog, org, project).limit(1)), "project_id")
    return v.select("version", "path", "sha256", "created_at").orderBy(F.desc("created_at"), F.asc("version"))


def log(catalog: dict[str, DataFrame], actor: str, action: str, details: str, at: float) -> dict[str, DataFrame]:
    spark = catalog["audit"].sparkSession
    return catalog | {"audit": catalog["audit"].unionByName(spark.createDataFrame([(actor, action, details, at)], SCHEMAS["audit"]))}


def byte_range(data, start: int, end: int):
    """Bytes start..end, both included, of a binary column; an empty or impossible range is an error."""
    if start < 0 or end < start:
        raise ValueError("416: no such range")
    return F.substring(data, start + 1, end - start + 1)
