"""Tables in and out: CSV, JSON and Parquet rows with ids, metadata, tombstones, query files, manifests."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.texts import shard_name, snippet, stringify
from .storage import exists, materialise, names, read_bytes, write_bytes


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By the ending: .csv with a header, .json, .jsonl, .parquet, .parq, or a folder of Parquet."""
    kind, r = PurePosixPath(path).suffix.lower(), spark.read
    r = r.schema(schema) if schema else r
    if kind == ".csv":
        return r.option("header", True).option("inferSchema", schema is None).option("multiLine", True).option("escape", '"').csv(path)
    if kind == ".json":
        return r.option("multiLine", True).json(path)
    if kind == ".jsonl":
        return r.json(path)
    if kind in (".parquet", ".parq", ""):
        return r.parquet(path)
    raise ValueError(f"unknown ending {kind}")


def need_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df


def first_rows(df: DataFrame, max_rows: int, key: str) -> DataFrame:
    """The rows of the least keys; a limit is only made when it is asked for."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    return df.orderBy(key).limit(max_rows)


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """df with 0, 1, 2... in the total order of order; of rows that are equal there, any comes first.

    The rows are sorted once, by range, and written with their place in their partition, so that every count is of the
    partitions that were written. Only a row a partition is summed in one task. An empty df stays empty.
    """
    at = materialise(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"), F.max(place).alias("__x"))
    checked = F.when(F.col("__x") + 1 == F.col("__c"), F.col("__c")).otherwise(F.raise_error(F.lit("rows of a partition are missing")).cast("long"))
    before = counts.select("__p", F.coalesce(F.sum(checked).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    out = at.withColumn("__p", part).join(F.broadcast(before), "__p")  # as many rows as partitions
    return out.withColumn(name, (place + F.col("__b") + start).cast("long")).drop("__m", "__p", "__b")


def with_ids(df: DataFrame, id_col: str | None, order: list[str]) -> DataFrame:
    """id from id_col, which must be whole and not negative, else numbers in order."""
    if id_col is None:
        return numbered(df, order)
    need_columns(df, id_col)
    c = F.col(id_col).cast("long")
    return df.withColumn("id", F.when(c >= 0, c).otherwise(F.raise_error(F.lit("ids must be whole numbers from 0")).cast("long")))


def digit_ids(df: DataFrame, key: str) -> DataFrame:
    """id is key where it is all digits, else the row's position in the order of key. Digits beyond a long are an error."""
    digits = F.col(key).rlike(r"^\d+$")
    number = F.coalesce(F.col(key).try_cast("long"), F.raise_error(F.concat(F.lit("an id beyond 2^63: "), F.col(key))).cast("long"))
    return numbered(df, [key], "__at").withColumn("id", F.when(digits, number).otherwise(F.col("__at"))).drop("__at")


def ranges(df: DataFrame, size: int, position: str = "id", prefix: str = "pack") -> DataFrame:
    """shard and shard_name: size consecutive positions each."""
    shard = F.floor(F.col(position) / size).cast("long")
    return df.withColumns({"shard": shard, "shard_name": shard_name(prefix, shard)})


def metadata(df: DataFrame, text_col: str, columns: list[str] | None = None, text: bool = True, snippets: bool = False) -> DataFrame:
    """Metadata rows: id, columns, the text as a string, and a snippet if asked for."""
    cols = [F.col(c) for c in (columns if columns is not None else [c for c in df.columns if c not in ("id", text_col)]) if c in df.columns]
    out = [F.col("id"), *cols]
    if snippets:
        out.append(snippet(stringify(F.col(text_col))).alias("snippet"))
    if text:
        out.append(stringify(F.col(text_col)).alias(text_col))
    return df.select(*out)


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.write.option("ignoreNullFields", False).json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """id and meta (the JSON line); blank lines and rows without id are left out, of equal ids the last line counts."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.col("value").alias("meta"), F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__l"))
    w = Window.partitionBy("id").orderBy(F.desc("__f"), F.desc("__l"))
    return raw.where("id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("id", "meta")


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids; none if there is no file."""
    if not exists(path):
        return spark.createDataFrame([], "id long")
    return spark.read.schema("id long").json(path).where("id is not null").distinct()


def write_tombstones(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("long").alias("id")).distinct().orderBy("id").write.json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text, vector of a JSON-lines file; rows with neither are skipped."""
    q = spark.read.schema("text string, vector array<double>").json(path).where("text is not null or vector is not null")
    return numbered(q.withColumn("__l", F.monotonically_increasing_id()), ["__l"], "qid").select("qid", "text", "vector")


def embedded(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "emb") -> DataFrame:
    """Ready vectors: two columns are read, whatever else the files hold."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def embedded_shards(spark: SparkSession, path: str, target: int, id_col: str = "id", vector_col: str = "emb") -> DataFrame:
    """Ready vectors in shards of target rows each, the last of the rest, in the order of id. No row beyond target is lost: it opens a shard."""
    if target <= 0:
        raise ValueError("a shard needs rows")
    return ranges(numbered(embedded(spark, path, id_col, vector_col), ["id"], "__at"), target, "__at").drop("__at")


def articles(spark: SparkSession, path: str, text_col: str = "text", max_rows: int | None = None) -> DataFrame:
    """A local mirror of encyclopedia articles, in Parquet: id, title, url and text, of those that have a text; ids are positions in the order of the mirror's own."""
    rows = need_columns(spark.read.parquet(path), text_col)
    keep = [c for c in ("title", "url") if c in rows.columns]
    key = "id" if "id" in rows.columns else text_col
    rows = rows.where(F.length(F.trim(text_col)) > 0).select(F.col(key).alias("__key"), *keep, F.col(text_col).alias("text"))
    rows = numbered(rows, ["__key", "text"])
    return (rows if max_rows is None else first_rows(rows, max_rows, "id")).select("id", *keep, "text")


def write_embeddings(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "emb") -> None:
    """A dump of ids and vectors as Parquet, which embedded() reads."""
    vectors.select(F.col("id").cast("long").alias(id_col), F.col("v").cast("array<float>").alias(vector_col)).write.parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header and quotes that load() undoes."""
    rows.write.option("header", True).option("escape", '"').csv(path)


def manifest_name(folder: str) -> str | None:
    """The folder's only manifest, if it has one."""
    found = names(folder, ".manifest.json") or [n for n in names(folder, "manifest.json") if n == "manifest.json"]
    if len(found) > 1:
        raise ValueError(f"{len(found)} manifests in {folder}")
    return found[0] if found else None


def manifest(folder: str) -> dict:
    """The folder's only manifest, of any schema version: one without deltas has shards."""
    name = manifest_name(folder)
    if name is None:
        raise ValueError(f"0 manifests in {folder}")
    m = json.loads(read_bytes(f"{folder}/{name}"))
    if m.get("schema_version") == 3:
        return m | {"deltas": sorted(m.get("deltas", []), key=lambda d: d["seq"])}
    if not isinstance(m.get("shards"), list):
        raise ValueError("a manifest without shards")
    return m


def index_key(entry: dict) -> str:
    """Under which key an entry of a manifest names the file of its vectors: the text that is no other part of it."""
    return next(k for k, v in entry.items() if isinstance(v, str) and k not in ("name", "meta", "tombstones", "path") and not k.startswith("sha256"))


def manifest_shards(spark: SparkSession, m: dict) -> DataFrame:
    rows = [(i, s["name"], s[index_key(s)], s["meta"], s.get("n_vectors")) for i, s in enumerate(m["shards"])]
    return spark.createDataFrame(rows, "shard long, name string, file string, meta string, n_vectors long")


def write_manifest(path: str, content: dict) -> None:
    """Whole or not at all: written aside and renamed."""
    write_bytes(path, json.dumps(content, indent=2).encode())


def now_iso() -> str:
    """The time in UTC to the second, as manifests state it."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def json_row(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))
