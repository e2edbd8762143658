"""Integrity: bounds of offset tables, structure and digests of files, signatures of manifests."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import file_digests
from ..sources.storage import exists


def bad_entry(size: Column, offset: Column, length: Column) -> Column:
    """An entry is bad if negative, or if it isn't empty and ends beyond the file."""
    return (offset < 0) | (length < 0) | ((length != 0) & (offset + length > size))


def offset_violations(table: DataFrame) -> DataFrame:
    """Rows of (file_size, offset, length, ...) that no reader may follow."""
    return table.where(bad_entry(F.col("file_size"), F.col("offset"), F.col("length")))


def digest_mismatches(spark: SparkSession, expected: DataFrame) -> DataFrame:
    """Of (path, sha256): the files that are missing or differ. The paths are a manifest's."""
    paths = [r.path for r in expected.select("path").distinct().collect()]
    there = [p for p in paths if exists(p)]
    found = file_digests(spark, there) if there else spark.createDataFrame([], "path string, bytes long, sha256 string")
    short = F.regexp_replace("path", "^file:/*", "/")
    got = found.select(short.alias("__p"), F.col("sha256").alias("found"))
    return expected.withColumn("__p", short).join(got, "__p", "left").where("found is null or found <> sha256").drop("__p")


def key_text(key: str) -> str:
    """The base64 of a key, without the lines that PEM puts around it."""
    return "".join(x.strip() for x in key.splitlines() if not x.startswith("-----"))


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def new_keys(spark: SparkSession) -> tuple[str, str]:
    """A new Ed25519 pair, private and public, in base64."""
    j = _jvm(spark)
    pair = j.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory = j.java.security.KeyFactory.getInstance("Ed25519")

    def encoded(key, kind: str) -> str:
        # the key's own class isn't open to reflection, its specification is
        return base64.b64encode(bytes(factory.getKeySpec(key, j.java.lang.Class.forName(f"java.security.spec.{kind}EncodedKeySpec")).getEncoded())).decode()

    return encoded(pair.getPrivate(), "PKCS8"), encoded(pair.getPublic(), "X509")


def sign(spark: SparkSession, data: bytes, private: str) -> str:
    j = _jvm(spark)
    key = j.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(j.java.security.spec.PKCS8EncodedKeySpec(base64.b64decode(key_text(private))))
    s = j.java.security.Signature.getInstance("Ed25519")
    s.initSign(key)
    s.update(data)
    return base64.b64encode(bytes(s.sign())).decode()


def signed_by(spark: SparkSession, data: bytes, signature: str, public: str) -> bool:
    j = _jvm(spark)
    key = j.java.security.KeyFactory.getInstance("Ed25519").generatePublic(j.java.security.spec.X509EncodedKeySpec(base64.b64decode(key_text(public))))
    s = j.java.security.Signature.getInstance("Ed25519")
    s.initVerify(key)
    s.update(data)
    try:
        return bool(s.verify(base64.b64decode(signature)))
    except Exception:
        return False


def diagnose(spark: SparkSession) -> dict[str, str]:
    import platform

    import numpy
    import pyarrow

    return {"python": platform.python_version(), "spark": spark.version, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, "java": _jvm(spark).java.lang.System.getProperty("java.version")}
