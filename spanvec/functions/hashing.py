"""Hashes: seeds of texts, embeddings without a model, digests of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import normalize

M, A, C = 2**32, 1664525, 1013904223


def seed_hex(text: Column, seed: int) -> Column:
    """The first 8 bytes, little-endian, of the SHA-256 of seed:text, in hexadecimal."""
    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), 1, 16)
    return F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))


def seed32(text: Column, seed: int) -> Column:
    """Its lowest 32 bits as a number."""
    return F.conv(F.substring(seed_hex(text, seed), 9, 8), 16, 10).cast("long")


def steps(dim: int) -> list[tuple[int, int]]:
    """(a, c) with x_i = (a x_0 + c) mod 2^32 after i = 1..dim steps of the generator."""
    out, a, c = [], 1, 0
    for _ in range(dim):
        a, c = a * A % M, (c * A + C) % M
        out.append((a, c))
    return out


def lcg_vector(start: Column, dim: int) -> Column:
    """dim numbers from -0.5 to 0.5 from a linear congruential generator, normalised. In closed form, so no loop by element."""

    def value(x: Column, a: int, c: int) -> Column:
        # a x mod 2^32 without overflow: a's halves one after the other
        hi, lo = divmod(a, 1 << 16)
        ax = ((x * hi % M) * (1 << 16) + x * lo) % M
        return (ax + c) % M / F.lit(float(M - 1)) - 0.5

    # the start may be a hash of a long text: the one-element array has it evaluated once
    raw = F.transform(F.array(start), lambda x: F.array(*(value(x, a, c) for a, c in steps(dim))))
    return F.element_at(F.transform(raw, normalize), 1)


def hash_embedding(text: Column, dim: int, seed: int = 0) -> Column:
    """Equal texts have equal unit vectors; the same for building and for queries."""
    return lcg_vector(seed32(text, seed), dim)


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes, sha256 of files of any size, read in parts where they are hashed."""
    from ..sources.storage import file_digest

    found = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([file_digest(p) for p in b.column("path").to_pylist()], pa.string())], [*b.schema.names, "sha256"])

    return found.mapInArrow(run, "path string, bytes long, sha256 string")
