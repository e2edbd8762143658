"""What the text operators share: Arrow batches as numpy buffers, word tables, hashing, the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import arrow, let_go, materialise, qualified, shared_dir  # noqa: F401 - for the operators

U64 = np.uint64
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z and turns the white space \x20, \x09-\x0D into a space.
LOWER_WS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, the base of the polynomial hashes and its inverse modulo 2^64.
BYTE_TAB = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow with a function that is made once a task and gets at most so many rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            if b.num_rows:
                f = f or make()
                for i in range(0, b.num_rows, rows):
                    yield from f(b.slice(i, rows))
        give_back()

    return df.mapInArrow(run, schema)


def binaries(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return pc.fill_null(col, "").cast(pa.binary()).to_pylist()


def longs(col: pa.Array) -> np.ndarray:
    """As int64; null is 0, which the caller tells apart by null_mask()."""
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def null_mask(col: pa.Array) -> np.ndarray:
    return col.is_null().to_numpy(zero_copy_only=False)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    if "f" not in _POWERS or len(_POWERS["f"]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, b in (("f", BASE), ("i", BASE_INV)):
                a = np.full(m, b, np.uint64)
                a[0] = 1
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["f"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of names."""
    x = a * U64(0x9E3779B97F4A7C15)
    x += (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def chunks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; one document at least."""
    i, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield i, min(j, n)
        i = min(j, n)


def words_of(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the joined texts by table, each word's start, end and 64-bit hash there, and where each text's words begin."""
    buf = b" ".join([*texts, b""]).translate(table)
    t = np.frombuffer(buf, np.uint8)
    if not len(t):
        e = np.zeros(0, np.int64)
        return t, e, e, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = t != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # the last byte is a space
    f, inv = powers(len(t) + 1)
    p = np.empty(len(t) + 1, np.uint64)
    p[0] = 0
    np.cumsum(BYTE_TAB[t] * f[: len(t)], out=p[1:])
    h = mix((p[end] - p[start]) * inv[start])
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return t, start, end, h, np.searchsorted(start, bounds)


def parts_for(total_bytes: int, each: float, least: int = 1) -> int:
    return max(least, int(-(-int(total_bytes) // each)))


#: From so many blocks on, blocks and buckets grow with the input, up to so many times their bytes.
PARTS, WIDEST = 256, 4


def widened(total_bytes: int, block: int, *others: int) -> list[int]:
    """Bytes of a block, and of its buckets. Blocks send each bucket a record, so with fixed sizes records, and the pieces of a shuffle, would grow with the square of the input."""
    k = min(WIDEST, max(1.0, total_bytes / (block * PARTS)))
    return [int(k * x) for x in (block, *others)]


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts; one small aggregate."""
    r = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return int(r[0]), int(r[1] or 0)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code: values and counts."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint32)


def cuts_by(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted buckets: their values, and the bounds of their ranges."""
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(bucket))


def bucket_of(name: np.ndarray, n: int) -> np.ndarray:
    """0..n-1 from a name's lower half, evenly."""
    return ((name & U64(0xFFFFFFFF)) * U64(n) >> U64(32)).astype(np.int64)


def packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
