"""Packing (10): every document in pieces of power-of-two lengths, pieces of equal length in one bucket."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import numbered
from .common import doc_columns, map_batches, materialise, read
from .tokens import encoder, tokenizer_path

LONGEST = 1024
TOKENIZER = "byte_bpe_50k.json"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The longest as often as it fits, then the binary digits of the rest from the highest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = 0, tokens: bool = False) -> DataFrame:
    """Power-of-two decomposition of whole documents, and equal lengths in one bucket; longest is a power of two.

    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with tokens=True the ids.
    A piece is a sequence by itself, so none crosses documents and none is padded. Rows are sorted into the buckets of
    their lengths, the longest first, there by doc_id, start and ids, and sequence_id counts them in that order:
    a bucket is a range of sequences, and partitioning doesn't change it. write_buckets() stores a folder for each.
    Null or empty text: the end id alone. Repeated rows and null ids, which come first, are packed each for itself;
    other columns don't matter, and an empty table has no pieces.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if tokens else "")

    def make():
        enc = encoder(tokenizer, "space")

        def run(batch: pa.RecordBatch):
            row, start, length, crc, total, ids_out = [], [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                ids = np.frombuffer(enc.encode(t or ""), enc.dtype).astype("<u4")
                ids = np.append(ids, np.uint32(end_id))
                raw, at = memoryview(ids.tobytes()), 0
                for n in lengths(len(ids), longest):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(ids))
                    if tokens:
                        ids_out.append(ids[at : at + n].astype(np.int32))
                    at += n
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if tokens:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

        return run

    # written before they are sorted, as sorting by range reads its input twice and would tokenize twice
    pieces = materialise(map_batches(doc_columns(docs), make, schema), "pieces")
    order = [F.desc("length"), F.asc_nulls_first("doc_id"), F.asc("start"), F.asc("ids_crc32"), F.asc("doc_tokens")]
    return numbered(pieces, order, "sequence_id").withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so that a reader takes batches of one shape."""
    packed.write.partitionBy("length").parquet(path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
