"""Token-ID output (8): files of directly addressable codes, chunk levels with continuation bitmaps and rank directories.

A file: magic, version, counts; for each document (doc_id, null flag, tokens); then for each level the number of
chunks, the chunks of 8 bits, the continuation bitmap in 64-bit words, and the ones before each eighth word. Level 0
holds the lowest 8 bits of every id; a set bit says that the id goes on, at level 1 in place rank(bit).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, doc_columns, give_back, longs, materialise, null_mask, parts_for, qualified, read, shared_dir, text_bytes
from .tokens import encoder, tokenizer_path

MAGIC, VERSION = b"DACTOKEN", 1
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Bytes of text that go to one file.
FILE_TEXT_BYTES = 12 << 20
#: Tasks that read files back; each may read several.
MOST_TASKS = 20_000
SUPER = 8  # words of the bitmap under one entry of the rank directory


def encode_levels(ids: np.ndarray) -> list[bytes]:
    """Level by level: count, chunks, bitmap, rank directory."""
    out, left = [], ids.astype(np.uint32)
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(left) // 64), np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words).astype(np.uint64)
        ranks = np.concatenate(([0], np.cumsum(ones)))[:-1][::SUPER].astype("<u8")
        out += [struct.pack("<Q", len(left)), (left & 0xFF).astype(np.uint8).tobytes(), words.astype("<u8").tobytes(), ranks.tobytes()]
        left = left[more] >> np.uint32(8)
        if not len(left):
            return out


class TokenFile:
    """Reads such a file. token(i) touches one chunk, word and rank entry a level; nothing is decoded in blocks."""

    def __init__(self, data: bytes):
        magic, version, self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<8sIQQI", data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = struct.calcsize("<8sIQQI")
        self.docs = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]), self.n_docs, at)
        at += self.docs.nbytes
        self.starts = np.concatenate(([0], np.cumsum(self.docs["n"].astype(np.int64))))
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            w = -(-n // 64)
            parts, at = [], at + 8
            for dt, m in (("u1", n), ("<u8", w), ("<u8", -(-w // SUPER))):
                parts.append(np.frombuffer(data, dt, m, at))
                at += parts[-1].nbytes
            self.levels.append(tuple(parts))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            w, b = divmod(i, 64)
            if not int(words[w]) >> b & 1:
                break
            s = w // SUPER
            i = int(ranks[s]) + int(np.bitwise_count(words[s * SUPER : w]).sum()) + (int(words[w]) & ((1 << b) - 1)).bit_count()
        return value

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap: a directory entry and at most SUPER words."""
        _, words, ranks = self.levels[level]
        w, b = divmod(i, 64)
        s = w // SUPER
        before = int(ranks[s]) if s < len(ranks) else int(ranks[-1]) + int(np.bitwise_count(words[(len(ranks) - 1) * SUPER :]).sum()) if len(ranks) else 0
        return before + int(np.bitwise_count(words[s * SUPER : w]).sum()) + ((int(words[w]) & ((1 << b) - 1)).bit_count() if b else 0)

    def ids(self, i: int, j: int) -> np.ndarray:
        """Ids i..j-1: of each level only the chunks, words and rank entries that these have are touched."""
        if not 0 <= i <= j <= self.n_tokens:
            raise IndexError((i, j))
        out = self.levels[0][0][i:j].astype(np.uint32)
        at, last = np.arange(len(out)), len(self.levels) - 1
        for k, (_, words, _) in enumerate(self.levels[:last]):
            if i == j:
                break
            bits = np.unpackbits(words[i // 64 : -(-j // 64)].view(np.uint8), bitorder="little")
            at = at[bits[i % 64 : i % 64 + j - i].astype(bool)]
            i = self._rank(k, i)
            j = i + len(at)
            out[at] |= self.levels[k + 1][0][i:j].astype(np.uint32) << np.uint32(8 * k + 8)
        return out

    def document(self, n: int) -> np.ndarray:
        """The ids of the file's n-th document."""
        return self.ids(int(self.starts[n]), int(self.starts[n + 1]))

    def all(self) -> np.ndarray:
        """Every id, a level at a time."""
        out = self.levels[0][0].astype(np.uint32)
        at = np.arange(len(out))
        for k in range(1, len(self.levels)):
            more = np.unpackbits(self.levels[k - 1][1].view(np.uint8), bitorder="little")[: len(self.levels[k - 1][0])].astype(bool)
            at = at[more]
            out[at] |= self.levels[k][0].astype(np.uint32) << np.uint32(8 * k)
        return out


def file_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
    docs = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
    docs["id"], docs["null"], docs["n"] = doc_ids, nulls, counts
    levels = encode_levels(ids)
    return [struct.pack("<8sIQQI", MAGIC, VERSION, len(docs), len(ids), len(levels) // 4), docs.tobytes(), *levels]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, mode: str = "drop", end_id: int = END_ID, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Tokenizes whole texts and writes them in ascending doc_id order (null ids first), in files of about file_text_bytes of text.

    Returns the manifest: part, seq - whose order is that of the files - name, documents, tokens. A task writes under
    names of its own and the manifest names those that count, so tasks can run again. Rows of one doc_id, or of a null
    one, are in the order in which they are read and may fill any number of files and tasks. Null text is empty, repeated
    rows are written each for itself, an empty table gives no file, and other columns don't matter.
    """
    spark, d = docs.sparkSession, doc_columns(docs)
    _, size = text_bytes(d)
    path = qualified(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer, mode), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        fs, where = arrow(path)
        doc_ids, nulls, ids, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            counts = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            fs.create_dir(where, recursive=True)
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            flat = np.frombuffer(b"".join(ids), enc.dtype)
            with fs.open_output_stream(f"{where}/{name}") as f:
                for x in file_bytes(np.array(doc_ids, np.int64), np.array(nulls), counts, flat):
                    f.write(x)
            row = {"part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()), "name": [name], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64())}
            seq, size = seq + 1, 0
            for x in (doc_ids, nulls, ids):
                x.clear()
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for i, z, t in zip(longs(b.column("doc_id")).tolist(), null_mask(b.column("doc_id")).tolist(), b.column("text").to_pylist()):
                doc_ids.append(i)
                nulls.append(z)
                ids.append(enc.encode(t or "") + end)
                size += len(t or "") + 1
                if size >= 2 * file_text_bytes:  # a partition that is larger than its share, or one very long text
                    yield flush()
        if ids:
            yield flush()
        give_back()

    # the row's place in the input splits a doc_id that very many rows have
    placed = d.withColumn("__at", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("__at")]
    ordered = placed.repartitionByRange(parts_for(size, file_text_bytes), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "part long, seq long, name string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32: every document's ids are addressed in the files by their range, without decoding the rest."""
    path = qualified(manifest.sparkSession, path)
    so_far = lambda by, c: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row a partition of the writer is summed in one task, the files of a partition in theirs
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", so_far(Window.orderBy("part"), "all").alias("parts"))
    files = manifest.join(F.broadcast(parts), "part").withColumn("before", (F.col("parts") + so_far(Window.partitionBy("part").orderBy("seq"), "n_tokens")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = arrow(path)
        for b in batches:
            for name, before in zip(b.column("name").to_pylist(), b.column("before").to_pylist()):
                with fs.open_input_file(f"{where}/{name}") as f:
                    t = TokenFile(f.readall())
                crc = [zlib.crc32(t.document(n).astype("<u4").tobytes()) for n in range(t.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.docs["id"].astype(np.int64), mask=t.docs["null"].astype(bool)), pa.array(t.starts[:-1] + before), pa.array(np.diff(t.starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = min(max(1, manifest.count()), MOST_TASKS)
    return files.select("name", "before").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    return read_token_files(write_token_files(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), path), path)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE: dict[str, str] = {}
