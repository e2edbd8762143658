"""The binary pack: 72-byte header, centroids, lists of ids and half vectors, offset table. Reader, writer and a Spark source.

Little-endian: magic u64, then version, endian, header size, dim, metric, n_lists, n_vectors as u32, the offset table's
position as u64, zeros to 72 bytes; centroids f32; for each list a count u32, ids u64 and vectors f16; the table holds
(offset u64, length u64) a list.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .storage import arrow, delete, materialise, qualified

MAGIC, SIZE = 0x504E4E41, 72
_HEAD = struct.Struct("<QIIIIIIIQ")
MAX_DIM, MAX_LISTS, MAX_LIST_BYTES = 4096, 1_000_000, 4 << 30
#: Bytes of lists that one task reads; a longer list is read by several.
TASK_BYTES = 64 << 20
FIELDS = ("magic", "version", "endian", "header_size", "dim", "metric", "n_lists", "n_vectors", "offset_table_pos")


def _open(path: str):
    fs, where = arrow(path)
    return fs.open_input_file(where)


def check_header(h: dict, file_size: int) -> dict:
    """The header, if every reader's conditions hold."""
    bad = [
        name
        for name, ok in (
            ("magic", h["magic"] == MAGIC), ("version", h["version"] == 1), ("endian", h["endian"] == 1), ("header_size", h["header_size"] == SIZE),
            ("dim", 1 <= h["dim"] <= MAX_DIM), ("metric", h["metric"] == 1), ("n_lists", 1 <= h["n_lists"] <= MAX_LISTS),
            ("offset_table_pos", h["offset_table_pos"] > 0 and h["offset_table_pos"] + 16 * h["n_lists"] <= file_size),
        )
        if not ok
    ]
    if bad:
        raise ValueError(f"not a pack: wrong {', '.join(bad)}")
    return h


def read_header(path: str) -> dict:
    with _open(path) as f:
        size = f.size()
        raw = f.read(_HEAD.size)
    if len(raw) < _HEAD.size:
        raise ValueError("not a pack: too short")
    return check_header(dict(zip(FIELDS, _HEAD.unpack(raw))), size)


def read_centroids(path: str) -> np.ndarray:
    h = read_header(path)
    with _open(path) as f:
        return np.frombuffer(f.read_at(4 * h["n_lists"] * h["dim"], SIZE), "<f4").reshape(h["n_lists"], h["dim"]).astype(np.float64)


def read_offsets(path: str) -> list[tuple[int, int]]:
    h = read_header(path)
    with _open(path) as f:
        return [tuple(map(int, r)) for r in np.frombuffer(f.read_at(16 * h["n_lists"], h["offset_table_pos"]), "<u8").reshape(-1, 2)]


def read_list(path: str, offset: int, length: int, dim: int, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of one list by its byte range, or of its rows start to stop. A list that is empty, too short for its count, or over 4 GB has none."""
    none = np.zeros(0, np.int64), np.zeros((0, dim))
    if not 4 <= length <= MAX_LIST_BYTES:
        return none
    with _open(path) as f:
        head = f.read_at(4, offset)
        n = struct.unpack("<I", head)[0] if len(head) == 4 else 0
        if not n or 4 + 8 * n + 2 * n * dim > min(length, f.size() - offset):
            return none
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return none
        ids = np.frombuffer(f.read_at(8 * (stop - start), offset + 4 + 8 * start), "<u8")
        v = np.frombuffer(f.read_at(2 * dim * (stop - start), offset + 4 + 8 * n + 2 * dim * start), "<f2")
    if (ids >= 1 << 63).any():
        raise ValueError("an id of 2^63 or more")
    return ids.astype(np.int64), v.reshape(-1, dim).astype(np.float64)


def vector_array(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))


class _Part(InputPartition):
    """Lists, or rows of one, that a task reads: (list, offset, length, start, stop)."""

    def __init__(self, lists: list[tuple[int, int, int, int, int | None]]):
        self.lists = lists


class _Reader(DataSourceReader):
    def __init__(self, path: str, lists: set[int] | None, centroids: bool):
        self.path, self.lists, self.centroids = path, lists, centroids
        h = read_header(path)
        self.dim, self.n_lists = h["dim"], h["n_lists"]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that name lists decide which are read; all are given back, as Spark checks them again at no cost."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("list_id",):
                self.lists = named if self.lists is None else self.lists & named
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.centroids:
            return [_Part([(i, 0, 0, i, min(i + 4096, self.n_lists))]) for i in range(0, self.n_lists, 4096)]
        out, held, size = [], [], 0
        for i, (o, n) in enumerate(read_offsets(self.path)):
            if self.lists is not None and i not in self.lists:
                continue
            if n > TASK_BYTES:
                rows = TASK_BYTES // (8 + 2 * self.dim)
                out += [_Part([(i, o, n, k, k + rows)]) for k in range(0, (n - 4) // (8 + 2 * self.dim) + 1, rows)]
                continue
            held.append((i, o, n, 0, None))
            size += n
            if size >= TASK_BYTES:
                out.append(_Part(held))
                held, size = [], 0
        return out + ([_Part(held)] if held else [])

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to read no partition
            return
        for i, o, n, start, stop in partition.lists:
            if self.centroids:
                with _open(self.path) as f:
                    c = np.frombuffer(f.read_at(4 * self.dim * (stop - start), SIZE + 4 * self.dim * start), "<f4").reshape(-1, self.dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), vector_array(c.astype(np.float64))], ["list_id", "c"])
                continue
            ids, v = read_list(self.path, o, n, self.dim, start, stop)
            for k in range(0, len(ids), 4096):
                part = v[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(ids[k : k + 4096]), vector_array(part)], ["list_id", "id", "v"])


class PackSource(DataSource):
    """spark.read.format("spanpack").option("path", p).load(): tasks read lists of some TASK_BYTES. Option lists="0,3", or a filter on list_id, reads those alone; option table="centroids" reads the centroids."""

    @classmethod
    def name(cls) -> str:
        return "spanpack"

    def schema(self) -> str:
        return "list_id long, c array<double>" if self.options.get("table") == "centroids" else "list_id long, id long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        lists = self.options.get("lists")
        return _Reader(self.options["path"], {int(x) for x in lists.split(",") if x} if lists is not None else None, self.options.get("table") == "centroids")


def _source(spark: SparkSession, path: str):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)
    return spark.read.format("spanpack").option("path", qualified(spark, path))


def read_pack(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """list_id, id, v of all lists or of some."""
    r = _source(spark, path)
    return (r if lists is None else r.option("lists", ",".join(map(str, lists)))).load()


def pack_centroids(spark: SparkSession, path: str) -> DataFrame:
    """list_id, c as a table."""
    return _source(spark, path).option("table", "centroids").load()


def write_pack(vectors: DataFrame, centroids: DataFrame, path: str) -> dict:
    """Writes vectors (list_id, id, v) and centroids (list_id, c) as one file, list by list, each in the order of its ids.

    Tasks write the rows of their range of (list, id), as bytes; the driver only strings ranges of bytes together, which
    one file asks for, and knows a row for each list and task. A list beyond 4 GB, which no reader takes, is an error, as
    are negative ids and lists without a centroid. Lists without vectors are empty.
    """
    spark, path = vectors.sparkSession, qualified(vectors.sparkSession, path)
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    ordered = vectors.select(F.col("list_id").cast("long").alias("list_id"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).repartitionByRange("list_id", "id").sortWithinPartitions("list_id", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = arrow(folder)
        name, out, rows, wide = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, [], 0
        for b in batches:
            lists, ids = b.column("list_id").to_numpy(), b.column("id").to_numpy()
            if not len(ids):
                continue
            if ids.min() < 0:
                raise ValueError("ids must not be negative")
            if out is None:
                fs.create_dir(where, recursive=True)
                out = [fs.open_output_stream(f"{where}/{name}.{k}", compression=None) for k in ("ids", "vectors")]
            v = b.column("v").flatten().to_numpy().astype("<f2")
            wide = wide or len(v) // len(ids)
            if len(v) != wide * len(ids):
                raise ValueError("vectors of several lengths")
            out[0].write(ids.astype("<u8").tobytes())
            out[1].write(v.tobytes())
            cut = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True])))
            for i, j in zip(cut[:-1], cut[1:]):
                if rows and rows[-1][0] == lists[i]:
                    rows[-1][1] += int(j - i)
                else:
                    rows.append([int(lists[i]), int(j - i)])
        for f in out or ():
            f.close()
        if rows:
            n = [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array([r[0] for r in rows]), pa.array(np.cumsum(n) - n), pa.array(n, pa.int64()), pa.array([wide] * len(rows), pa.int64())], ["name", "list_id", "first", "n", "dim"]
            )

    parts = materialise(ordered.mapInArrow(run, "name string, list_id long, first long, n long, dim long"), "pack-parts")
    wrote: dict[int, list] = {}
    for r in parts.orderBy("name", "first").collect():  # names begin with the task's number, so ids ascend
        wrote.setdefault(r.list_id, []).append(r)
    fs, where = arrow(path)
    _, inside = arrow(folder)
    opened: dict[str, object] = {}

    def copy(out, name: str, start: int, size: int) -> None:
        f = opened.setdefault(name, None) or fs.open_input_file(f"{inside}/{name}")
        opened[name] = f
        while size:
            part = f.read_at(min(size, 4 << 20), start)
            out.write(part)
            start, size = start + len(part), size - len(part)

    lists, dim = [], None
    with fs.open_output_stream(f"{where}.centroids", compression=None) as out:
        for r in centroids.select("list_id", "c").orderBy("list_id").toLocalIterator():
            lists.append(r.list_id)
            dim = dim or len(r.c)
            out.write(np.array(r.c, "<f4").tobytes())
    lost = set(wrote) - set(lists)
    if lost or dim is None:
        raise ValueError(f"no centroid for list {min(lost)}" if lost else "there are no centroids")
    if {r.dim for rows in wrote.values() for r in rows} - {dim}:
        raise ValueError(f"vectors must have {dim} numbers")
    n, table, at = sum(r.n for rows in wrote.values() for r in rows), [], SIZE + 4 * len(lists) * dim
    for k in lists:
        own = sum(r.n for r in wrote.get(k, ()))
        size = 4 + own * (8 + 2 * dim) if own else 0
        if size > MAX_LIST_BYTES or own >= 1 << 32:
            raise ValueError(f"list {k} would have {size} bytes; a list has at most {MAX_LIST_BYTES}")
        table.append((at, size))
        at += size
    if n >= 1 << 32:
        raise ValueError("a pack has fewer than 2^32 vectors; write several")
    with fs.open_output_stream(where, compression=None) as out:
        out.write(_HEAD.pack(MAGIC, 1, 1, SIZE, dim, 1, len(lists), n, at).ljust(SIZE, b"\0"))
        with fs.open_input_stream(f"{where}.centroids", compression=None) as f:
            while part := f.read(4 << 20):
                out.write(part)
        for k in lists:
            if k in wrote:
                out.write(struct.pack("<I", sum(r.n for r in wrote[k])))
                for kind, wide in (("ids", 8), ("vectors", 2 * dim)):
                    for r in wrote[k]:
                        copy(out, f"{r.name}.{kind}", wide * r.first, wide * r.n)
                for name in [x for x in opened if not any(x.startswith(r.name) for r in wrote[k][-1:])]:
                    opened.pop(name).close()
        out.write(np.array(table, "<u8").tobytes())
    for f in opened.values():
        f.close()
    delete(f"{path}.centroids")
    delete(folder)
    return {"dim": dim, "n_lists": len(lists), "n_vectors": n, "offset_table_pos": at}


def verify_pack(path: str, deep: bool = False) -> dict:
    """The header with the file's size, after the table's entries - and with deep each list's count, in tasks - are checked."""
    h = read_header(path)
    with _open(path) as f:
        size = f.size()
    table = read_offsets(path)
    for i, (o, n) in enumerate(table):
        if n and o + n > size:
            raise ValueError(f"list {i} ends beyond the file")
    if deep:
        spark, where, dim = SparkSession.getActiveSession(), qualified(SparkSession.getActiveSession(), path), h["dim"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts, short = [], []
                with _open(where) as f:
                    for o, n in zip(b.column("offset").to_pylist(), b.column("length").to_pylist()):
                        count = struct.unpack("<I", f.read_at(4, o))[0] if n >= 4 else 0
                        counts.append(count)
                        short.append(0 < n < 4 or count > 0 and 4 + count * (8 + 2 * dim) > n)
                yield pa.RecordBatch.from_arrays([b.column("list_id"), pa.array(counts, pa.int64()), pa.array(short)], ["list_id", "n", "short"])

        lists = spark.createDataFrame([(i, o, n) for i, (o, n) in enumerate(table)], "list_id long, offset long, length long").where("length > 0")
        r = lists.mapInArrow(run, "list_id long, n long, short boolean").agg(F.min(F.when(F.col("short"), F.col("list_id"))), F.coalesce(F.sum("n"), F.lit(0))).first()
        if r[0] is not None:
            raise ValueError(f"list {r[0]} is too short for its count")
        if r[1] != h["n_vectors"]:
            raise ValueError(f"{r[1]} vectors where the header says {h['n_vectors']}")
    return h | {"file_size": size}


def offsets_table(spark: SparkSession, path: str) -> DataFrame:
    size = verify_pack(path)["file_size"]
    rows = [(i, o, n, size) for i, (o, n) in enumerate(read_offsets(path))]
    return spark.createDataFrame(rows, "list_id long, offset long, length long, file_size long").orderBy(F.col("list_id"))
