"""Files on every file system that Spark reaches - by Python where they are local, else through Hadoop on the driver and Arrow in tasks - and tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Schemes of Spark's for which Arrow has another name.
_ARROW = {"s3a": "s3", "s3n": "s3"}
#: Bytes of files that the driver hashes by itself rather than in tasks.
DRIVER_BYTES = 64 << 20
_from_uri = pafs.FileSystem.from_uri
_MADE: list[str] = []
_ROOTS: list[str] = []
_OWNER = os.getpid()  # a fork has the lists too, but deletes nothing


def local(path: str) -> str | None:
    """The plain path of a local one, None for others. A path without a scheme is local unless Spark's default file system isn't."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark would give it, so that tasks open what the driver means."""
    _, p, fs = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def arrow(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and its path; in tasks and on the driver."""
    where = local(path)
    if where is not None:
        return pafs.LocalFileSystem(), where
    scheme, _, rest = path.partition("://")
    return _from_uri(f"{_ARROW.get(scheme, scheme)}://{rest}")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(str(path))
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def exists(path: str) -> bool:
    where = local(path)
    if where is not None:
        return os.path.exists(where)
    _, p, fs = _hadoop(_session(), path)
    return fs.exists(p)


def read_bytes(path: str) -> bytes:
    """A small file's content, such as a manifest's."""
    where = local(path)
    if where is not None:
        with open(where, "rb") as f:
            return f.read()
    jvm, p, fs = _hadoop(_session(), path)
    s = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(s))
    finally:
        s.close()


def write_bytes(path: str, data: bytes) -> None:
    """Whole or not at all: written aside and renamed over what is there."""
    where = local(path)
    if where is not None:
        os.makedirs(os.path.dirname(where) or ".", exist_ok=True)
        tmp = f"{where}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, where)
        return
    spark = _session()
    jvm, p, fs = _hadoop(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(data)
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, over)


def delete(path: str) -> None:
    where = local(path)
    if where is not None:
        shutil.rmtree(where) if os.path.isdir(where) else os.path.exists(where) and os.remove(where)
        return
    _, p, fs = _hadoop(_session(), path)
    fs.delete(p, True)


def copy(source: str, target: str) -> None:
    """A whole folder, by the driver's file system; target is new."""
    a, b = local(source), local(target)
    if a is not None and b is not None:
        shutil.copytree(a, b)
        return
    spark = _session()
    jvm, p, fs = _hadoop(spark, source)
    _, q, to = _hadoop(spark, target)
    to.mkdirs(q.getParent())
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} wasn't copied to {target}")


def files(folder: str) -> list[tuple[str, int]]:
    """Names below folder with their sizes, in order; hidden ones and markers, of which names begin with . or _, are left out."""
    where, out = local(folder), []
    if where is not None:
        for root, _, names in os.walk(where):
            out += [(os.path.relpath(f"{root}/{n}", where), os.path.getsize(f"{root}/{n}")) for n in names]
    else:
        _, p, fs = _hadoop(_session(), folder)
        base, it = fs.makeQualified(p).toString().rstrip("/") + "/", fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString().removeprefix(base), s.getLen()))
    return sorted(x for x in out if not x[0].rsplit("/", 1)[-1].startswith((".", "_")))


def names(folder: str, ending: str = "") -> list[str]:
    """What lies in the folder itself under names with that ending, in order; none if there is no folder."""
    if not exists(folder):
        return []
    where = local(folder)
    if where is not None:
        return sorted(n for n in os.listdir(where) if n.endswith(ending))
    _, p, fs = _hadoop(_session(), folder)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(ending))


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in parts wherever this runs."""
    fs, where = arrow(path)
    h = hashlib.sha256()
    with fs.open_input_stream(where, compression=None) as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def folder_digests(folder: str) -> list[tuple[str, int, str]]:
    """(name, bytes, SHA-256) of every file of a folder. What is more than DRIVER_BYTES is hashed in tasks; only names and digests reach the driver."""
    found = files(folder)
    if sum(n for _, n in found) <= DRIVER_BYTES:
        return [(x, n, file_digest(f"{folder}/{x}")) for x, n in found]
    spark = _session()
    root = qualified(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size in zip(b.column("name").to_pylist(), b.column("size").to_pylist()):
                yield pa.RecordBatch.from_pydict({"name": [name], "size": pa.array([size], pa.int64()), "sha256": [file_digest(f"{root}/{name}")]})

    todo = spark.createDataFrame(found, "name string, size long").repartition(min(len(found), 4096))
    return sorted((r.name, r.size, r.sha256) for r in todo.mapInArrow(run, "name string, size long, sha256 string").collect())


def folder_digest(folder: str) -> str:
    """SHA-256 of the names and digests of a folder's files, in order of names."""
    h = hashlib.sha256()
    for name, _, sha in folder_digests(str(folder)):
        h.update(f"{name}\0{sha}\n".encode())
    return h.hexdigest()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's name under spark.checkpoint.dir, which every executor sees.

    Where that is unset, a session on this machine alone gets a folder of its own, and one on a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _ROOTS:  # the setting itself can't be made in a running session
            _ROOTS.append(f"file://{tempfile.mkdtemp(prefix='spanvec-')}")
        root = _ROOTS[0]
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release() -> None:
    """Deletes every folder of shared_dir(); results that are still to be read from them are lost. It runs when the program ends."""
    while os.getpid() == _OWNER and (_MADE or _ROOTS):
        path = _MADE.pop() if _MADE else _ROOTS.pop()
        try:
            if local(path) is not None or SparkSession.getActiveSession():
                delete(path)
        except Exception as e:  # noqa: BLE001 - a program that ends has no session to tell
            print(f"{path} is left: {e}")


atexit.register(release)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder; a lost executor doesn't lose it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Shuffle files that no plan needs are deleted soon, rather than when the driver happens to collect its garbage. Python tells of what it dropped within a second, so plans dropped earlier are meant."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
