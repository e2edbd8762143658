"""WARC (7): archives written from pages and read back, each capture's records joined through WARC-Concurrent-To."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, map_batches, materialise, qualified, read, shared_dir

#: Smaller equal payloads are stored again rather than revisited.
REVISIT_BYTES = 1000
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Records are handed on once their blocks hold so many bytes.
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, content_type string, "
    "payload_digest string, block_bytes long, payload_bytes long, payload_sha1 string, page_id long, page_null boolean, stated_bytes long"
)
#: What a record holds besides, by read_archives(blocks=True).
_CONTENT = "headers array<struct<name:string,value:string>>, block binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """One record as a gzip member of its own, so that readers can start at any."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def capture(key: str, date: str, uri: str, page: int | None, payload: bytes, refers: tuple[str, str] | None, level: int = 1) -> bytes:
    """Request, response or revisit, and metadata of one capture. The request and the metadata name the response's id as concurrent. refers: record id of the response that a revisit repeats, and its page."""
    ids = {k: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{k}')}>" for k in ("request", "response", "metadata")}
    clean = re.sub(r"[\x00-\x20\x7f]+", "%20", uri or "about:blank")
    path = re.sub(r"^[a-z]+://[^/]*", "", clean) or "/"
    host = (re.match(r"[a-z]+://([^/]*)", clean) or ["", ""])[1]
    common = lambda kind, own, mime: [("WARC-Type", kind), ("WARC-Record-ID", ids[own]), ("WARC-Date", date), ("WARC-Target-URI", clean), ("Content-Type", mime)]
    digest = f"sha1:{hashlib.sha1(payload).hexdigest()}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = common("revisit" if refers else "response", "response", "application/http; msgtype=response") + [("WARC-Payload-Digest", digest)]
    if refers:
        main += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0])]
    meta = f"page-id: {'' if page is None else page}\r\npayload-bytes: {len(payload)}\r\n".encode()
    return b"".join(
        (
            record(common("request", "request", "application/http; msgtype=request") + [("WARC-Concurrent-To", ids["response"])], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), level),
            record(main, http if refers else http + payload, level),
            record(common("metadata", "metadata", "application/warc-fields") + [("WARC-Concurrent-To", ids["response"])], meta, level),
        )
    )


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of every record, of gzip members or plain text."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            z, parts = zlib.decompressobj(31), []
            while not z.eof:  # in small steps, as what follows the member is copied each time
                if at >= len(data):
                    raise ValueError("the archive ends within a record")
                step = view[at : at + 16_384]
                parts.append(z.decompress(step))
                at += len(step)
            at -= len(z.unused_data)
            yield from parse(b"".join(parts))
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        head = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head)]
        size = int(next(v for k, v in headers if k.lower() == "content-length"))
        if end + 4 + size > len(data):
            raise ValueError("the archive ends within a block")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + (4 if data[end + 4 + size : end + 8 + size] == b"\r\n\r\n" else 0)


def _row(headers: list[tuple[str, str]], block: bytes) -> tuple:
    h: dict[str, str] = {}
    concurrent = []
    for k, v in headers:
        if k.lower() == "warc-concurrent-to":
            concurrent.append(v)
        h[k.lower()] = v
    kind, payload = h.get("warc-type", ""), block
    if h.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    page = stated = None
    null = False
    if kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
        null = fields.get("page-id") == ""
        page = int(fields["page-id"]) if fields.get("page-id") else None
        stated = int(fields["payload-bytes"]) if "payload-bytes" in fields else None
    return (
        h.get("warc-record-id"), kind, concurrent, h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"),
        h.get("warc-payload-digest"), len(block), len(payload), hashlib.sha1(payload).hexdigest(), page, null, stated,
    )



def _fields(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return p.withColumns({"bytes": F.octet_length("html").cast("long"), "sha": F.sha1("html")})


def write_archives(pages: DataFrame, path: str, date: str | None = None, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Writes request, response or revisit and metadata records for every row of pages, and returns the manifest (name, captures, bytes).

    Of rows with equal payloads of at least revisit_bytes, that of the largest page_id holds the response and the others
    revisit it; a null page_id is the smallest. Rows that repeat page_id and payload are captures of their own, and of
    several with the largest page_id all are responses and one of them is revisited. Null html is empty. A task names its archives anew and the manifest names those that count, so tasks can run again.
    """
    date = date or datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    p, path = _fields(pages), qualified(pages.sparkSession, path)
    # digests that occur once, and rows with the largest id, need nothing from others: only the rest is joined
    each = p.where(F.col("bytes") >= revisit_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("same"))
    large = each.groupBy("sha").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "same"))).alias("k"), F.sum("same").alias("n")).where("n > 1 and k is not null")
    # a payload that very many rows share would be one task's: those above a thousandth of all rows are at most a thousand
    large = materialise(large.select("sha", F.struct(F.col("k.page_id").alias("keeper"), F.col("k.same").alias("same")).alias("k"), "n"), "digests")
    many = max(1000, pages.count() // 1000)
    hot = F.broadcast(large.where(F.col("n") > many).select("sha", F.col("k").alias("k1")))
    cold = large.where(F.col("n") <= many).select("sha", F.col("k").alias("k2"))
    ready = p.join(hot, "sha", "left")
    if not cold.limit(1).count():
        ready = ready.withColumn("k", F.col("k1"))
    else:
        ready = ready.join(cold, "sha", "left").withColumn("k", F.coalesce("k1", "k2"))
    ready = ready.select(
        "page_id", "url", "html", "sha", F.when((F.col("bytes") >= revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("k.keeper"))), F.col("k.keeper")).alias("refers"),
        F.coalesce(F.col("page_id") == F.col("k.keeper"), F.lit(False)).alias("held"), F.coalesce("k.same", F.lit(1)).alias("same"),
    )
    if large.where("k.same > 1").limit(1).count():
        # several rows could hold the response: one of them is named for it
        cols = ["page_id", "url", "html", "sha", "refers"]
        some = materialise(ready.where("held and same > 1").select(*cols, F.expr("uuid()").alias("own")), "repeats")
        named = some.groupBy("sha").agg(F.min("own").alias("own")).withColumn("named", F.lit(True))
        some = some.join(named, ["sha", "own"], "left").select(*cols, F.coalesce("named", F.lit(False)).alias("held"))
        ready = ready.where("not (held and same > 1)").select(*cols, "held").unionByName(some)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = arrow(path)
        fs.create_dir(where, recursive=True)
        out, name, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("page_id", "url", "sha", "refers", "held")]
            html = pc.fill_null(b.column("html"), "").cast(pa.binary()).to_pylist()
            for page, url, sha, refers, held, payload in zip(*cols, html):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{where}/{name}", compression=None)
                    first = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    out.write(first)
                # only the response that others revisit is named by what it holds: rows that repeat a page_id and payload are captures of their own
                key = f"{page}/{sha}" if held else f"{page}/{sha}/{uuid.uuid4()}"
                to = None if refers is None else (f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers}/{sha}/response')}>", str(refers))
                data = capture(key, date, url, page, payload, to, level)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["name", "captures", "bytes"])

    return materialise(ready.mapInArrow(write, "name string, captures long, bytes long"), "archives")


def read_archives(manifest: DataFrame, path: str, blocks: bool = False) -> DataFrame:
    """A row for each record of the manifest's archives, payloads digested where they are read.

    With blocks=True a record also has all its headers, in their order, and its whole block, so that assemble() nests
    whole records and payloads() gives back what was written; without, its block isn't moved.
    """
    path = qualified(manifest.sparkSession, path)

    def run(batch: pa.RecordBatch):
        fs, where = arrow(path)
        types = [pa.string(), pa.string(), pa.list_(pa.string())] + [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.bool_(), pa.int64()]
        names = [x.split()[0] for x in _RECORD.split(", ")]
        if blocks:
            types += [pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
            names += ["headers", "block"]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for name in batch.column("name").to_pylist():
            with fs.open_input_stream(f"{where}/{name}", compression=None) as f:
                data = f.read()
            rows, held = [], 0
            for h, b in parse(data):
                rows.append((*_row(h, b), [{"name": k, "value": v} for k, v in h], b) if blocks else _row(h, b))
                held += len(b) if blocks else 0
                if held >= BATCH_BYTES:
                    yield give(rows)
                    rows, held = [], 0
            if rows:
                yield give(rows)

    n = max(1, manifest.count())
    return map_batches(manifest.select("name").repartition(n), lambda: run, f"{_RECORD}, {_CONTENT}" if blocks else _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture, with its request, main record (response or revisit) and metadata nested.

    A record belongs to the response or revisit that it names as concurrent, or that the record it names names. A
    response without others has nulls for them; several of one kind: the least id stands. Records that lead to no
    response or revisit, and warcinfo records, aren't captures. A revisit refers to the capture that holds the response.
    """
    main = records.where("type in ('response', 'revisit')")
    other = records.where("type in ('request', 'metadata')").withColumn("to", F.explode("concurrent_to"))
    ids = main.select(F.col("record_id").alias("main_id")).distinct()
    direct = other.join(ids, other["to"] == ids["main_id"]).drop("to")
    # a metadata record may name the request, and that the response
    rest = other.join(ids, other["to"] == ids["main_id"], "left_anti")
    step = direct.select(F.col("record_id").alias("mid"), "main_id")
    indirect = rest.join(step, rest["to"] == step["mid"]).drop("to", "mid")
    fields = [c for c in records.columns]
    every = main.withColumn("main_id", F.col("record_id")).select(*fields, "main_id").unionByName(direct.select(*fields, "main_id")).unionByName(indirect.select(*fields, "main_id"))
    rec = F.struct("record_id", *[c for c in fields if c != "record_id"])
    pick = lambda *k: F.min(F.when(F.col("type").isin(*k), rec))
    return every.groupBy("main_id").agg(pick("request").alias("request"), pick("response", "revisit").alias("main"), pick("metadata").alias("metadata"))


def captures(nested: DataFrame) -> DataFrame:
    """The digest of assembled captures: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest are those of the payload that was read; a revisit's payload is that of the response it refers to.
    Where the archives lack that response, they are what the revisit and its metadata state.
    """
    c = nested.select(
        F.col("metadata.page_id").alias("page_id"), "main_id", F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to"), F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_sha1").alias("payload_digest"), F.col("metadata.stated_bytes").alias("stated_bytes"), F.regexp_replace("main.payload_digest", "^sha1:", "").alias("stated_digest"),
    )
    held = c.where("record_type = 'response'").select(F.col("main_id").alias("held_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    plain = c.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    back = c.where("record_type = 'revisit'").join(held, F.col("to") == F.col("held_id"), "left").withColumns({"payload_bytes": F.coalesce("held_bytes", "stated_bytes"), "payload_digest": F.coalesce("held_digest", "stated_digest")})
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*cols).unionByName(back.select(*cols))


def payloads(nested: DataFrame) -> DataFrame:
    """What captures assembled from records with blocks hold: page_id, main_id, uri and the whole payload, a revisit's from the response it refers to, or null where the archives lack that."""
    block = F.col("main.block")
    head = F.locate("\r\n\r\n", F.decode(block, "ISO-8859-1"))  # a character a byte
    http = F.coalesce(F.col("main.content_type"), F.lit("")).startswith("application/http")
    payload = F.when(~http, block).when(head > 0, F.substring(block, head + 4, F.octet_length(block))).otherwise(F.lit("").cast("binary"))
    c = nested.select(F.col("metadata.page_id").alias("page_id"), "main_id", F.col("main.uri").alias("uri"), F.col("main.type").alias("type"), F.col("main.refers_to").alias("to"), payload.alias("payload"))
    plain, back = c.where("type = 'response'"), c.where("type = 'revisit'").drop("payload")
    held = plain.select(F.col("main_id").alias("held_id"), "payload")
    cols = ["page_id", "main_id", "uri", "payload"]
    return plain.select(*cols).unionByName(back.join(held, F.col("to") == F.col("held_id"), "left").select(*cols))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    # the records are small without their payloads, and the joins read them several times
    records = materialise(read_archives(write_archives(read(spark, sf_dir, "pages"), path), path), "records")
    return captures(materialise(assemble(records), "captures"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM p LEFT JOIN k ON p.d = k.d AND n >= {REVISIT_BYTES}
"""
QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": SQL}
