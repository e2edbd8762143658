import gzip
import hashlib

import pytest

from spanvec.llm import warc

BIG, SMALL = "<p>é" + "x" * 1200, "tiny"
PAGES = [(1, "http://a.b/c d?é", BIG), (2, "http://a.b/", BIG), (9, None, BIG), (9, "u", BIG), (None, "http://n/", BIG), (3, "http://s/", SMALL), (4, "http://s/", SMALL), (5, "http://z/", None), (6, "http://z/", ""), (7, "x", "only" * 500), (8, "y\r\nX: 1", "a\r\n\r\nWARC/1.1\r\n" * 100)]


@pytest.mark.parametrize("hot", [False, True])
def test_round_trip(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("builtins.max", lambda *a, _max=max: 1 if a[:1] == (1000,) else _max(*a))
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha string")
    man = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=1500)
    assert man.count() > 1
    monkeypatch.undo()
    records = warc.read_archives(man, f"file://{tmp_path}/w")
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"warcinfo": man.count(), "request": 11, "response": 8, "revisit": 3, "metadata": 11}
    nested = warc.assemble(records)
    got = sorted((tuple(r) for r in warc.captures(nested).collect()), key=str)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        back = html == BIG and page != 9
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if back else "response", 9 if back else None))
    assert nested.count() == len(PAGES)
    # the two rows of page 9 share page_id and payload, and are a capture each
    assert got == sorted(want, key=str)
    for f in (tmp_path / "w").iterdir():
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\nWARC-Type") >= 4


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_rows_are_captures_of_their_own(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("builtins.max", lambda *a, _max=max: 1 if a[:1] == (1000,) else _max(*a))
    rows = [*PAGES, (9, "u", BIG), (2, "http://a.b/", BIG), (4, "http://s/", SMALL), (4, "other", SMALL), (7, "x", "only" * 500), (5, "http://z/", None)]
    rows += [(None, "n", None), (None, "n", None), (None, "m", ""), (None, "n", SMALL), (None, "n", SMALL), (None, "n", "null" * 500), (None, "n", "null" * 500), (None, "http://n/", BIG)]
    man = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", archive_bytes=1500)
    monkeypatch.undo()
    records = warc.read_archives(man, f"file://{tmp_path}/w").where("type <> 'warcinfo'").cache()
    assert records.count() == records.select("record_id").distinct().count() == 3 * len(rows)
    nested = warc.assemble(records).cache()
    key = lambda page, html: (page, len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    want = [(*key(page, html), *(("revisit", 9) if html == BIG and page != 9 else ("response", None))) for page, _, html in rows]
    assert sorted(map(tuple, warc.captures(nested).collect()), key=str) == sorted(want, key=str)
    uris = [(r.page, r.uri) for r in nested.selectExpr("metadata.page_id page", "main.uri uri").collect()]
    clean = lambda u: "".join("%20" if c == " " else c for c in (u or "about:blank").replace("\r\n", " "))
    assert sorted(uris, key=str) == sorted(((page, clean(u)) for page, u, _ in rows), key=str)


def test_indirect_and_foreign_records(spark, tmp_path):
    text = b"".join(
        f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <{i}>\r\n{''.join(f'WARC-Concurrent-To: <{c}>' + chr(13) + chr(10) for c in cs)}Content-Length: {len(b)}\r\n\r\n{b}\r\n\r\n".encode()
        for k, i, cs, b in [("warcinfo", "w", [], "x: y"), ("response", "r", [], "body"), ("request", "q", ["r"], "GET"), ("metadata", "m", ["q"], "page-id: 4\r\npayload-bytes: 4"), ("metadata", "lost", ["nowhere"], ""), ("response", "alone", [], "")]
    )
    names = [x.split()[0] for x in warc._RECORD.split(", ")]
    rows = [warc._row(h, b) for h, b in warc.parse(text)]
    got = {r.main_id: r for r in warc.assemble(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert len(names) == 14 and set(got) == {"<r>", "<alone>"}
    assert got["<r>"].request.record_id == "<q>" and got["<r>"].metadata.page_id == 4 and got["<alone>"].request is None
    with pytest.raises(ValueError):
        list(warc.parse(text[:-20] + b"Content"))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    man = warc.write_archives(empty, f"{tmp_path}/none")
    assert warc.captures(warc.assemble(warc.read_archives(man, f"{tmp_path}/none"))).count() == 0


@pytest.mark.parametrize("size", [1, 8 << 20])
def test_whole_records_and_payloads_come_back(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "BATCH_BYTES", size)
    man = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"file://{tmp_path}/w", archive_bytes=1500)
    records = warc.read_archives(man, f"file://{tmp_path}/w", blocks=True)
    stored = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse(f.read_bytes())]
    assert sorted(([(x.name, x.value) for x in r.headers], bytes(r.block)) for r in records.collect()) == sorted(stored)
    nested = warc.assemble(records)
    assert all(bytes(r.request.block).startswith(b"GET ") and b"page-id: " in bytes(r.metadata.block) for r in nested.collect())
    got = sorted(((r.page_id, bytes(r.payload)) for r in warc.payloads(nested).collect()), key=str)
    assert got == sorted(((page, (html or "").encode()) for page, _, html in PAGES), key=str)


def test_a_revisit_has_the_payload_that_was_read(spark):
    def rec(kind, own, block, *more):
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), *more]
        return warc._row(head, block)

    http, digest = ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:stated")
    meta = lambda own, to, page: rec("metadata", own, f"page-id: {page}\r\npayload-bytes: 77".encode(), ("WARC-Concurrent-To", to))
    rows = [
        rec("response", "r", b"HTTP/1.1 200 OK\r\n\r\nbody", http, digest), meta("m", "r", 9), rec("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", http, digest, ("WARC-Refers-To", "r")), meta("n", "v", 4),
        rec("revisit", "u", b"HTTP/1.1 200 OK\r\n\r\n", http, digest, ("WARC-Refers-To", "elsewhere")), meta("o", "u", 5),
    ]
    sha = hashlib.sha1(b"body").hexdigest()
    got = {tuple(r) for r in warc.captures(warc.assemble(spark.createDataFrame(rows, warc._RECORD))).collect()}
    assert got == {(9, 4, sha, "response", None), (4, 4, sha, "revisit", 9), (5, 77, "stated", "revisit", None)}
