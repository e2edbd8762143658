"""Suffix-array dedup (5): prefix doubling over sampled suffixes, in Spark's shuffles.

A byte goes when it lies in a string of `length` bytes that also starts in a document with a smaller doc_id. Ranking
every suffix would shuffle many times the input, so suffixes are sampled by content without losing a match: of the
strings of SEED bytes in each window of `length` bytes the one with the least hash, the leftmost of equals, is the
window's anchor. Equal windows have equal anchors in equal places. Consecutive windows with one anchor make a segment.
Ranks are 64-bit names of strings, as in Karp, Miller and Rosenberg's doubling, and grow in length by rounds:

1. (rank of the SEED bytes at the anchor, rank of the segment's whole text) are sorted by bucket. A segment's smallest
   doc_id decides all its later copies. An anchor whose segments are all one text is done: its windows occur nowhere else.
2. Only where an anchor has several segment texts - at the edges of matches - are the ranks of the single windows of
   `length` bytes sorted, once for each distinct segment; then the threshold is reached.

Documents are grouped into blocks of bounded size; a block sends each distinct rank once, with its smallest doc_id, so
a passage that a third of all documents share costs a record a block, and gets two bits a record back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import numbered
from .common import BYTE_TAB, U64, binaries, bucket_of, chunks, cuts_by, give_back, longs, map_batches, materialise, mix, null_mask, packed, parts_for, powers, read, runs, text_bytes, unpacked, widened

LENGTH, SEED = 50, 24
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
CHUNK = 160 << 10  # bytes that are named at once, so that the arrays stay in the processor's cache
PIECE = 1 << 20  # windows of a longer text that are handled at once
#: Bytes of the first ranks of doubling_spans(), and bits of a place in a text.
FIRST, PLACE = 16, 32
_RANKS = "bucket long, block long, a binary, s binary, docs binary, counts binary"
_REPLY = "block long, kind int, bucket long, flags binary, more binary"


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return x if k == w else np.minimum(x[: -(w - k)], x[w - k :])


class Block:
    """A block's rows in an order that doesn't depend on the shuffle, with their segments."""

    def __init__(self, table: pa.Table, length: int, seed: int):
        give_back()
        ids, null = longs(table.column("doc_id").combine_chunks()), null_mask(table.column("doc_id").combine_chunks())
        texts = binaries(table.column("text").combine_chunks())
        self.order = sorted(range(len(texts)), key=lambda i: (null[i], ids[i], texts[i]))
        self.ids, self.null = ids[self.order], null[self.order]
        self.texts = [texts[i] for i in self.order]
        self.length, self.seed = length, seed
        row, at, size, s, a = [], [], [], [], []
        pieces = [(i, o, t[o : o + PIECE + length - 1]) for i, t in enumerate(self.texts) if not self.null[i] for o in range(0, max(0, len(t) - length + 1), PIECE)]
        for i, j in chunks(np.array([len(p[2]) for p in pieces], np.int64), CHUNK):
            part = pieces[i:j]
            which, start, n, names, anchors = self._segments([p[2] for p in part])
            row.append(np.array([p[0] for p in part])[which])
            at.append(np.array([p[1] for p in part])[which] + start)
            size.append(n)
            s.append(names)
            a.append(anchors)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.row, self.at, self.size = cat(row, np.int64), cat(at, np.int64), cat(size, np.int64)
        self.name, first, self.which = np.unique(cat(s, np.uint64), return_index=True, return_inverse=True)
        self.first, self.anchor = first, cat(a, np.uint64)[first]
        self.least = self.ids[self.row[first]]  # rows ascend by doc_id

    def _segments(self, texts: list[bytes]):
        t = np.frombuffer(b"".join(texts), np.uint8)
        n, length, seed = len(t), self.length, self.seed
        f, inv = powers(n + 1)
        p = np.empty(n + 1, np.uint64)
        p[0] = 0
        np.cumsum(BYTE_TAB[t] * f[:n], out=p[1:])
        h = (p[seed:] - p[:-seed]) * inv[: n - seed + 1]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        anchor = (_slide_min((h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - seed + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        cut, ok, o = np.empty(len(anchor), bool), np.ones(len(anchor), bool), 0
        cut[1:] = anchor[1:] != anchor[:-1]
        starts = []
        for x in texts:
            starts.append(o)
            cut[o] = True
            o += len(x)
            if o < n:  # windows that run into the next text
                ok[o - length + 1 : o] = False
                cut[o - length + 1] = True
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, len(anchor)))
        keep = ok[at]
        at, size = at[keep], size[keep]
        names = mix((p[at + size + length - 1] - p[at]) * inv[at] + size.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
        which = np.searchsorted(starts, at, side="right") - 1
        return which, at - np.array(starts)[which], size, names, mix(h[anchor[at]])

    def ranked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the distinct segments by bucket and first place; the buckets and their bounds."""
        b = bucket_of(self.anchor, buckets)
        o = np.lexsort((self.first, b))
        return o, *cuts_by(b[o])

    def windows(self, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct segments: the name of each of their windows, and whose it is."""
        i, length = self.first[seg], self.length
        if not len(seg):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        size = self.size[i]
        text = b"".join(self.texts[r][a : a + n + length - 1] for r, a, n in zip(self.row[i].tolist(), self.at[i].tolist(), size.tolist()))
        t = np.frombuffer(text, np.uint8)
        f, inv = powers(len(t) + 1)
        p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_TAB[t] * f[: len(t)])))
        begin = np.cumsum(size + length - 1) - (size + length - 1)
        owner = np.repeat(np.arange(len(seg)), size)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return mix((p[at + length] - p[at]) * inv[at]), owner


def _send(block: int, bucket: np.ndarray, bounds: np.ndarray, a: np.ndarray | None, s: np.ndarray, least: np.ndarray) -> pa.Table:
    rows: dict[str, list] = {k: [] for k in ("bucket", "block", "a", "s", "docs", "counts")}
    for k, i, j in zip(bucket.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        d, c = runs(least[i:j])
        for name, v in zip(rows, (k, block, None if a is None else a[i:j].tobytes(), s[i:j].tobytes(), d.tobytes(), c.tobytes())):
            rows[name].append(v)
    return pa.table([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.int64()) + (pa.binary(),) * 4)], names=list(rows))


def _rerank(table: pa.Table) -> pa.Table:
    """Sorts a bucket's (rank, doc_id) and tells each sender which of its ranks an earlier document has, and which need a longer one."""
    t = {k: table.column(k).to_pylist() for k in table.column_names}
    s = np.frombuffer(b"".join(t["s"]), np.uint64)
    doc = np.repeat(np.frombuffer(b"".join(t["docs"]), np.int64), np.frombuffer(b"".join(t["counts"]), np.uint32))
    o = np.argsort(s, kind="stable")
    x = s[o]
    first = np.concatenate(([True], x[1:] != x[:-1]))
    starts = np.flatnonzero(first)
    group = np.empty(len(s), np.int64)
    group[o] = np.cumsum(first) - 1
    least = np.minimum.reduceat(doc[o], starts)[group]
    earlier = least < doc
    kind = 1 if t["a"][0] is not None else 2
    more = np.zeros(len(s), bool)
    if kind == 1:
        a = np.frombuffer(b"".join(t["a"]), np.uint32)[o[starts]]
        _, inv, n = np.unique(a, return_inverse=True, return_counts=True)
        more = (n[inv] > 1)[group] & ~earlier
    ends = np.cumsum([len(b) // 8 for b in t["s"]])
    bounds = list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()))
    return pa.table(
        [
            pa.array(t["block"], pa.int64()), pa.array([kind] * len(bounds), pa.int32()), pa.array(t["bucket"], pa.int64()),
            pa.array([packed(earlier[i:j]) for i, j in bounds], pa.binary()), pa.array([packed(more[i:j]) for i, j in bounds], pa.binary()),
        ],
        names=["block", "kind", "bucket", "flags", "more"],
    )


def _flags(replies: pa.Table, kind: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = sorted((r["bucket"], r["flags"], r["more"]) for r in replies.to_pylist() if r["kind"] == kind)
    if len(got) != len(bounds) - 1:
        raise RuntimeError(f"{len(got)} replies for {len(bounds) - 1} buckets")
    n = np.diff(bounds).tolist()
    none = [np.zeros(0, bool)]
    return tuple(np.concatenate(none + [unpacked(r[k], m) for r, m in zip(got, n)]) for k in (1, 2))


def _spans(docs: DataFrame, length: int, seed: int, finish, schema: str) -> DataFrame:
    """finish(block table, row order, texts, spans of each text) -> table, for each block."""
    _, size = text_bytes(docs)
    blocks, buckets = (parts_for(size, x) for x in widened(size, BLOCK_BYTES, BUCKET_BYTES))
    # as many partitions as blocks and buckets, so that what a task reads grows to four times at most
    parts = docs.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "__block")
    grouped = parts.groupBy("__block")

    def first(key, table):
        b = Block(table, length, seed)
        o, bucket, bounds = b.ranked(buckets)
        return _send(key[0].as_py(), bucket, bounds, (b.anchor[o] >> U64(32)).astype(np.uint32), b.name[o], b.least[o])

    def edges(b: Block, replies: pa.Table):
        """What round 1 said: the distinct segments that an earlier document has, those that need round 2, and the latter's windows in the order in which they are sent."""
        o, _, bounds = b.ranked(buckets)
        flags, more = _flags(replies, 1, bounds)
        earlier = np.empty(len(o), bool)
        earlier[o] = flags
        seg = np.sort(o[more])
        seg = seg[np.lexsort((b.first[seg],))]
        w, owner = b.windows(seg)
        name, at, which = np.unique(w, return_index=True, return_inverse=True)  # segments ascend by doc_id
        bk = bucket_of(name, buckets)
        order = np.lexsort((at, bk))
        return earlier, seg, owner, name, at, which, order, cuts_by(bk[order])

    def second(key, table, replies):
        b = Block(table, length, seed)
        _, seg, owner, name, at, _, order, (bucket, bounds) = edges(b, replies)
        least = b.least[seg][owner[at]] if len(seg) else np.zeros(0, np.int64)
        return _send(key[0].as_py(), bucket, bounds, None, name[order], least[order])

    def last(key, table, replies):
        b = Block(table, length, seed)
        earlier, seg, owner, name, at, which, order, (_, bounds) = edges(b, replies)
        seen = np.empty(len(name), bool)
        seen[order] = _flags(replies, 2, bounds)[0]
        mine = b.least[seg]
        hit = seen[which] | (mine[owner[at]][which] < mine[owner]) if len(seg) else np.zeros(0, bool)
        whole = earlier[b.which] | (b.ids[b.row] > b.least[b.which])
        # (row, first, last window + length) of each run of hit windows
        rows, begin, end = b.row[whole], b.at[whole], b.at[whole] + b.size[whole] + length - 1
        if hit.any():
            place = np.full(len(b.name), -1)
            place[seg] = np.arange(len(seg))
            base = np.cumsum(b.size[b.first[seg]]) - b.size[b.first[seg]]
            some = np.bincount(owner, hit, len(seg)) > 0
            inst = np.flatnonzero(~whole & (place[b.which] >= 0))
            inst = inst[some[place[b.which[inst]]]]
            found = [(rows, begin, end)]
            for i, j in chunks(b.size[inst], PIECE):
                # the windows of these segments in one array, a gap of one behind each
                some, n = inst[i:j], b.size[inst[i:j]]
                stop = np.cumsum(n + 1)
                start = stop - n - 1
                own = np.repeat(np.arange(len(some)), n)
                step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                flat = np.zeros(int(stop[-1]) + 1, np.int8)
                flat[1 + start[own] + step] = hit[base[place[b.which[some]]][own] + step]
                edge = np.diff(flat)
                x, y = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                k = np.searchsorted(stop, x, side="right")
                at = b.at[some[k]] - start[k]
                found.append((b.row[some[k]], at + x, at + y + length - 1))
            rows, begin, end = (np.concatenate(c) for c in zip(*found))
        o = np.lexsort((begin, rows))
        rows, begin, end = rows[o], begin[o], end[o]
        bound = np.searchsorted(rows, np.arange(len(b.texts) + 1))
        spans = []
        for i, j in zip(bound[:-1], bound[1:]):
            merged: list[list[int]] = []
            for x, y in zip(begin[i:j].tolist(), end[i:j].tolist()):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(y, merged[-1][1])
                else:
                    merged.append([x, y])
            spans.append(merged)
        return finish(table, b.order, b.texts, spans)

    ranks = grouped.applyInArrow(first, _RANKS)
    said = ranks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_rerank, _REPLY)
    longer = grouped.cogroup(said.groupBy("block")).applyInArrow(second, _RANKS)
    both = said.unionByName(longer.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_rerank, _REPLY))
    return grouped.cogroup(both.groupBy("block")).applyInArrow(last, schema)


def _kept(text: bytes, spans: list[list[int]]) -> bytes:
    if not spans:
        return text
    ends = [0, *(y for _, y in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(x for x, _ in spans), len(text)]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, spans: bool = False) -> DataFrame:
    """What is removed from whole texts, as UTF-8 bytes, where an earlier document has the same `length` bytes.

    A row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    spans=True the byte ranges. Null text is empty; texts under `length` bytes stay. Rows with equal doc_id don't
    remove from each other; a row with a null doc_id neither removes nor loses anything. Other columns don't matter.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,stop:long>>" if spans else "")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(table: pa.Table, order: list[int], texts: list[bytes], found: list) -> pa.Table:
        cols = {
            "doc_id": table.column("doc_id").combine_chunks().take(pa.array(order, pa.int64())),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array([sum(y - x for x, y in s) for s in found], pa.int64()),
            "n_spans": pa.array([len(s) for s in found], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(_kept(t, s)).hexdigest() for t, s in zip(texts, found)]),
        }
        if spans:
            cols["spans"] = pa.array([[{"start": x, "stop": y} for x, y in s] for s in found], kind)
        return pa.table(cols)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _spans(d, length, seed, finish, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with the repeated bytes cut out of text, and n_chars counted anew; all rows and columns stay.

    A character of which a cut leaves some bytes goes whole. Null text stays null.
    """
    names = docs.columns

    def finish(table: pa.Table, order: list[int], texts: list[bytes], found: list) -> pa.Table:
        t = table.select(names).combine_chunks().take(pa.array(order, pa.int64()))
        null = t.column("text").is_null().to_pylist()
        kept = [None if z else _kept(x, s).decode("utf-8", "ignore") for x, s, z in zip(texts, found, null)]
        t = t.set_column(names.index("text"), "text", pa.array(kept, pa.string()))
        if "n_chars" in names:
            i = names.index("n_chars")
            t = t.set_column(i, "n_chars", pa.array([o if k is None or not s else len(k) for o, k, s in zip(t.column(i).to_pylist(), kept, found)], t.column(i).type))
        return t

    return _spans(docs, length, seed, finish, docs.schema)


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """at (row and place in one number) and the first FIRST bytes, as two numbers in their order, of every place from which FIRST bytes are left in texts of length bytes or more."""

    def run(batch: pa.RecordBatch):
        rows = longs(batch.column("row")).tolist()
        for row, t in zip(rows, binaries(batch.column("text"))):
            if len(t) < length:
                continue
            b = np.frombuffer(t, np.uint8)
            eight = np.zeros(len(b) - 7, np.uint64)
            for k in range(8):
                eight = eight << U64(8) | b[k : len(b) - 7 + k].astype(np.uint64)
            word = (eight ^ U64(1 << 63)).view(np.int64)  # as signed numbers in the bytes' order
            n = len(b) - FIRST + 1
            for i in range(0, n, 1 << 20):
                j = min(i + (1 << 20), n)
                yield pa.RecordBatch.from_arrays([pa.array((row << PLACE) + np.arange(i, j)), pa.array(word[i:j]), pa.array(word[i + 8 : j + 8])], ["at", "a", "b"])

    return map_batches(docs, lambda: run, "at long, a long, b long", rows=64)


def _reranked(pairs: DataFrame) -> DataFrame:
    """(at, rank) of pairs (at, a, b) that aren't alone: Spark sorts them by range, and a rank is the partition's number and the place of the first equal pair there, so ranks are in the order of the pairs."""
    ordered = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b")

    def run(batches):
        base, seen, last = TaskContext.get().partitionId() << 40, 0, None  # last: the pair before, its rank, and its place in the text while it is alone
        for t in batches:
            a, b, at = (t.column(k).to_numpy() for k in ("a", "b", "at"))
            if not len(a):
                continue
            new = np.concatenate(([last is None or last[0] != (a[0], b[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(a)) + seen, -1))
            rank = np.where(first < 0, last[1] if last else 0, base + first)
            alone = new & np.concatenate((new[1:], [True]))
            out_at, out_rank = at[~alone], rank[~alone]
            if last is not None and last[2] is not None and not new[0]:
                out_at, out_rank = np.append(out_at, last[2]), np.append(out_rank, last[1])
            last = (a[-1], b[-1]), rank[-1], (at[-1] if alone[-1] else None)
            seen += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(out_at), pa.array(out_rank)], ["at", "rank"])

    return ordered.mapInArrow(run, "at long, rank long")


def doubling_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What repeated_spans() returns, by prefix doubling over every byte: no sampling and no hashes.

    Ranks of the FIRST bytes at each place are sorted; then, at growing offsets, pairs of the ranks at a place and at the
    offset behind it are, which makes ranks of twice the bytes, and of length bytes at last. A place whose rank no other
    has is done and leaves. Null, empty and short texts, repeated rows and null ids are as in repeated_spans(). Every round
    shuffles some 30 bytes for each byte that is still in question: see README for what that costs.
    """
    if length < FIRST:
        raise ValueError(f"length must be at least {FIRST}")
    d = materialise(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), [F.asc_nulls_last("doc_id")], "row"), "rows")
    live = materialise(_reranked(_positions(d.where("doc_id is not null"), length)), "ranks")
    n = FIRST
    while n < length:
        step = min(n, length - n)
        behind = live.select((F.col("at") - step).alias("at"), F.col("rank").alias("b"))
        live = materialise(_reranked(live.withColumnRenamed("rank", "a").join(behind, "at")), "ranks")
        n += step
    ids = d.select("row", "doc_id")
    held = live.withColumn("row", F.shiftright("at", PLACE)).join(ids, "row")
    least = held.groupBy("rank").agg(F.min("doc_id").alias("least"))
    hits = held.join(least, "rank").where("least < doc_id").select("row", F.col("at").bitwiseAND(F.lit((1 << PLACE) - 1)).alias("p"))

    def cut(key, table, found):
        out: list[list] = [[], [], [], [], []]
        for i, t in zip(table.column("doc_id").to_pylist(), binaries(table.column("text").combine_chunks())):
            step = np.zeros(len(t) + 1, np.int64)
            p = found.column("p").to_numpy()
            step[p] += 1
            np.add.at(step, p + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            for col, v in zip(out, (i, len(t), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)), hashlib.sha256(kept).hexdigest())):
                col.append(v)
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return d.groupBy("row").cogroup(hits.groupBy("row")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE = {
    "op5_suffix_dedup": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS MATERIALIZED (SELECT r, doc_id, o, substr(x, 2 * o + 1, {2 * (999 + LENGTH)}) AS y FROM d, unnest(range(0, len(x) // 2 - {LENGTH - 1}, 1000)) AS t(o) WHERE doc_id IS NOT NULL),
h AS MATERIALIZED (SELECT r, doc_id, o, p, hash(substr(y, 2 * p + 1, {2 * LENGTH})) AS h FROM c, unnest(range(0, least(1000, len(y) // 2 - {LENGTH - 1}))) AS t(p)),
e AS MATERIALIZED (SELECT r, h.doc_id, o + p AS p, substr(y, 2 * p + 1, {2 * LENGTH}) AS k FROM h JOIN (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h) JOIN c USING (r, o)),
s AS (SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY k) AS least FROM e) WHERE least < doc_id),
g AS (SELECT r, p, p > coalesce(lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH}, -1) AS new FROM s),
m AS MATERIALIZED (SELECT r, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM g) GROUP BY r, run),
l AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM m),
k AS (SELECT l.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM l JOIN d USING (r) GROUP BY l.r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
}
