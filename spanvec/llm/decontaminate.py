"""Benchmark decontamination (1): one Aho-Corasick automaton over the normalised benchmark, each text scanned once.

Its symbols are words: a word is known by its 64-bit hash and numbered by the benchmark's vocabulary; all others are
number 0. States, transitions and failure links are sorted numpy arrays, 17 bytes a state, and a batch of texts is
scanned in lanes side by side: no pattern is longer than the window, so a lane that starts a window earlier is right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, binaries, chunks, doc_columns, give_back, read, words_of

WINDOW, ROWS = 10, 2048
#: Bytes of text that are scanned at once, and lanes side by side.
SCAN_BYTES, LANES = 2 << 20, 2048
#: Bytes of benchmark text in one automaton, which bounds a worker's memory. A larger benchmark becomes several, which a task builds one after the other for each HELD_BYTES of its texts.
AUTOMATON_BYTES, HELD_BYTES = 4 << 20, 64 << 20
_BUILT: dict[tuple[int, int], tuple] = {}
_SPAN = "array<struct<start:long,stop:long,item_id:string>>"


class Windows:
    """The automaton over the windows of items, (id, text) each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        _, _, _, h, bound = words_of([t for _, t in items], ALNUM)
        self.vocabulary = np.unique(h)
        ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
        self.base = len(self.vocabulary) + 1
        size = np.diff(bound)
        n = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(items)), n)
        first = bound[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        node, keys, total = np.zeros(len(owner), np.int64), [], 0
        self.depth, parent = [np.zeros(1, np.int8)], [np.zeros(1, np.int64)]
        for d in range(window):
            live = np.flatnonzero(size[owner] > d)
            key, inv = np.unique(node[live] * self.base + ids[first[live] + d], return_inverse=True)
            node[live] = total + 1 + inv
            keys.append(key)  # parents are numbered level by level, so keys ascend over all levels
            parent.append(key // self.base)
            self.depth.append(np.full(len(key), d + 1, np.int8))
            total += len(key)
        self.keys, self.depth = np.concatenate(keys), np.concatenate(self.depth)
        self.root = np.zeros(self.base, np.int64)
        self.root[keys[0]] = np.arange(1, len(keys[0]) + 1)
        end = np.zeros(total + 1, bool)
        end[node] = True
        end[0] = False
        self.fail, self.out, at = np.zeros(total + 1, np.int32), np.zeros(total + 1, np.int32), 1
        for key, p in zip(keys, parent[1:]):
            own = np.arange(at, at + len(key))
            if at > 1 and len(own):
                self.fail[own] = self.step(self.fail[p].astype(np.int64), key % self.base)
            self.out[own] = np.where(end[own], own, self.out[self.fail[own]])
            at += len(key)
        # the items of each end state
        o = np.lexsort((owner, node))
        pairs = np.unique(np.stack((node[o], owner[o])), axis=1) if len(o) else np.zeros((2, 0), np.int64)
        self.ends, begin = np.unique(pairs[0], return_index=True)
        self.items = [tuple(items[i][0] for i in part if items[i][0] is not None) for part in np.split(pairs[1], begin[1:])] if len(self.ends) else []

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        new = self.root[word]
        todo = np.flatnonzero((state > 0) & (word > 0))
        while len(todo):
            key = state[todo] * self.base + word[todo]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            there = self.keys[k] == key
            new[todo[there]] = k[there] + 1
            todo = todo[~there]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        return new

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; and text, first word and end state of every window that occurs."""
        _, _, _, h, bound = words_of(texts, ALNUM)
        size, none = np.diff(bound), np.zeros(0, np.int64)
        if not len(h) or not len(self.keys):
            return size, none, none, none
        k = np.searchsorted(self.vocabulary, h)
        k[k == len(self.vocabulary)] = 0
        owner = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(h)) + owner  # an unknown word stands between texts
        lanes = max(1, min(LANES, len(place) // (8 * self.window)))
        warm = self.window - 1
        width = -(-(int(place[-1]) + 1) // lanes)
        words = np.zeros(warm + lanes * width, np.int64)
        words[warm + place] = np.where(self.vocabulary[k] == h, k + 1, 0)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, width + warm)[:: width].T)
        state, where, found = np.zeros(lanes, np.int64), [none], [none]
        for t in range(width + warm):
            state = self.step(state, words[t])
            if t >= warm:
                ends = self.out[state]
                hit = np.flatnonzero(ends)
                if len(hit):
                    where.append(hit * width + t - warm)
                    found.append(ends[hit].astype(np.int64))
        where, found = np.concatenate(where), np.concatenate(found)
        rows = []
        while len(where):  # a window may end with shorter ones
            rows.append((where, found))
            more = self.out[self.fail[found]].astype(np.int64)
            where, found = where[more > 0], more[more > 0]
        if not rows:
            return size, none, none, none
        where, found = (np.concatenate(x) for x in zip(*rows))
        at = np.searchsorted(place, where)
        return size, owner[at], at - bound[owner[at]] - self.depth[found] + 1, found

    def items_of(self, state: np.ndarray) -> list[tuple[str, ...]]:
        return [self.items[i] for i in np.searchsorted(self.ends, state).tolist()]


def load_items(spark: SparkSession, benchmark: DataFrame, automaton_bytes: int) -> list[Broadcast]:
    """The benchmark's rows as broadcasts of a checked size, one an automaton. A row has a null id or text at will: null text has no words, and a null id marks words but counts as no item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // automaton_bytes))
    # one automaton's rows at a time reach the driver
    return [
        spark.sparkContext.broadcast([(r.i, r.t.encode()) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)).collect()])
        for k in range(n)
    ]


def _built(b: Broadcast, window: int):
    key = (b._jbroadcast.id() if getattr(b, "_jbroadcast", None) else id(b.value), window)
    if key not in _BUILT:
        _BUILT.clear()  # one automaton in memory at a time
        _BUILT[key] = (b.value, Windows(b.value, window))
    return _BUILT[key][1]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, spans: bool = False
) -> DataFrame:
    """Finds benchmark passages in whole texts.

    A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and with spans=True the
    matches as character ranges [start, stop) of the original text with their item. Null or empty text: no words, not
    contaminated. Rows with the same or a null doc_id are scanned each for itself. An empty benchmark hits nothing.
    Other columns of docs don't matter.
    """
    parts = load_items(docs.sparkSession, benchmark, automaton_bytes)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + (f", spans {_SPAN}" if spans else "")

    def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in held for t in binaries(b.column("text"))]
        n_words, n_hit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        items: dict[int, set[str]] = {}
        places: dict[int, list[tuple[int, int, tuple[str, ...]]]] = {}
        for p in parts:
            built = _built(p, window)
            for i, j in chunks(np.array([len(t) for t in texts], np.int64), SCAN_BYTES):
                n_words[i:j], text, first, state = built.scan(texts[i:j])
                for k, w, n, ids in zip(text.tolist(), first.tolist(), built.depth[state].tolist(), built.items_of(state)):
                    items.setdefault(i + k, set()).update(ids)
                    places.setdefault(i + k, []).append((w, n, ids))
        for i, found in places.items():
            step = np.zeros(n_words[i] + 1, np.int64)
            np.add.at(step, [w for w, _, _ in found], 1)
            np.add.at(step, [w + n for w, n, _ in found], -1)
            n_hit[i] = np.count_nonzero(np.cumsum(step[:-1]))
        none: set[str] = set()
        cols = [
            pa.concat_arrays([b.column("doc_id") for b in held]), pa.array(n_words), pa.array(n_hit), pa.array([len(items.get(i, none)) for i in range(len(texts))], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(items.get(i, none))).encode()).hexdigest() for i in range(len(texts))]), pa.array(n_hit > 0),
        ]
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item_id", pa.string())]))
            cols.append(pa.array([_spans(t, {(w, n, x) for w, n, ids in places.get(i, ()) for x in ids or (None,)}) for i, t in enumerate(texts)], kind))
            names.append("spans")
        yield pa.RecordBatch.from_arrays(cols, names)

    return doc_columns(docs).mapInArrow(_by_texts(scan, len(parts)), schema)


def _by_texts(scan, automata: int):
    """Gives scan the task's batches: each by itself for one automaton, else as many as make HELD_BYTES, so that few automata are built."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                held.append(b.slice(i, ROWS))
                size += held[-1].column("text").nbytes
                if automata < 2 or size >= HELD_BYTES:
                    yield from scan(held)
                    held, size = [], 0
        if held:
            yield from scan(held)
        give_back()

    return run


def _spans(text: bytes, places: set[tuple[int, int, str | None]]) -> list[dict]:
    if not places:
        return []
    inside = np.concatenate(([False], np.frombuffer(text.translate(ALNUM), np.uint8) != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[start[w]]), "stop": int(chars[end[w + n - 1]]), "item_id": x} for w, n, x in sorted(places, key=str)]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs without the rows in which any word is hit, decided row by row; all columns stay.

    Null and empty texts stay, repeated rows and rows with a null doc_id are decided each for itself, and an empty
    benchmark keeps everything.
    """
    parts = load_items(docs.sparkSession, benchmark, automaton_bytes)

    def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in held for t in binaries(b.column("text"))]
        bad = np.zeros(len(texts), bool)
        for p in parts:
            built = _built(p, window)
            for i, j in chunks(np.array([len(t) for t in texts], np.int64), SCAN_BYTES):
                bad[i + built.scan(texts[i:j])[1]] = True
        at = 0
        for b in held:
            yield b.filter(pa.array(~bad[at : at + b.num_rows]))
            at += b.num_rows

    return docs.mapInArrow(_by_texts(scan, len(parts)), docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_W = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, {_W.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i:i+{WINDOW - 1}]) AS n, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS r(i) WHERE len(w) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, {_W.format("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT row_id, n, i, array_to_string(w[i:i+n-1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hit AS (SELECT row_id, g.n, i, item_id FROM grams g JOIN win USING (n, k)),
words AS (SELECT row_id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT row_id, n, i FROM hit) h, unnest(range(0, n)) AS r(o) GROUP BY row_id),
items AS (SELECT row_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""
QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": SQL}
