"""Quality rules (6): gradient-boosted trees over document statistics, flattened into numpy node arrays."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, doc_columns, map_batches, read
from .doc_stats import EXACT, FEATURES, stats

TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 40, 4, 32, 0.2, 2.0, 12
#: More of these never makes a text better.
FALLING = ("symbols", "dup_lines", "repeats", "symbol_words")
#: At most so many labelled texts train the trees; those whose crc32 of doc_id is a multiple of 5 don't.
TRAIN_ROWS, TRAIN_CHARS = 4000, 200_000


class Trees:
    """Full binary trees in arrays: at node i the feature and threshold; children are 2 i + 1 and, above the threshold, 2 i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaves; every tree walks all rows at once."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, falling: tuple[str, ...] = FALLING) -> Trees:
    """Boosts log-loss on histograms. A split on a falling feature must not raise the right side, and both sides keep to their side of the middle from there on, so scores fall in it everywhere. Deterministic."""
    y = np.asarray(y, np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    n_in, n_leaf = 2**DEPTH - 1, 2**DEPTH
    feature, threshold, value = np.zeros((trees, n_in), np.int64), np.full((trees, n_in), np.inf), np.zeros((trees, n_leaf))
    if len(y) < 2 * LEAST or y.all() or not y.any():
        return Trees(feature[:0], threshold[:0], value[:0], base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    sign = np.array([-1 if f in falling else 0 for f in FEATURES])
    raw = np.full(len(y), base)
    leaf = lambda g, h, lo, hi: np.clip(-g / (h + RIDGE), lo, hi)
    for k in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while todo:
            node, rows, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            if node >= n_in:
                value[k, node - n_in] = RATE * leaf(gs, hs, lo, hi)
                raw[rows] += value[k, node - n_in]
                continue
            best = (1e-6, None)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = leaf(gl, hl, lo, hi), leaf(gs - gl, hs - hl, lo, hi)
                v = leaf(gs, hs, lo, hi)
                gain = -(gl * vl + 0.5 * (hl + RIDGE) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + RIDGE) * vr**2) + gs * v + 0.5 * (hs + RIDGE) * v**2
                gain[(nl < LEAST) | (len(rows) - nl < LEAST) | (sign[f] * (vr - vl) < 0)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (f, i, vl[i], vr[i]))
            if best[1] is None:
                todo.append((2 * node + 1, rows, lo, hi))  # the infinite threshold sends all rows left
                continue
            f, i, vl, vr = best[1]
            feature[k, node], threshold[k, node] = f, cuts[f][i]
            left = binned[rows, f] <= i
            mid = (vl + vr) / 2
            todo.append((2 * node + 1, rows[left], max(lo, mid) if sign[f] else lo, hi))
            todo.append((2 * node + 2, rows[~left], lo, min(hi, mid) if sign[f] else hi))
    return Trees(feature, threshold, value, base)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Trees:
    """Trains on the driver with at most rows labelled texts, chosen by a hash of doc_id; rows without text or label don't train. A doc_id with several rows trains by the least text."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("y"))
    lab = lab.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = doc_columns(docs).where(F.col("text").isNotNull() & (F.length("text") <= chars)).join(F.broadcast(lab), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch):
        x = stats(binaries(batch.column("text")))[1]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = sorted(map_batches(got, lambda: run, "doc_id long, y boolean, x array<double>").collect())
    return grow(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.y for r in found], bool))


def apply_rules(docs: DataFrame, model: Trees) -> DataFrame:
    """Counts whole texts and judges them.

    A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score in 0..1. kept is false where base_failed, else the trees' verdict, true from a score of 0.5. Null or empty
    text: zeros, base_failed. Repeated rows and null ids are judged each for itself; other columns don't matter.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        exact, x = stats(binaries(batch.column("text")))
        failed = (exact["n_words"] < 20) | (100 * exact["n_repeat_words"] > 30 * exact["n_words"])
        score = b.value.score(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(exact[k].astype(np.int64)) for k in EXACT), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)],
            ["doc_id", *EXACT, "base_failed", "kept", "score"],
        )

    return map_batches(doc_columns(docs), lambda: run, f"doc_id long, {', '.join(f'{k} long' for k in EXACT)}, base_failed boolean, kept boolean, score double")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
