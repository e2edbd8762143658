"""Quality classifier (2): heuristic labellers weighed by expectation-maximisation; their posterior trains a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, binaries, chunks, doc_columns, map_batches, mix, read, words_of
from .doc_stats import FEATURES, WS, stats

#: Labeller -> feature, and votes for bad and good by bounds on it: (low, high) means below low or above high is bad; (a, b) from a to b is good; between, it abstains.
LABELLERS = (
    ("symbols", "symbols", (0, 0.06), (0, 0.02)),
    ("symbol_words", "symbol_words", (0, 0.25), (0, 0.05)),
    ("dup_lines", "dup_lines", (0, 0.3), (0, 0.1)),
    ("repeats", "repeats", (0, 0.3), (0, 0.05)),
    ("length", "words", (20, np.inf), (50, np.inf)),
    ("word_length", "mean_word", (2.5, 12), (3, 9)),
    ("common", "common", (0.03, np.inf), (0.1, 0.7)),
    ("upper", "upper", (0, 0.4), (0, 0.15)),
    ("distinct", "distinct", (0.12, np.inf), (0.3, np.inf)),
)
BITS = 16
#: At most so many texts, chosen by a hash of doc_id, train the linear scorer; votes are counted over all texts.
#: A text of more than TRAIN_CHARS characters doesn't train; with rows this bounds what the driver holds to 80 million.
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000


def votes(x: np.ndarray) -> np.ndarray:
    """0 bad, 1 abstains, 2 good; a column for each labeller."""
    out = np.ones((len(x), len(LABELLERS)), np.int64)
    for k, (_, f, (low, high), (a, b)) in enumerate(LABELLERS):
        v = x[:, FEATURES.index(f)]
        out[(v >= a) & (v <= b), k] = 2
        out[(v < low) | (v > high), k] = 0
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def unpattern(p: np.ndarray) -> np.ndarray:
    return np.asarray(p)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class LabelModel:
    """P(good) and, for each labeller, P(vote | class); labellers vote independently given the class."""

    def __init__(self, prior: float, table: np.ndarray):
        self.prior, self.table = prior, table  # table[class, labeller, vote]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        k = np.arange(v.shape[1])
        log = [np.log(self.table[c][k, v]).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - self.prior) - log[1] - np.log(self.prior), -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, the share of its votes that agree with the class."""
        right = self.table[1][:, 2] * self.prior + self.table[0][:, 0] * (1 - self.prior)
        wrong = self.table[1][:, 0] * self.prior + self.table[0][:, 2] * (1 - self.prior)
        return right / (right + wrong)


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """Of vote patterns v that occur n times. It starts from the majority, and good stays the class for which votes speak."""
    m = LabelModel(0.8, np.full((2, len(LABELLERS), 3), 1 / 3))
    if not n.sum():
        return m
    post = np.clip(0.5 + ((v == 2).sum(axis=1) - 2 * (v == 0).sum(axis=1)) / (2 * v.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack((n * (1 - post), n * post))
        m.prior = float((w[1].sum() + 1) / (w.sum() + 2))
        for c in (0, 1):
            for k in range(v.shape[1]):
                count = np.bincount(v[:, k], w[c], 3) + 0.5
                m.table[c, k] = count / count.sum()
        new = m.posterior(v)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return m


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, its last three bytes and its length class, and each text's bounds among the words."""
    t, start, end, h, bound = words_of(texts, WS)
    if not len(h):
        return np.zeros((0, 3), np.int64), bound
    tail = sum(t[np.maximum(end - k, start)].astype(np.uint64) << U64(8 * k - 8) for k in (1, 2, 3))
    size = np.minimum(end - start, 24).astype(np.uint64)
    return np.stack([(mix(x) >> U64(64 - BITS)).astype(np.int64) for x in (h + U64(1), tail + U64(1 << 40), size + U64(1 << 50))], axis=1), bound


class Scorer:
    """A weight for each bucket; a text's logit is the mean of its words' plus a constant."""

    def __init__(self, weight: np.ndarray, shift: float):
        self.weight, self.shift = weight, shift

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for i, j in chunks(np.array([len(t) for t in texts], np.int64), 256 << 10):
            b, bound = hashed(texts[i:j])
            n = np.diff(bound)
            mean = np.zeros(len(n))
            if len(b):  # each text's words are summed by themselves, so neighbours change no bit
                mean[n > 0] = np.add.reduceat(self.weight[b].sum(axis=1), bound[:-1][n > 0]) / n[n > 0]
            out.append(self.shift + mean)
        return 1 / (1 + np.exp(-np.concatenate(out))) if out else np.zeros(0)


def train_scorer(texts: list[bytes], target: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-5) -> Scorer:
    """Log-loss against soft targets, by Adam over all texts at once. Deterministic."""
    w, shift = np.zeros(1 << BITS), float(np.log((target.sum() + 1) / (len(target) - target.sum() + 1)))
    parts = [(*hashed(texts[i:j]), i) for i, j in chunks(np.array([len(t) for t in texts], np.int64), 1 << 20)]
    flat, doc, size = [], [], np.zeros(len(texts))
    for b, bound, i in parts:
        flat.append(b)
        doc.append(np.repeat(np.arange(len(bound) - 1), np.diff(bound)) + i)
        size[i : i + len(bound) - 1] = np.diff(bound)
    if not texts:
        return Scorer(w, shift)
    key, n = np.unique(np.concatenate([(d[:, None] << BITS | b).ravel() for b, d in zip(flat, doc)]), return_counts=True)
    d, b = key >> BITS, key & ((1 << BITS) - 1)
    tf = n / np.maximum(size, 1)[d]
    m, s, ms, ss = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        q = 1 / (1 + np.exp(-(shift + np.bincount(d, w[b] * tf, len(texts)))))
        e = (q - target) / len(texts)
        g, gs = np.bincount(b, e[d] * tf, len(w)) + ridge * w / len(texts), e.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        ms, ss = 0.9 * ms + 0.1 * gs, 0.99 * ss + 0.01 * gs * gs
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-7)
        shift -= 0.1 * rate * (ms / (1 - 0.9**k)) / (np.sqrt(ss / (1 - 0.99**k)) + 1e-9)
    return Scorer(w, shift)


def _patterns(docs: DataFrame, extra: str = "") -> DataFrame:
    def run(batch: pa.RecordBatch):
        p = pattern(votes(stats(binaries(batch.column("text")))[1]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "pattern"])

    return map_batches(docs, lambda: run, f"doc_id long, text string, {extra}pattern long")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[LabelModel, Scorer]:
    """Vote patterns are counted over all texts - at most 3 to the number of labellers, however many texts - and the scorer is trained on at most rows of them."""
    d = doc_columns(docs)
    seen = sorted((r.pattern, r.n) for r in _patterns(d).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    model = expectation_maximisation(unpattern([p for p, _ in seen]).reshape(-1, len(LABELLERS)), np.array([n for _, n in seen], np.float64))
    # the hashes alone are ordered; then only about as many texts as are used leave their tasks
    can, order = d.where(F.col("text").isNotNull() & (F.length("text") <= chars)), F.xxhash64("doc_id")
    last = can.select(order.alias("o")).orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    # a hash that very many rows share is that of one doc_id: of such rows those of the least texts train
    some = can.where(order <= F.lit(last if last is not None else 0)).orderBy(order, "doc_id", "text").limit(rows).collect()
    texts = [r.text.encode() for r in some]
    target = model.posterior(votes(stats(texts)[1])) if texts else np.zeros(0)
    return model, train_scorer(texts, target)


def classify(docs: DataFrame, model: LabelModel, scorer: Scorer) -> DataFrame:
    """Scores whole texts.

    A row for each row of docs: doc_id, votes (a letter b, - or g for each labeller), posterior (of the labellers alone),
    score (of the linear scorer), predicted (1 from a score of 0.5) and kept (the same as boolean). Null or empty text
    has no words: the length labeller votes bad, and the score is the scorer's constant. Repeated rows and null ids are
    scored each for itself; other columns don't matter.
    """
    b = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batch: pa.RecordBatch):
        texts = binaries(batch.column("text"))
        v = votes(stats(texts)[1])
        m, s = b.value
        score = s.score(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(["".join("b-g"[k] for k in r) for r in v.tolist()]), pa.array(m.posterior(v)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= 0.5)],
            ["doc_id", "votes", "posterior", "score", "predicted", "kept"],
        )

    return map_batches(doc_columns(docs), lambda: run, "doc_id long, votes string, posterior double, score double, predicted int, kept boolean")


def op2_quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return classify(docs, *fit(docs))


QUERIES = {"op2_quality_labels": op2_quality_labels}
ORACLE: dict[str, str] = {}
