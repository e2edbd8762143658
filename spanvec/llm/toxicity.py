"""Toxicity (4): a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

Each word's input has a word part - the log-odds of its hash in toxic against other training texts - and a character
part - the mean log-odds of its hashed character n-grams, and those of the leading ones - so that unseen forms of a
known stem are felt. The network reads every window of WINDOW words at steps of STEP, so all windows overlap, in both directions;
attention pools its states. A text's score is the calibrated logit of its highest window.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_TAB, U64, binaries, chunks, doc_columns, longs, map_batches, mix, null_mask, powers, read, words_of

WINDOW, STEP = 32, 16
HIDDEN, ATT = 8, 8
#: Each word and n-gram has a bucket in either of two tables; the weaker evidence counts, so that sharing one bucket does no harm.
BUCKET_BITS = 18
NGRAMS = (4, 5, 6)
N_FEATURES = 8
#: At most so many labelled texts of each class train the model, of at most so many characters; scoring has no such bound.
TRAIN_PER_CLASS, TRAIN_CHARS = 1500, 20_000


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _buckets(h: np.ndarray) -> np.ndarray:
    return np.stack((h >> U64(64 - BUCKET_BITS), h >> U64(64 - 2 * BUCKET_BITS) & U64((1 << BUCKET_BITS) - 1))).astype(np.int64)


def _weaker(odds: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    a, b = odds[0][buckets[0]], odds[1][buckets[1]]
    return np.where(np.abs(a) < np.abs(b), a, b)


@dataclass
class Words:
    """Distinct words of some texts and, for each text, the numbers of its words."""

    word: np.ndarray  # two buckets of each distinct word
    grams: np.ndarray  # two buckets of each character n-gram
    begin: np.ndarray  # where each distinct word's n-grams begin
    lead: np.ndarray  # of each length, the two buckets of each word's first n-gram
    size: np.ndarray
    ids: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        t, start, end, h, bound = words_of(texts, ALNUM)
        _, first, ids = np.unique(h, return_index=True, return_inverse=True)
        size = (end - start)[first]
        # each distinct word once more as ^word, for n-grams that know the beginning
        padded = size + 1
        at = np.cumsum(padded) - padded
        buf = np.empty(int(padded.sum()), np.uint8)
        owner = np.repeat(np.arange(len(first)), padded)
        off = np.arange(len(buf)) - at[owner]
        buf[:] = t[np.maximum(start[first][owner] + off - 1, 0)] if len(buf) else 0
        buf[at] = 94
        f, inv = powers(len(buf) + 1)
        p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_TAB[buf] * f[: len(buf)])))
        grams, owners = [], []
        lead = np.zeros((len(NGRAMS), 2, len(first)), np.int64)
        for k, n in enumerate(NGRAMS):
            m = np.minimum(n, padded)  # a shorter word is its own n-gram
            ok = off + m[owner] <= padded[owner]
            i = np.flatnonzero(ok)
            w = m[owner[i]]
            g = _buckets(mix((p[i + w] - p[i]) * inv[i] + U64(n)))
            grams.append(g)
            owners.append(owner[i])
            if g.shape[1]:
                lead[k] = g[:, np.searchsorted(owners[-1], np.arange(len(first)))]
        g, o = np.concatenate(grams, axis=1), np.concatenate(owners)
        s = np.argsort(o, kind="stable")
        return cls(_buckets(h[first]), g[:, s], np.searchsorted(o[s], np.arange(len(first))), lead, size, ids, bound)


def counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts that hold each bucket, for words and n-grams."""
    word, gram = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for t in texts:
        w = Words.of([t])
        for k in (0, 1):
            word[k, np.unique(w.word[k])] += 1
            gram[k, np.unique(w.grams[k])] += 1
    return word, gram


def unlike(texts: list[bytes], hashes: int = 4) -> np.ndarray:
    """Texts that share none of their least hashes of three words with an earlier one: of copies, only the first counts as evidence."""
    keep, seen = np.ones(len(texts), bool), set()
    salts = np.random.default_rng(5).integers(1, 2**63, hashes, dtype=np.uint64) | U64(1)
    for i, t in enumerate(texts):
        h = words_of([t], ALNUM)[3]
        if len(h) < 8:
            continue
        three = h[:-2] * U64(3) + h[1:-1] * U64(5) + h[2:] * U64(7)
        own = {(k, int(mix(three * s).min())) for k, s in enumerate(salts)}
        keep[i] = not own & seen
        seen |= own
    return keep


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed, and two standard errors nearer to 0, as among many buckets some stand out by chance."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return (np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0)).astype(np.float32)


def features(w: Words, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """A row for each distinct word, and a last one for padding."""
    x = np.zeros((len(w.size) + 1, N_FEATURES), np.float32)
    x[-1, 7] = 1
    if len(w.size):
        g = _weaker(gram_odds, w.grams)
        n = np.diff(np.append(w.begin, len(g)))
        x[:-1, 0] = _weaker(word_odds, w.word)
        x[:-1, 1] = np.maximum(x[:-1, 0] - 1, 0)
        x[:-1, 2] = np.add.reduceat(g, w.begin) / n
        x[:-1, 3:6] = np.stack([_weaker(gram_odds, b) for b in w.lead], axis=1)
        x[:-1, 6] = np.maximum(x[:-1, 5] - 1, 0)
    return x


def windows(n: int) -> np.ndarray:
    """First words of the overlapping windows; the last ends with the text."""
    return np.append(np.arange(0, max(n - WINDOW, 0), STEP), max(n - WINDOW, 0))


def window_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window (the padding's is the last), and each text's first window."""
    sizes = np.diff(w.bound)
    starts = [windows(int(n)) for n in sizes]
    first = np.cumsum([0, *map(len, starts)])
    at = np.concatenate([s + b for s, b in zip(starts, w.bound[:-1])])
    end = np.repeat(w.bound[1:], np.diff(first))
    pos = at[:, None] + np.arange(WINDOW)
    pad = len(w.size)
    return np.where(pos < end[:, None], np.append(w.ids, pad)[np.minimum(pos, len(w.ids))], pad), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _dot(w: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """w.T @ columns, each column summed in the same order."""
    out = w[0][:, None] * columns[0]
    part = np.empty_like(out)
    for k in range(1, len(w)):
        np.multiply(w[k][:, None], columns[k], out=part)
        out += part
    return out


class Network:
    """h_t from gates [z, r, n] in both directions; attention over the joined states; one logit."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"a": g(2 * HIDDEN, ATT), "v": g(ATT, 1), "w": g(2 * HIDDEN, 1), "c": np.full(1, -2, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(N_FEATURES, 3 * HIDDEN), f"u{d}": g(HIDDEN, 3 * HIDDEN), f"k{d}": np.zeros(3 * HIDDEN, np.float32)}

    def logits(self, x: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Of windows of words with features x; keep collects what the gradient needs."""
        n, p, H = len(ids), self.p, HIDDEN
        states = np.empty((WINDOW, n, 2 * H), np.float32)
        for k, d in enumerate("fb"):
            table = x @ p[f"x{d}"] + p[f"k{d}"]
            h = np.zeros((n, H), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                i = table[ids[:, t]]
                u = h @ p[f"u{d}"]
                zr = _sigmoid(i[:, : 2 * H] + u[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                m = np.tanh(i[:, 2 * H :] + r * u[:, 2 * H :])
                new = m + z * (h - m)
                if keep is not None:
                    keep.append((d, t, h, z, r, m, u[:, 2 * H :]))
                h = new
                states[t, :, k * H : (k + 1) * H] = h
        e = np.tanh(states @ p["a"])
        s = (e @ p["v"])[..., 0]
        s = np.exp(s - s.max(axis=0))
        s /= s.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", s, states)
        if keep is not None:
            keep.append((states, e, s, pooled))
        return (pooled @ p["w"])[:, 0] + p["c"][0]

    def steady(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """logits() with windows in columns, where no bit of a window's logit depends on the windows beside it, as it may in the products of the linear algebra library."""
        n, p, H = len(ids), self.p, HIDDEN
        at, words = np.ascontiguousarray(ids.T), np.ascontiguousarray(x.T)
        states = np.empty((WINDOW, 2 * H, n), np.float32)
        for k, d in enumerate("fb"):
            table = np.ascontiguousarray((_dot(p[f"x{d}"], words) + p[f"k{d}"][:, None]).T)
            h = np.zeros((H, n), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                i = table[at[t]].T
                u = _dot(p[f"u{d}"], h)
                zr = _sigmoid(i[: 2 * H] + u[: 2 * H])
                m = np.tanh(i[2 * H :] + zr[H:] * u[2 * H :])
                h = m + zr[:H] * (h - m)
                states[t, k * H : (k + 1) * H] = h
        s = np.stack([_dot(p["v"], np.tanh(_dot(p["a"], states[t])))[0] for t in range(WINDOW)])
        s = np.exp(s - s.max(axis=0))
        total, pooled = s[0].copy(), s[0] * states[0]
        for t in range(1, WINDOW):
            total += s[t]
            pooled += s[t] * states[t]
        return _dot(p["w"], pooled / total)[0] + p["c"][0]

    def gradient(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        p, H = self.p, HIDDEN
        out = self.logits(x, ids, keep)
        states, e, s, pooled = keep.pop()
        d = ((_sigmoid(out) - y) * weight / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ d[:, None], "c": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["w"][:, 0]
        ds = np.einsum("tnh,nh->tn", states, dp)
        dl = s * (ds - (s * ds).sum(axis=0))
        g["v"] = np.einsum("tna,tn->a", e, dl)[:, None]
        de = dl[..., None] * p["v"][:, 0] * (1 - e * e)
        g["a"] = np.einsum("tnh,tna->ha", states, de)
        dstates = s[..., None] * dp + de @ p["a"].T
        for k, name in enumerate("fb"):
            gx, gu, gk = (np.zeros_like(p[f"{c}{name}"]) for c in "xuk")
            dh = np.zeros((len(ids), H), np.float32)
            for q, t, h, z, r, m, un in reversed(keep):
                if q != name:
                    continue
                dh = dh + dstates[t, :, k * H : (k + 1) * H]
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dr = dm * un * r * (1 - r)
                gate = np.concatenate((dz, dr, dm * r), axis=1)
                inp = np.concatenate((dz, dr, dm), axis=1)
                gu += h.T @ gate
                gx += x[ids[:, t]].T @ inp
                gk += inp.sum(axis=0)
                dh = dh * z + gate @ p[f"u{name}"].T
            g |= {f"x{name}": gx, f"u{name}": gu, f"k{name}": gk}
        return g


class Model:
    """Tables of log-odds, the network, and the calibration of a text's highest window."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, net: Network, scale: float, shift: float):
        self.word_odds, self.gram_odds, self.net, self.scale, self.shift = word_odds, gram_odds, net, scale, shift

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """The highest window's logit of each text."""
        out = []
        for i, j in chunks(np.array([len(t) for t in texts], np.int64), 512 << 10):
            w = Words.of(texts[i:j])
            x = features(w, self.word_odds, self.gram_odds)
            ids, first = window_ids(w)
            logit = np.concatenate([self.net.steady(x, ids[k : k + 2048]) for k in range(0, len(ids), 2048)])
            out.append(np.maximum.reduceat(logit, first[:-1]))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.scale * self.highest(texts).astype(np.float64) + self.shift)


def _adam(net: Network, g: dict, state: dict, rate: float) -> None:
    state["n"] = n = state.get("n", 0) + 1
    for k, v in g.items():
        m, s = state.get(k, (0.0, 0.0))
        m, s = 0.9 * m + 0.1 * v, 0.99 * s + 0.01 * v * v
        state[k] = m, s
        net.p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.99**n)) + 1e-6)).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 0, epochs: int = 8, batch: int = 192) -> Model:
    """Log-odds, then the network on windows, then the calibration.

    The network sees each half of the texts with the other half's log-odds, as it will see new texts. A toxic text
    teaches by the window that the model finds highest so far, any other by that one and a random one. prior is the
    share of toxic texts, to which the calibration is weighted, as the sample is balanced. Deterministic.
    """
    y = np.asarray(labels) > 0
    own = unlike(texts)
    texts, y = [t for t, k in zip(texts, own) if k], y[own]
    if not len(texts) or y.all() or not y.any():
        net = Network(seed)
        none = np.zeros((2, 1 << BUCKET_BITS), np.float32)
        return Model(none, none, net, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    r = np.random.default_rng(seed)
    fold = np.empty(len(y), np.int64)
    for c in (True, False):
        i = np.flatnonzero(y == c)
        fold[r.permutation(i)] = np.arange(len(i)) % 2
    seen = {(f, c): counts([t for t, a, b in zip(texts, fold, y) if a == f and b == c]) for f in (0, 1) for c in (False, True)}
    size = {(f, c): int(((fold == f) & (y == c)).sum()) for f in (0, 1) for c in (False, True)}
    odds = lambda fs: [log_odds(sum(seen[f, True][k] for f in fs), sum(seen[f, False][k] for f in fs), sum(size[f, True] for f in fs), sum(size[f, False] for f in fs)) for k in (0, 1)]
    parts = []
    for f in (0, 1):
        tables, mine = odds([1 - f]), r.permutation(np.flatnonzero(fold == f))
        for k in range(0, len(mine), 256):  # few texts at once, for memory
            own = mine[k : k + 256]
            w = Words.of([texts[i] for i in own])
            ids, first = window_ids(w)
            parts.append((own, features(w, *tables), ids.astype(np.int32), first))
    net, state = Network(seed), {}
    logit = [(x[ids, 0] + x[ids, 2:6].sum(axis=2)).max(axis=1) for _, x, ids, _ in parts]
    for epoch in range(epochs):
        picks = []
        for f, (own, _, _, first) in enumerate(parts):
            for k, i in enumerate(own):
                a, b = first[k], first[k + 1]
                picks.append((f, a + int(logit[f][a:b].argmax()), y[i]))
                if not y[i]:
                    picks.append((f, int(r.integers(a, b)), False))
        for f in r.permutation(len(parts)).tolist():
            mine = [q for q in picks if q[0] == f]
            order = r.permutation(len(mine))
            for k in range(0, len(order), batch):
                some = [mine[q] for q in order[k : k + batch]]
                t = np.array([q[2] for q in some], np.float32)
                g = net.gradient(parts[f][1], parts[f][2][[q[1] for q in some]], t, np.where(t > 0, 1.5, 1.0).astype(np.float32))
                _adam(net, g, state, 0.02 * 0.8**epoch)
        logit = [np.concatenate([net.logits(x, ids[k : k + 2048]) for k in range(0, len(ids), 2048)]) for _, x, ids, _ in parts]
    top, truth = [], []
    for f, (own, _, _, first) in enumerate(parts):
        top.append(np.maximum.reduceat(logit[f], first[:-1]))
        truth.append(y[own])
    top, truth = np.concatenate(top).astype(np.float64), np.concatenate(truth)
    weight = np.where(truth, prior / truth.mean(), (1 - prior) / (1 - truth.mean()))
    scale, shift = 1.0, 0.0
    for _ in range(60):  # Newton's method, with a little ridge
        q = _sigmoid(scale * top + shift)
        e, v = weight * (q - truth), weight * q * (1 - q) + 1e-9
        h = np.array([[(v * top * top).sum() + 1, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, [(e * top).sum() + (scale - 1), e.sum()])
        scale, shift = max(scale - float(np.clip(d[0], -1, 1)), 1e-3), shift - float(np.clip(d[1], -2, 2))
    return Model(*odds([0, 1]), net, scale, shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, chars: int = TRAIN_CHARS) -> Model:
    """Trains on the driver with at most per_class labelled texts of each class, chosen by a hash of doc_id among those that aren't held out; rows without text or label don't train. A doc_id with several rows trains by the least text."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("y"))
    lab = lab.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    n, pos = lab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0))).first()
    order = F.xxhash64("doc_id")
    # a little more of each class than is used: some texts are too long
    some = lab.where("y").orderBy(order, "doc_id").limit(2 * per_class).union(lab.where("not y").orderBy(order, "doc_id").limit(2 * per_class))
    texts = doc_columns(docs).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = [x for c in (True, False) for x in rows.where(F.col("y") == c).orderBy(order, "doc_id").limit(per_class).collect()]
    return train([x.text.encode() for x in rows], np.array([x.y for x in rows]), pos / n if n else 0.1)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Scores whole texts.

    A row for each row of docs: doc_id, held_out (crc32 of doc_id as text is a multiple of 5; false for null), score in
    0..1, predicted (1 from a score of 0.5). Null or empty text is one window of padding. Labels, lang, source and
    doc_id don't enter a score; equal texts have equal scores. Without labels of both classes every score is the prior.
    """
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        score = b.value.score(binaries(batch.column("text")))
        ids, null = longs(batch.column("doc_id")).tolist(), null_mask(batch.column("doc_id"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([not z and held_out(i) for i, z in zip(ids, null)]), pa.array(score.astype(np.float64)), pa.array((score >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    return map_batches(doc_columns(docs), lambda: run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns stay. Null and empty texts, repeated rows and rows with a null doc_id are scored each for itself."""
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        yield batch.filter(pa.array(b.value.score(binaries(batch.column("text"))) < 0.5))

    return map_batches(docs, lambda: run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
