"""Statistics of whole texts that the quality operators share, a batch at a time in numpy."""

from __future__ import annotations

import numpy as np

from .common import U64, chunks, mix, pair, words_of

WS = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
REPEAT = 8
_IS = {
    "cont": [0x80 <= b < 0xC0 for b in range(256)],
    "ws": [b == 32 or 9 <= b <= 13 for b in range(256)],
    "symbol": [chr(b) in "#*$%&|<>" for b in range(256)],
    "upper": [65 <= b <= 90 for b in range(256)],
    "digit": [48 <= b <= 57 for b in range(256)],
    "punct": [chr(b) in ".,;:!?'\"()-" for b in range(256)],
}
_LUT = {k: np.array(v, np.uint8) for k, v in _IS.items()}
#: Very common short words of the four languages.
COMMON = "the of and to in is that it for was with on be as are this at by der die und das ist von mit den zu auf im de la que el en los las y del se por un una le les et des du est dans pour".split()
_COMMON = np.unique(words_of([" ".join(COMMON).encode()], WS)[3])
EXACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "punct", "line_words", "common", "short", "long", "symbol_words")


def _sums(flag: np.ndarray, bound: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return c[bound[1:]] - c[bound[:-1]]


def repeat_words(h: np.ndarray, owner: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """Which words lie in windows of length words that their text holds twice or more. length is a power of two."""
    out = np.zeros(len(h), bool)
    if len(h) < length:
        return out
    w, k = h, 1
    while k < length:
        w = pair(w[:-k], w[k:])
        k *= 2
    at = np.flatnonzero(owner[: len(w)] == owner[length - 1 :])
    key = pair(w[at], owner[at].astype(np.uint64))
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    twice = np.zeros(len(at), bool)
    twice[o[1:][same]] = True
    twice[o[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + length, -1)
    return np.cumsum(step[:-1]) > 0


def stats(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Exact counts by name, and the matrix of FEATURES."""
    exact: dict[str, list] = {k: [] for k in EXACT}
    rows = []
    for i, j in chunks(np.array([len(t) for t in texts], np.int64), 256 << 10):
        part = texts[i:j]
        _, start, end, h, bound = words_of(part, WS)
        raw = np.frombuffer(b" ".join([*part, b""]), np.uint8)
        size = np.array([len(t) for t in part], np.int64)
        at = np.concatenate(([0], np.cumsum(size + 1)))
        n = np.diff(bound)
        owner = np.repeat(np.arange(len(part)), n)
        count = {k: _sums(v[raw], at) for k, v in _LUT.items()}
        chars = size + 1 - count["cont"] - count["ws"]
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in part]
        n_lines = np.array([len(x) for x in lines])
        dup = n_lines - np.array([len(set(x)) for x in lines])
        rep = _sums(repeat_words(h, owner), bound)
        key = mix(h + owner.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) if len(h) else h
        o = np.argsort(key)
        new = np.concatenate(([True], key[o][1:] != key[o][:-1])) if len(h) else np.zeros(0, bool)
        distinct = np.bincount(owner[o[new]], minlength=len(part))
        width = end - start
        has = np.diff(np.concatenate(([0], np.cumsum(_LUT["symbol"][raw], dtype=np.int64)))[np.stack((start, end))], axis=0)[0] > 0 if len(h) else np.zeros(0, bool)
        for k, v in zip(EXACT, (n, chars, count["symbol"], dup, rep)):
            exact[k].append(v)
        m, c = np.maximum(n, 1), np.maximum(chars, 1)
        cols = (
            n, chars / m, count["symbol"] / c, dup / np.maximum(n_lines, 1), rep / m, distinct / m, count["upper"] / c, count["digit"] / c, count["punct"] / c,
            n / np.maximum(n_lines, 1), _sums(np.isin(h, _COMMON), bound) / m, _sums(width <= 2, bound) / m, _sums(width >= 16, bound) / m, _sums(has, bound) / m,
        )
        rows.append(np.stack([np.asarray(x, np.float64) for x in cols], axis=1))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return {k: cat(v) for k, v in exact.items()}, np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
