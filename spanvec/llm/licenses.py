"""License scans (3): exact phrases, and short notices with edits found by pigeonhole seeds and verified by regex."""

from __future__ import annotations

import bisect
import heapq

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, binaries, doc_columns, map_batches, read

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices that may hold edits, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("released under the mpl license", "mpl"),
    ("released under the bsd license", "bsd"),
    ("released under the isc license", "isc"),
    ("released under the gpl license", "gpl"),
    ("released under the apache license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("creative commons attribution", "cc"),
    ("licensed under creative commons", "cc"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
#: Words that name a license. Where a notice has one, a match has it too: without an edit up to four letters, else with one at most.
NAMING = frozenset("mit mpl bsd isc gpl gnu apache lesser affero mozilla creative commons".split())
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12


def edits(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return max(1, len(notice) // chars_per_edit)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces: k edits leave one of them whole."""
    cuts = np.linspace(0, len(notice), k + 2).astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def least_edits(masks: dict[str, int], n: int, text: str) -> int:
    """The fewest edits between a pattern of n characters, given by their places' bits, and any part of text; bit-parallel, so that the regex library only sees where it will match."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(h | up) & full, up & h
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise, fall = rise << 1 & full, fall << 1 & full
        up, down = fall | ~(v | rise) & full, rise & v
    return best


class Scanner:
    """One automaton over delimited phrases and seeds; a compiled bounded-error pattern for each notice."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        # edits are of code points, so texts are scanned decoded
        self.phrases, self.notices = phrases, notices
        self.k = [edits(n, chars_per_edit) for n, _ in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for (n, _), k in zip(notices, self.k)]
        self.masks = [{c: sum(1 << x for x, y in enumerate(n) if y == c) for c in set(n)} for n, _ in notices]
        self.naming = [[regex.compile(f"(?<![a-z0-9]){w}(?![a-z0-9])" if len(w) <= 4 else f"(?:{w}){{e<=1}}") for w in n.split() if w in NAMING] for n, _ in notices]
        words: dict[str, list] = {}
        for i, (p, _) in enumerate(phrases):
            words.setdefault(f" {p} ", []).append((True, i, len(p) + 2))
        for i, (n, _) in enumerate(notices):
            for off, s in pieces(n, self.k[i]):
                words.setdefault(s, []).append((False, i, off + len(s)))
        self.a = ahocorasick.Automaton()
        for w, v in words.items():
            self.a.add_word(w, v)
        self.a.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float]], str]:
        """Number of words, phrase places (word, label), notice matches (start, stop in the normalised text, label, edits, score), that text."""
        w = text.translate(ALNUM).split()
        u = (b" " + b" ".join(w) + b" ").decode("utf-8", "surrogateescape")
        base, seeds = [], {}
        for end, values in self.a.iter(u) if w else ():
            for whole, i, n in values:
                if whole:
                    base.append((end - n + 1, self.phrases[i][1]))
                else:
                    seeds.setdefault(i, []).append(end + 1 - n)
        if base:
            spaces = np.flatnonzero(np.frombuffer(u.encode("latin-1"), np.uint8) == 32 if u.isascii() else np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            base = [(int(x), lab) for x, (_, lab) in zip(np.searchsorted(spaces, [p for p, _ in base]), base)]
        return len(w), base, [m for i, at in seeds.items() for m in self.verify(u, i, sorted(at)) if self.named(u, i, m[0], m[1])], u

    def named(self, u: str, i: int, a: int, b: int) -> bool:
        """Whether the words of u[a:b] have the notice's naming words."""
        whole = u[u.rfind(" ", 0, a + 1) : u.find(" ", max(a, b - 1)) + 1]
        return all(w.search(whole) for w in self.naming[i])

    def verify(self, u: str, i: int, at: list[int]) -> list[tuple[int, int, str, int, float]]:
        """Matches apart from each other: the one of fewest edits first, then the first, then what stands before and behind those taken."""
        notice, label = self.notices[i]
        k, n = self.k[i], len(notice)
        heap: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []
        found: list[tuple[int, int, str, int, float]] = []

        def search(lo: int, hi: int) -> None:
            if hi - lo >= n - k and least_edits(self.masks[i], n, u[lo:hi]) <= k and (m := self.patterns[i].search(u, lo, hi)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

        p = u.find(notice)
        while p >= 0:  # none is better than an unedited one
            taken.append((p, p + n))
            found.append((p, p + n, label, 0, 1.0))
            p = u.find(notice, p + n)
        for a in dict.fromkeys(at):  # a match holds a seed, so it lies in that seed's window
            lo, hi = max(a - k, 0), min(a + n + k, len(u))
            x = bisect.bisect_left(taken, (lo, lo))
            near = [t for t in taken[max(x - 1, 0) : bisect.bisect_left(taken, (hi, hi))] if t[1] > lo]
            for c, d in zip([lo, *(t[1] for t in near)], [*(t[0] for t in near), hi]):
                search(c, d)
        while heap:
            e, a, b, lo, hi = heapq.heappop(heap)
            x = bisect.bisect_left(taken, (lo, lo))
            near = [t for t in taken[max(x - 1, 0) : bisect.bisect_left(taken, (hi, hi))] if t[1] > lo]
            if all(b <= c or d <= a for c, d in near):
                bisect.insort(taken, (a, b))
                found.append((a, b, label, e, 1 - e / n))
            else:
                for c, d in zip([lo, *(t[1] for t in near)], [*(t[0] for t in near), hi]):
                    search(c, d)
        return sorted(found)


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT, spans: bool = False) -> DataFrame:
    """Finds license phrases and slightly changed notices in whole texts.

    A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_fuzzy, and
    with spans=True the verified notices as ranges of words [start_word, stop_word) with label, edits and score. score:
    1 where a phrase stands, else the best notice's share of unedited characters, else 0. Null text is empty: no words,
    zero counts, null places, empty labels. A notice whose naming word is changed is none. Repeated rows are scanned each for itself; other columns don't matter.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_fuzzy long"
    span_type = pa.list_(pa.struct([("start_word", pa.int64()), ("stop_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("score", pa.float64())]))
    if spans:
        schema += ", spans array<struct<start_word:long,stop_word:long,label:string,edits:long,score:double>>"

    def make():
        scanner = Scanner(phrases, notices, chars_per_edit)

        def run(batch: pa.RecordBatch):
            rows, where = [], []
            for t in binaries(batch.column("text")):
                n, base, fuzzy, u = scanner.scan(t)
                at = [p for p, _ in base]
                own = sorted({x for _, x in base})
                both = sorted({*own, *(x[2] for x in fuzzy)})
                rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(own), ",".join(both), 1.0 if base else max((x[4] for x in fuzzy), default=0.0), len(fuzzy)))
                if spans:
                    where.append([{"start_word": u.count(" ", 0, a + 1) - 1, "stop_word": u.count(" ", 0, max(a, b - 1)), "label": lab, "edits": e, "score": sc} for a, b, lab, e, sc in fuzzy])
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(), pa.int64()))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_fuzzy"]
            if spans:
                cols.append(pa.array(where, span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", *names])

        return run

    return map_batches(doc_columns(docs), make, schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


QUERIES = {"op3_licenses": op3_licenses}
ORACLE: dict[str, str] = {}
