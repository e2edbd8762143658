"""N-gram Jaccard join (9): size-banded tiles, hashed bitmap signatures, exact intersections.

A document's set holds its distinct 2-word shingles as 56-bit hashes; two documents link at a Jaccard similarity of
PERCENT / 100 or more. No step forms all pairs of a group of equal documents or compares unrelated ones:

1. Equal sets are one class; a batch sends each of its sets once, with a count. Classes are grouped into blocks.
2. Blocks send their distinct shingles, with counts, to buckets; each gets back the shingle's rounded-down frequency.
3. With shingles ordered from the rarest, linked sets share SHARED - or all their common ones - among the first
   n - ceil(n * PERCENT / 100) + SHARED of each. Those in two or more classes are posted. A posting list is cut where
   sizes differ too much to link. Parts of up to SMALL classes only count their pairs, and a pair needs SHARED counts,
   which chance rarely gives. A larger part is named by its least class, and classes under one name form a tile group.
   Chance repeats grow faster than the input, so pairs travel as sorted 32-bit numbers of classes, some 4 bytes each.
4. Tiles of a group have at most TILE classes, in order of size. Sizes, then the XOR of folded bitmaps bound the
   overlap from above. First only bitmaps go to the tiles, and then, to smaller ones, the sets of the classes that may
   have links, as texts, half their sets' size; those are intersected exactly. Before, a group takes the least name that its classes have, which merges most of
   the groups of one cluster; a pair that still shares several groups counts in the one of the least name.
5. Tiles return, for each class, the number of linked documents and one edge of the tile's spanning forest.

Costs in one group of different, mutually near texts grow with the square of its classes, divided into tiles.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_WS, U64, binaries, bucket_of, chunks, cuts_by, doc_columns, give_back, let_go, longs, map_batches, materialise, mix, null_mask, pair, parts_for, read, runs, text_bytes, widened, words_of

PERCENT = 60
TILE = 2048
#: Bytes of text for each block, each bucket of shingles, and each bucket of postings, which are far fewer than shingles.
BLOCK_BYTES, BUCKET_BYTES, POST_BYTES = 4 << 20, 8 << 20, 64 << 20
#: Edges up to which components are found on the driver; beyond, in Spark.
DRIVER_EDGES = 200_000
WIDTH = 7  # bytes of a shingle's hash
#: Classes in a posting list up to which its pairs are counted, and how many shingles such a pair must share.
SMALL, SHARED = 16, 4
#: What the whole numbers of classes of two blocks differ by.
WHOLE = 1 << 32
#: Postings whose pairs are made at a time.
SLICE = 200_000
_SETS = "h long, n long, text binary, cnt long, mn long"


def pack_set(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


@functools.cache
def _zstd() -> tuple:
    """One of each for a process; they can't be sent to another."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray, width: int) -> bytes:
    """The low width bytes of each number, first all lowest ones, compressed."""
    return _zstd()[0].compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.int64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for i, j in chunks(np.array([len(t) for t in texts], np.int64), 256 << 10):
        _, _, _, h, bound = words_of(texts[i:j], LOWER_WS)
        two = pair(h[:-1], h[1:]) >> U64(8) if len(h) > 1 else h
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a > 1:
                s = np.sort(two[a : b - 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(mix(h[a:b]) >> U64(8))
    return out


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - 2**63


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, n, h of each row's set, and t, a hash of its text."""

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(binaries(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_hash(pack_set(s)) for s in sets], pa.int64()), batch.column("t")], ["doc_id", "n", "h", "t"]
        )

    return map_batches(docs.withColumn("t", F.xxhash64("text")), lambda: run, "doc_id long, n long, h long, t long")


def _sets(docs: DataFrame) -> DataFrame:
    """Each batch's distinct sets, as a text that has it, with the number of documents and the least doc_id. Compressed, a text is half its set's hashes."""

    def run(batch: pa.RecordBatch):
        found: dict[tuple[int, int], list] = {}
        ids, null, texts = longs(batch.column("doc_id")), null_mask(batch.column("doc_id")), binaries(batch.column("text"))
        for s, t, d, z in zip(shingle_sets(texts), texts, ids.tolist(), null.tolist()):
            if len(s):
                x = found.setdefault((_hash(pack_set(s)), len(s)), [t, 0, None])
                x[1] += 1
                if not z:
                    x[2] = d if x[2] is None else min(x[2], d)
        small = zstandard.ZstdCompressor(level=3)
        cols = [[h for h, _ in found], [n for _, n in found], [small.compress(x[0]) for x in found.values()], [x[1] for x in found.values()], [x[2] for x in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["h", "n", "text", "cnt", "mn"])

    return map_batches(docs, lambda: run, _SETS, rows=10_000)


class Block:
    """A block's classes in order of (h, n), and their shingles."""

    def __init__(self, table: pa.Table):
        give_back()
        t = {k: table.column(k).to_pylist() for k in ("h", "n", "text", "cnt", "mn")}
        found: dict[tuple[int, int], list] = {}
        for h, n, text, cnt, mn in zip(*t.values()):
            x = found.setdefault((h, n), [text, 0, None])
            x[1] += cnt
            x[2] = mn if x[2] is None else x[2] if mn is None else min(mn, x[2])
        self.keys = sorted(found)
        self.rows = [found[k] for k in self.keys]
        self.size = np.array([k[1] for k in self.keys], np.int64)
        self.ends = np.cumsum(self.size)
        whole = zstandard.ZstdDecompressor()
        sets = shingle_sets([whole.decompress(r[0]) for r in self.rows])
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    def set(self, i: int) -> np.ndarray:
        return self.tokens[self.ends[i] - self.size[i] : self.ends[i]]

    def distinct(self, buckets: int):
        """Distinct shingles by bucket: their places, counts, the buckets' bounds and each shingle's number."""
        tok, inv, cnt = np.unique(self.tokens, return_inverse=True, return_counts=True)
        b = bucket_of(tok, buckets)
        o = np.argsort(b, kind="stable")
        return tok, inv, cnt, o, cuts_by(b[o])


def _level(df: np.ndarray) -> np.ndarray:
    """Frequencies in 8 bits, in order: exact to 64, then eighths of powers of two."""
    d = df.astype(np.float64)
    return np.where(df <= 64, df, np.minimum(255, 64 + 8 * np.log2(np.maximum(d, 64) / 64))).astype(np.uint8)


def _frequencies(table: pa.Table) -> pa.Table:
    t = {k: table.column(k).to_pylist() for k in table.column_names}
    toks = [np.cumsum(unsqueeze(x, 3)).astype(np.uint32) for x in t["tok"]]
    key, cnt = np.concatenate(toks), np.concatenate([unsqueeze(x, 1) for x in t["cnt"]])
    o = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[o][1:] != key[o][:-1]))
    level = np.empty(len(key), np.uint8)
    level[o] = _level(np.add.reduceat(cnt[o], np.flatnonzero(first)))[np.cumsum(first) - 1]
    ends = np.cumsum([len(x) for x in toks]).tolist()
    return pa.table(
        [pa.array(t["block"], pa.int64()), pa.array(t["bucket"], pa.int64()), pa.array([squeeze(level[i:j], 1) for i, j in zip([0, *ends[:-1]], ends)], pa.binary())],
        names=["block", "bucket", "level"],
    )


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n and a linked one of at most n must share among their first."""
    return np.minimum(SHARED, -(-percent * n // 100))


def _pairs(percent: int, stride: int, blocks: int, heaps: int):
    """Of posting lists, by the heap of x and need: the pairs (x, y) of each class y in a large part named x, need 0; and each pair in a small one, with the shared shingles that are needed."""

    def run(table: pa.Table) -> pa.Table:
        t = {k: table.column(k).to_pylist() for k in table.column_names}
        times = [unsqueeze(x, 4) for x in t["times"]]
        cat = lambda x, each: np.repeat(np.concatenate(x), np.concatenate(each))
        c = cat([b * stride + np.cumsum(unsqueeze(x, 4)) % stride for b, x in zip(t["block"], t["own"])], times)
        n, tok = cat([unsqueeze(x, 4) for x in t["n"]], times), np.frombuffer(b"".join(t["tok"]), np.uint32)
        o = np.lexsort((n, tok))
        tok, c, n = tok[o], c[o], n[o]
        cut = np.concatenate(([True], (tok[1:] != tok[:-1]) | (100 * n[:-1] < percent * n[1:])))
        starts = np.flatnonzero(cut)
        size = np.diff(np.append(starts, len(tok)))
        least, each, end = np.repeat(np.minimum.reduceat(c, starts), size), np.repeat(size, size), np.repeat(starts + size, size)
        out: list[list] = [[], [], [], []]

        def send(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> None:
            for v in np.unique(need).tolist():
                k = np.sort(x[need == v] << 32 | y[need == v], kind="stable") if v else np.unique(x[need == v] << 32 | y[need == v])
                u = k >> 32
                heap, bounds = cuts_by(u // stride * heaps // blocks)
                for h, i, j in zip(heap.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    for col, z in zip(out, (h, v, squeeze(np.diff(u[i:j], prepend=0), 4), squeeze(k[i:j] & 0xFFFFFFFF, 4))):
                        col.append(z)

        keep = each > SMALL
        send(least[keep], c[keep], np.zeros(int(keep.sum()), np.int64))
        few = np.flatnonzero(~keep)
        for lo in range(0, len(few), SLICE):
            act, rows = few[lo : lo + SLICE], [np.zeros((3, 0), np.int64)]
            for gap in range(1, SMALL):  # in a part of SMALL, pairs are at most SMALL - 1 apart
                act = act[act + gap < end[act]]
                i = act[100 * n[act] >= percent * n[act + gap]] if len(act) else act
                j = i + gap
                rows.append(np.stack((np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), _need(n[j], percent))))
            send(*np.concatenate(rows, axis=1))
        return pa.table([pa.array(z, k) for z, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["heap", "need", "x", "y"])

    return run


def _named(stride: int):
    """(m, c) of each class c in a large part named m, or in a pair that shares enough, m the lesser; the group's tiles and the block of c. All that is named m is in one heap."""

    def run(table: pa.Table) -> pa.Table:
        need, xs, ys = table.column("need").to_numpy(), table.column("x").to_pylist(), table.column("y").to_pylist()
        found = []
        for v in np.unique(need).tolist():
            at = np.flatnonzero(need == v).tolist()
            k = np.concatenate([np.cumsum(unsqueeze(xs[i], 4)) << 32 | unsqueeze(ys[i], 4) for i in at])
            k.sort()
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            found.append(k[first[np.diff(np.append(first, len(k))) >= v]])
        k = np.concatenate(found)
        x = np.unique(k >> 32)
        k = np.unique(np.concatenate((k, x << 32 | x)))
        m, c = k >> 32, k & 0xFFFFFFFF
        tiles = -(-np.unique(m, return_counts=True)[1] // TILE)
        return pa.table([m, c, tiles[np.searchsorted(x, m)], c // stride], names=["m", "c", "tiles", "block"])

    return run


def width_for(n: int) -> int:
    """Bits of the bitmap of n shingles: at least 2 n, so that unlike sets are told apart."""
    return max(256, 1 << int(2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the shingles that hash to each of the bits; folding halves by XOR gives the shorter bitmap."""
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Bounds:
    """Which pairs of sets, in order of size, may overlap enough: an overlap is at most (n_i + n_j - ones of the XOR) / 2."""

    def __init__(self, n: np.ndarray, maps: list[np.ndarray], percent: int):
        self.n, self.maps, self.percent = n, maps, percent
        self.width = np.array([len(m) for m in maps])
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.by_width:
            at, rows = np.full(len(self.maps), -1), []
            for i in np.flatnonzero(self.width >= width).tolist():
                m = self.maps[i]
                while len(m) > width:
                    m = m[: len(m) // 2] ^ m[len(m) // 2 :]
                at[i] = len(rows)
                rows.append(m)
            self.by_width[width] = at, np.stack(rows)
        return self.by_width[width]

    def may(self, i: int, j: np.ndarray) -> np.ndarray:
        at, rows = self._folded(int(self.width[i]))
        ones = np.bitwise_count(rows[at[j]] ^ rows[at[i]]).sum(axis=1, dtype=np.int64)
        total = self.n[i] + self.n[j]
        most = (total - ones) // 2
        return 100 * most >= self.percent * (total - most)


def partners(n: np.ndarray, side: np.ndarray | None, percent: int):
    """(i, the j > i of a size that can link), in order of size; with side only between unlike sides."""
    hi = np.searchsorted(percent * n, 100 * n, side="right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, hi[i])
        if side is not None:
            j = j[side[j] != side[i]]
        if len(j):
            yield i, j


def shared(mine: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many shingles of one sorted set each of others, sorted sets that begin at starts, has."""
    at = np.searchsorted(mine, others)
    at[at == len(mine)] = 0
    return np.add.reduceat(mine[at] == others, starts, dtype=np.int64)


class Tile:
    """Finds the links within rows, or between the rows before and from split on."""

    def __init__(self, m: int, h: np.ndarray, n: np.ndarray, side: np.ndarray | None, names: list[np.ndarray], sets: list[np.ndarray], percent: int):
        self.o = np.lexsort((h, n))
        self.m, self.h, self.n = m, h[self.o], n[self.o]
        self.side = None if side is None else side[self.o]
        self.names, self.sets, self.percent = [names[i] for i in self.o], [sets[i] for i in self.o], percent

    def links(self):
        """Pairs (i, array of j > i) in the order of size."""
        n, percent = self.n, self.percent
        flat, ends = np.concatenate(self.sets), np.concatenate(([0], np.cumsum(n)))
        lower: dict[int, list[int]] = {}
        for i, names in enumerate(self.names):
            for x in names[names < self.m].tolist():
                lower.setdefault(x, []).append(i)
        done: dict[int, list[np.ndarray]] = {}
        for members in lower.values():
            arr = np.array(members)
            for k, i in enumerate(members[:-1]):
                done.setdefault(i, []).append(arr[k + 1 :])
        bounds = Bounds(n, [bitmap(s, width_for(len(s))) for s in self.sets], percent)
        for i, j in partners(n, self.side, percent):
            if i in done:
                j = np.setdiff1d(j, np.concatenate(done[i]))
            if len(j):
                j = j[bounds.may(i, j)]
            if not len(j):
                continue
            mine = self.sets[i]
            if 2 * len(j) > j[-1] + 1 - j[0]:
                a, b = j[0], j[-1] + 1
                common = shared(mine, flat[ends[a] : ends[b]], ends[a:b] - ends[a])[j - a]
            else:
                common = shared(mine, np.concatenate([self.sets[x] for x in j.tolist()]), np.cumsum(n[j]) - n[j])
            j = j[100 * common >= percent * (n[i] + n[j] - common)]
            if len(j):
                yield i, j


def _tiles(table: pa.Table):
    """Rows of each tile with two rows or more, and its sides where it lies between two parts of a group."""
    m, a, b, side = (table.column(k).to_numpy() for k in ("m", "a", "b", "side"))
    o = np.lexsort((b, a, m))
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(m[o]) != 0) | (np.diff(a[o]) != 0) | (np.diff(b[o]) != 0), [True])))
    for x, y in zip(cut[:-1], cut[1:]):
        r = o[x:y]
        if len(r) > 1:
            yield int(m[r[0]]), r, side[r] if a[r[0]] != b[r[0]] else None


def _sift(percent: int):
    """By bitmaps alone: the classes of each group that may have a link in it."""

    def run(table: pa.Table) -> pa.Table:
        c, n = (table.column(k).to_numpy() for k in ("c", "n"))
        maps = table.column("map").to_pylist()
        out: list[list] = [[], []]
        for m, r, side in _tiles(table):
            r, side = (r[(s := np.lexsort((c[r], n[r])))], None if side is None else side[s])
            bounds, keep = Bounds(n[r], [np.frombuffer(maps[k], np.uint64) for k in r], percent), np.zeros(len(r), bool)
            for i, j in partners(n[r], side, percent):
                j = j[bounds.may(i, j)]
                if len(j):
                    keep[i] = True
                    keep[j] = True
            for col, v in zip(out, ([m] * int(keep.sum()), c[r[keep]].tolist())):
                col += v
        return pa.table([pa.array(v, pa.int64()) for v in out], names=["m", "c"])

    return run


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        h, n, cnt = (table.column(k).to_numpy() for k in ("h", "n", "cnt"))
        texts, names = table.column("text").to_pylist(), table.column("names").to_pylist()
        out: list[list] = [[], [], [], []]
        for m, r, side in _tiles(table):
            sets = shingle_sets([_zstd()[1].decompress(texts[k]) for k in r])
            t = Tile(m, h[r], n[r], side, [np.frombuffer(names[k], np.int64) for k in r], sets, percent)
            weight, links, root = cnt[r][t.o], np.zeros(len(r), np.int64), list(range(len(r)))

            def find(u: int) -> int:
                while root[u] != u:
                    root[u] = root[root[u]]
                    u = root[u]
                return u

            for i, j in t.links():
                links[i] += weight[j].sum()
                links[j] += weight[i]
                u = find(i)
                for k in j.tolist():
                    v = find(k)
                    if u != v:
                        root[max(u, v)] = u = min(u, v)
            for k in np.flatnonzero(links).tolist():
                for col, v in zip(out, (int(t.h[k]), int(t.n[k]), int(links[k]), int(t.h[find(k)]))):
                    col.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["h", "n", "links", "root"])

    return run


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """(h, n, links, root) of each class in each tile where it has links."""
    _, size = text_bytes(docs)
    blocks, buckets, heaps, tasks = (parts_for(size, x) for x in (*widened(size, BLOCK_BYTES, BUCKET_BYTES), POST_BYTES, BUCKET_BYTES / 4))
    stride = (1 << 31) // blocks  # a class is known by its block and its number there; more classes in a block would share numbers, and then be compared too
    grouped = _sets(docs).withColumn("block", F.pmod(F.col("h"), F.lit(blocks))).groupBy("block")

    def count(key, table):
        b = Block(table)
        tok, _, cnt, o, (bucket, bounds) = b.distinct(buckets)
        t = tok[o] >> U64(32)  # 24 bits, in order within a bucket; equal keys of unlike shingles only make these seem more frequent
        c = np.minimum(cnt[o], 255).astype(np.uint8)
        parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table(
            [pa.array(bucket), pa.array([key[0].as_py()] * len(bucket), pa.int64()), pa.array([squeeze(np.diff(t[i:j], prepend=U64(0)), 3) for i, j in parts], pa.binary()), pa.array([squeeze(c[i:j], 1) for i, j in parts], pa.binary())],
            names=["bucket", "block", "tok", "cnt"],
        )

    def post(key, table, replies):
        b = Block(table)
        tok, inv, _, o, (bucket, bounds) = b.distinct(buckets)
        got = [r["level"] for r in sorted(replies.to_pylist(), key=lambda r: r["bucket"])]
        if len(got) != len(bucket):
            raise RuntimeError(f"{len(got)} replies for {len(bucket)} buckets")
        level = np.empty(len(tok), np.uint8)
        level[o] = np.concatenate([unsqueeze(x, 1) for x in got])
        order = level[inv].astype(np.uint64) << U64(56) | b.tokens
        prefix = np.minimum(b.size - -(-percent * b.size // 100) + SHARED, b.size)
        once = np.add.reduceat(level[inv] == 1, b.ends - b.size, dtype=np.int64)
        toks, owner = [], []
        for i in np.flatnonzero(once < prefix).tolist():
            first = np.sort(order[b.ends[i] - b.size[i] : b.ends[i]])[once[i] : prefix[i]]
            toks.append(first & U64((1 << 56) - 1))
            owner.append(np.full(len(first), i))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        t, own = cat(toks, np.uint64), cat(owner, np.int64)
        k = bucket_of(t, heaps)
        s = np.argsort(k, kind="stable")  # classes stay together within a bucket
        bucket, bounds = cuts_by(k[s])
        # unlike shingles whose 32 bits agree in a bucket only bring a class more to compare
        t, own = (t[s] >> U64(24)).astype(np.uint32), own[s]
        rows = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c, times = runs(own[i:j])
            rows.append((t[i:j].tobytes(), squeeze(np.diff(c, prepend=0), 4), squeeze(b.size[c], 4), squeeze(times, 4)))
        return pa.table([pa.array(bucket), pa.array([key[0].as_py()] * len(bucket), pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(4))], names=["bucket", "block", "tok", "own", "n", "times"])

    def deal(kinds: list, names: list[str], step: int, more):
        """Sends each wanted class to the tiles of its group: all pairs of parts that hold its own. step: by how much the numbers c of two blocks differ."""

        def run(key, table, wanted):
            b = Block(table)
            block = key[0].as_py()
            out: list[list] = [[] for _ in range(6 + len(kinds))]
            rows = [(r["m"], i, r["tiles"]) for r in wanted.to_pylist() for i in range(r["c"] - block * step, len(b.keys), step)]
            groups: dict[int, list[int]] = {}
            for m, i, _ in rows:
                groups.setdefault(i, []).append(m)
            extra = {i: more(b, i, v) for i, v in groups.items()}
            for m, i, tiles in rows:
                c = block * WHOLE + i
                side = c % tiles
                for other in range(tiles):
                    for col, v in zip(out, (m, min(side, other), max(side, other), c, b.keys[i][1], side, *extra[i])):
                        col.append(v)
            return pa.table([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 6 + kinds)], names=["m", "a", "b", "c", "n", "side", *names])

        return run

    def with_map(b: Block, i: int, groups: list[int]) -> tuple:
        return (bitmap(b.set(i), width_for(int(b.size[i]))).tobytes(),)

    def with_text(b: Block, i: int, groups: list[int]) -> tuple:
        return b.keys[i][0], b.rows[i][1], b.rows[i][0], np.array(sorted({*groups}), np.int64).tobytes()

    counts = grouped.applyInArrow(count, "bucket long, block long, tok binary, cnt binary")
    levels = counts.groupBy("bucket").applyInArrow(_frequencies, "block long, bucket long, level binary")
    posts = grouped.cogroup(levels.groupBy("block")).applyInArrow(post, "bucket long, block long, tok binary, own binary, n binary, times binary")
    pairs = posts.groupBy("bucket").applyInArrow(_pairs(percent, stride, blocks, heaps), "heap long, need long, x binary, y binary")
    named = pairs.groupBy("heap").applyInArrow(_named(stride), "m long, c long, tiles long, block long")
    task = F.pmod(F.xxhash64("m", "a", "b"), F.lit(tasks)).alias("task")
    place = "m long, a long, b long, c long, n long, side long"
    maps = grouped.cogroup(named.groupBy("block")).applyInArrow(deal([pa.binary()], ["map"], stride, with_map), f"{place}, map binary")
    likely = maps.groupBy(task).applyInArrow(_sift(percent), "m long, c long").distinct()
    # windows, as a join with its own sums would run all of the above again
    likely = likely.withColumn("l", F.min("m").over(Window.partitionBy("c"))).select(F.min("l").over(Window.partitionBy("m")).alias("m"), "c").distinct()
    likely = likely.withColumn("tiles", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("m")) / TILE).cast("long")).withColumn("block", F.shiftright("c", 32))
    sets = grouped.cogroup(likely.groupBy("block")).applyInArrow(deal([pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["h", "cnt", "text", "names"], WHOLE, with_text), f"{place}, h long, cnt long, text binary, names binary")
    return sets.groupBy(task).applyInArrow(_compare(percent), "h long, n long, links long, root long")


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(h, comp) for each node of edges (h, root): comp is the least node reachable.

    Up to driver_edges edges by union-find on the driver; beyond, by least neighbours and pointer jumping in Spark.
    """
    spark = edges.sparkSession
    e = edges.where("h <> root").distinct()
    nodes = edges.select("h").union(edges.select(F.col("root").alias("h"))).distinct()
    if e.limit(driver_edges + 1).count() <= driver_edges:
        root: dict[int, int] = {}

        def find(u: int) -> int:
            while root.setdefault(u, u) != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        for r in e.collect():
            u, v = find(r.h), find(r.root)
            root[max(u, v)] = min(u, v)
        found = spark.createDataFrame([(u, find(u)) for u in list(root)], "h long, comp long")
        return nodes.join(found, "h", "left").select("h", F.coalesce("comp", "h").alias("comp"))
    both = materialise(e.union(e.select("root", "h")).toDF("u", "v").distinct(), "edges")
    comp = materialise(nodes.withColumn("comp", F.col("h")), "components")
    while True:
        near = both.join(comp, both.v == comp.h).groupBy("u").agg(F.min("comp").alias("near"))
        step = comp.join(near, comp.h == near.u, "left").select("h", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("c"))
        up = step.select(F.col("h").alias("uh"), F.col("c").alias("up"))
        new = materialise(step.join(up, step.c == up.uh, "left").select("h", "old", F.least("c", F.coalesce("up", "c")).alias("comp")), "components")
        comp = new.select("h", "comp")
        if not new.where("old <> comp").limit(1).count():
            return comp


def _classes(docs: DataFrame, percent: int, driver_edges: int) -> tuple[DataFrame, DataFrame]:
    """_members(), and of those with a shingle: doc_id, n, t, n_similar, comp (the component's name), component_id."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    d = doc_columns(docs)
    members = materialise(_members(d), "members")
    tiles = materialise(_linked(d, percent), "links")
    sums = tiles.groupBy("h", "n").agg(F.sum("links").alias("links"))
    comp = components(tiles.select("h", "root"), driver_edges)
    classes = members.where("n > 0").groupBy("h", "n").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("mn"))
    rows = classes.join(sums, ["h", "n"], "left").join(comp, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    rows = materialise(rows.select("h", "n", "cnt", "comp", "mn", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_similar")), "classes")
    least = rows.groupBy("comp").agg(F.min("mn").alias("component_id"))
    rows = rows.join(least, "comp").select("h", "n", "cnt", "n_similar", "comp", "component_id")
    # classes of over a thousandth of all rows: a thousand at most, so they fit a broadcast, and no task gets a hot one
    hot_from = max(1000, members.count() // 1000)
    hot = F.broadcast(rows.where(F.col("cnt") > hot_from))
    cold = rows.where(F.col("cnt") <= hot_from)
    m = members.where("n > 0")
    found = m.join(hot, ["h", "n"]).unionByName(m.join(hot.select("h", "n"), ["h", "n"], "left_anti").join(cold, ["h", "n"]))
    return members, found.drop("h", "cnt")


def jaccard_links(docs: DataFrame, percent: int = PERCENT, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """Links of whole texts by their sets of 2-word shingles, A-Z lower-cased.

    A row for each row of docs: doc_id, n_shingles, n_similar (other rows it links with), component_id (the least
    doc_id reachable by links). One word is a set by itself. A null, empty or blank text links with nothing. A row with
    a null doc_id takes part; it counts as similar and gives no id to its component, which is null if all ids are.
    Repeated rows link with each other like others. Other columns of docs don't matter. 1 <= percent <= 100.
    """
    members, found = _classes(docs, percent, driver_edges)
    none = members.where("n = 0").select("doc_id", "n", F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n", "n_similar", "component_id").unionByName(none).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, percent: int = PERCENT, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """docs with one row of each group that links connect, of the least doc_id; all columns stay.

    Rows are told apart by doc_id and text: unlike texts of one doc_id are decided each by its own group. Of a group's
    rows with the least doc_id one text stays, that of the least hash, and of equal rows with that text any one. Rows
    that link with nothing stay, null, empty and blank texts among them, and so do rows with a null doc_id, which
    no id can name: a group of such rows alone is left whole.
    """
    found = _classes(docs, percent, driver_edges)[1].where("doc_id is not null").select("doc_id", "t", "comp", "component_id")
    found = materialise(found.groupBy("doc_id", "t", "comp", "component_id").agg(F.count(F.lit(1)).alias("same")), "groups")
    let_go(docs.sparkSession)  # what was shuffled to compare documents, before they are shuffled themselves
    own = found.where("doc_id = component_id").groupBy(F.col("comp").alias("c")).agg(F.min("t").alias("kept"))
    found = found.join(own, F.col("comp") == F.col("c"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("t") == F.col("kept"))
    key = [F.col("doc_id").alias("__id"), F.col("t").alias("__t")]
    gone = found.where(~stays).select(*key)
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__t"))
    left = docs.join(gone, same, "left_anti")
    twice = found.where(stays & (F.col("same") > 1)).select(*key)
    if not twice.limit(1).count():
        return left
    # equal rows: a hash of each, so that one row of a hot one is chosen before the shuffle
    once = left.join(twice, same, "left_semi").withColumns({"__id": F.col("doc_id"), "__t": F.xxhash64("text")}).groupBy("__id", "__t").agg(F.first(F.struct(*docs.columns)).alias("r"))
    return left.join(twice, same, "left_anti").unionByName(once.select(*(F.col(f"r.`{c}`").alias(c) for c in docs.columns)))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
ORACLE = {
    "op9_ngram_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS x FROM d),
t AS MATERIALIZED (SELECT doc_id, len(x) AS n, unnest(x) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (na + nb - c)),
r AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT e.a, r.c FROM r JOIN e ON r.a = e.b WHERE r.c < e.a)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, (SELECT count(*) FROM e WHERE e.a = s.doc_id)::BIGINT AS n_similar,
  (SELECT min(c) FROM r WHERE r.a = s.doc_id)::BIGINT AS component_id FROM s
"""
}
