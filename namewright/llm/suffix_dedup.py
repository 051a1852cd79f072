r"""Suffix-array dedup: every byte covered by a 200-byte string that also starts elsewhere is removed.

Only suffixes that can matter are sorted. In each window of WIDTH bytes the GRAM-byte string with the least hash is the
window's anchor (the leftmost of equal ones), so that equal windows have equal anchors at equal offsets. Anchors whose hash
occurs once in the corpus are dropped, and with them every window they stand for. The suffixes at the remaining anchors,
cut where their windows end, are sorted by a distributed merge sort:

- each task sorts its own suffixes into runs, dealt by shard (anchor hash), and front-codes them: the length of the prefix
  shared with the suffix before, then the rest. Suffixes that are equal with all their windows travel once;
- each shard's runs are merged by a loser tree that keeps, for every loser, its common prefix with the suffix that beat it,
  and compares only from there on, never a byte that is known to be equal.

The merged order gives each suffix its longest common prefix with any other, hence how far to the left of the anchor a
window must start to be repeated at all; those windows are sorted by digests of their 200 bytes and compared. An anchor that is very
frequent is cut into blocks of windows, each dealt by the digest of the bytes that its windows share, so that a common
passage with different surroundings spreads over many shards.

Scale: anchors are one in about 70 bytes, and only their hashes are shuffled over the whole corpus, counted before they are
joined, the commonest by a broadcast of bounded size; suffixes travel only for repeated anchors. What is found in a text meets it by a join on the row number, twice, with the texts compressed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, join_by_counts, stage_table, table

WIDTH, GRAM = 200, 64
REACH = WIDTH - GRAM  # an anchor starts at most so many bytes after its window
HOT, HOT_BLOCK = 20_000, 16
RUN_SUFFIXES, SHARD_SUFFIXES = 60_000, 30_000
CHUNK = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_ZOBRIST = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Roller:
    """Digests of all strings of a length, by prefix sums modulo 2^64."""

    def __init__(self, n: int):
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def digests(self, data: np.ndarray, length: int) -> np.ndarray:
        """Along the last axis."""
        n = data.shape[-1]
        sums = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.cumsum(_ZOBRIST[data] * self.up[:n], axis=-1, out=sums[..., 1:])
        x = (sums[..., length:] - sums[..., :-length]) * self.down[: n - length + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, _MASK, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, roll: _Roller) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) for the windows of data, each window under one anchor."""
    low = np.uint64((1 << 24) - 1)
    h = roll.digests(data, GRAM)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH + 1) & low
    at = np.flatnonzero(np.diff(least, prepend=np.uint64(1 << 63)))
    a = least[at].astype(np.int64)
    return h[a], a, at, np.append(at[1:], len(least)) - 1


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _packed_rows(keys: np.ndarray, rows: np.ndarray, places: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One record a (key, row): key, row, and its places as one string of 12 bytes each."""
    order = np.lexsort((keys, rows))
    keys, rows, places = keys[order], rows[order], np.ascontiguousarray(places[order], "<i4")
    first = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(rows, prepend=~rows[:1]) != 0))
    offsets = np.append(first, len(keys)).astype(np.int32) * 12
    return pa.RecordBatch.from_arrays([pa.array(keys[first], pa.int64()), pa.array(rows[first], pa.int64()), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(places)])], names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roll = _Roller(CHUNK + WIDTH)
    for b in batches:
        out = []
        for row, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = np.frombuffer(_bytes(text.as_py()), np.uint8)
            for c in range(0, len(data) - WIDTH + 1, CHUNK):
                h, a, p1, p2 = anchors(data[c : c + CHUNK + WIDTH - 1], roll)
                out.append((h.view(np.int64), np.full(len(a), row, np.int64), np.stack([a, p1, p2], axis=1) + c))
        if out:
            yield _packed_rows(*(np.concatenate(x) for x in zip(*out)), ["h", "row", "places"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, for the shuffle."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(_bytes(t.as_py())) for t in b.column(1)], pa.binary())], ["row", "packed"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return (z.decompress(x.as_py()) for x in column)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Of two strings that agree in the first `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string, payload) into one such sequence."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs, self.n = runs, 1 << max(0, math.ceil(math.log2(max(1, len(runs)))))
        self.prefix, self.string, self.load = [-1] * self.n, [b""] * self.n, [None] * self.n
        self.loser = [-1] * self.n
        for r in range(len(runs)):
            self._next(r)
            if self.prefix[r] > 0:
                self.prefix[r] = 0
        self.winner = self._play(1)

    def _next(self, r: int) -> None:
        """An ended run has prefix -1, which loses against every other."""
        self.prefix[r], self.string[r], self.load[r] = next(self.runs[r], (-1, b"", None))

    def _beats(self, x: int, y: int) -> bool:
        """Whether x comes first; the prefixes are those with the last string put out. Sets the loser's to that with the winner."""
        p, q = self.prefix[x], self.prefix[y]
        if p != q:
            return p > q
        if p < 0:
            return True
        a, b = self.string[x], self.string[y]
        n = common_prefix(a, b, p)
        first = len(a) <= len(b) if n in (len(a), len(b)) else a[n] < b[n]
        self.prefix[y if first else x] = n
        return first

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        x, y = self._play(2 * node), self._play(2 * node + 1)
        w = x if self._beats(x, y) else y
        self.loser[node] = y if w == x else x
        return w

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.prefix[self.winner] >= 0:
            w = self.winner
            yield self.prefix[w], self.string[w], self.load[w]
            self._next(w)
            node = (w + self.n) >> 1
            while node:
                if not self._beats(w, self.loser[node]):
                    w, self.loser[node] = self.loser[node], w
                node >>= 1
            self.winner = w


_RUN = "shard int, row long, p1 int, p2 int, prefixes binary, lengths binary, rests binary, lefts binary, places binary"


def _suffix_runs(n_shards: int):
    """Rows with a row number are windows known to be repeated; the others are runs of a shard."""
    import xxhash
    import zstandard

    def flush(held: list) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=3)
        held.sort(key=lambda x: x[:3])
        cols = [[] for _ in range(9)]
        i = 0
        while i < len(held):
            shard, last, n = held[i][0], None, 0
            prefixes, rests, lefts, places = [], [], [], []
            while i < len(held) and held[i][0] == shard:
                _, s, left, row, a, p1, p2 = held[i]
                j = i + 1
                while j < len(held) and held[j][:3] == (shard, s, left):
                    j += 1
                if j > i + 1:
                    for x in held[i:j]:
                        for c, v in zip(cols, (shard, x[3], x[5], x[6], None, None, None, None, None)):
                            c.append(v)
                n = 0 if last is None else common_prefix(last, s)
                prefixes.append(n)
                rests.append(s[n:])
                lefts.append(left)
                places.append((row, a, p1, p2))
                last, i = s, j
            load = (np.array(prefixes, "<u1").tobytes(), np.array([(len(r), len(x)) for r, x in zip(rests, lefts)], "<u1").tobytes(), b"".join(rests), b"".join(lefts), np.array(places, "<i8").tobytes())
            load = tuple(map(z.compress, load))
            for c, v in zip(cols, (shard, None, None, None, *load)):
                c.append(v)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for row, data, found in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2)):
                for x in found.as_py():
                    for a, p1, p2 in np.frombuffer(x["places"], "<i4").reshape(-1, 3).tolist():
                        if not x["hot"]:
                            held.append((x["h"] % n_shards, data[a : p2 + WIDTH], data[p1:a], row, a, p1, p2))
                            continue
                        for k in range((a - p2) // HOT_BLOCK, (a - p1) // HOT_BLOCK + 1):
                            q = a - k * HOT_BLOCK
                            first, end = max(p1, q - HOT_BLOCK + 1), min(p2, q)
                            shard = xxhash.xxh64_intdigest(data[q : q + WIDTH - HOT_BLOCK + 1], k) % n_shards
                            held.append((shard, data[a : end + WIDTH], data[first:a], row, a, first, end))
                if len(held) >= RUN_SUFFIXES:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _decoded(prefixes: bytes, lengths: bytes, rests: bytes, lefts: bytes, places: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    s, at, left_at = b"", 0, 0
    for n, (m, k), place in zip(prefixes, np.frombuffer(lengths, "<u1").reshape(-1, 2).tolist(), np.frombuffer(places, "<i8").reshape(-1, 4).tolist()):
        s = s[:n] + rests[at : at + m]
        yield n, s, (lefts[left_at : left_at + k], *place)
        at, left_at = at + m, left_at + k


def _compare(flat: np.ndarray, a: np.ndarray, b: np.ndarray, right: np.ndarray, at: np.ndarray) -> None:
    """Sets right, for the pairs at, to whether the windows that start at a and b are equal."""
    span = np.arange(WIDTH)
    for i in range(0, len(at), 20_000):
        x = at[i : i + 20_000]
        right[x] = (flat[a[x][:, None] + span] == flat[b[x][:, None] + span]).all(axis=1)


def equal_windows(flat: np.ndarray, starts: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which of the windows of flat, in the order of their digests, equal another one byte for byte; same: whether a window's
    digest is also that of the next."""
    equal, pairs = same.copy(), np.flatnonzero(same)
    a, b = starts[pairs], starts[pairs + 1]
    # Where the windows one byte before are a pair too, and equal, only the last byte is new.
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    follows = np.zeros(len(a), bool)
    follows[1:] = (np.diff(a) == 1) & (np.diff(b) == 1)
    right = np.empty(len(a), bool)
    right[follows] = flat[a[follows] + WIDTH - 1] == flat[b[follows] + WIDTH - 1]
    _compare(flat, a, b, right, np.flatnonzero(~follows))
    chain = np.cumsum(~follows)
    broken = np.isin(chain, chain[~right])
    _compare(flat, a, b, right, np.flatnonzero(broken))
    equal[pairs[order]] = right
    hit = np.zeros(len(starts), bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    # Different windows with one digest may lie between equal ones.
    for x in np.flatnonzero(same & ~equal):
        a, b = x, x + 1
        while a and same[a - 1]:
            a -= 1
        while b < len(same) and same[b]:
            b += 1
        strings = [flat[i : i + WIDTH].tobytes() for i in starts[a : b + 1].tolist()]
        hit[a : b + 1] = [strings.count(w) > 1 for w in strings]
    return hit


def _merge(shard: pa.Table) -> pa.Table:
    """(row, p1, p2): ranges of repeated windows among the shard's suffixes."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    runs = [_decoded(*(z.decompress(c.as_py()) for c in r)) for r in zip(*(shard[n].combine_chunks() for n in ("prefixes", "lengths", "rests", "lefts", "places")))]
    kept, before = [], None
    for prefix, s, load in LoserTree(runs):
        if before is not None:
            p, old, place = before
            if max(p, prefix) >= GRAM:
                kept.append((max(p, prefix), old, *place))
        before = (prefix, s, load)
    if before is not None and before[0] >= GRAM:
        kept.append((before[0], before[1], *before[2]))
    roll, digests, owners = _Roller(REACH + WIDTH + 1), [], []
    for at in range(0, len(kept), 1000):
        part = kept[at : at + 1000]
        wide = max(len(x[1]) + len(x[2]) for x in part)
        data = np.frombuffer(b"".join((x[2] + x[1]).ljust(wide, b"\0") for x in part), np.uint8).reshape(len(part), wide)
        d = roll.digests(data, WIDTH)
        # A window needs WIDTH - (a - p) bytes from the anchor on to be shared.
        reach, left = (np.array([x[i] if i == 0 else len(x[i]) for x in part])[:, None] for i in (0, 2))
        n = np.array([x[6] - x[5] + 1 for x in part])[:, None]
        k = np.arange(d.shape[1])[None, :]
        i, j = np.nonzero((k < n) & (WIDTH - (left - k) <= reach))
        digests.append(d[i, j])
        owners.append((i + at, j))
    if not digests:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32())], ["row", "p1", "p2"])
    d = np.concatenate(digests)
    row, p = (np.array([x[i] for x in kept], np.int64) for i in (3, 5))
    own, j = (np.concatenate(x) for x in zip(*owners))
    order = np.argsort(d, kind="stable")
    same = d[order[1:]] == d[order[:-1]]
    flat = np.frombuffer(b"".join(x[2] + x[1] for x in kept), np.uint8)
    starts = np.cumsum([0, *(len(x[1]) + len(x[2]) for x in kept[:-1])])[own] + j
    hit = equal_windows(flat, starts[order], same)[np.argsort(order)]
    own, j = own[hit], j[hit]
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(j, prepend=-9) != 1))
    end = np.append(first[1:], len(own)) - 1
    at = own[first]
    return pa.table([pa.array(row[at]), pa.array((p[at] + j[first]).astype(np.int32)), pa.array((p[at] + j[end]).astype(np.int32))] if len(own) else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32())], ["row", "p1", "p2"])


def repeated_bytes(n: int, windows: list) -> np.ndarray:
    """Which of n bytes the windows starting in the ranges (p1, p2) cover."""
    edges = np.zeros(n + 1, np.int64)
    if windows:
        p1, p2 = np.array([(w["p1"], w["p2"]) for w in windows]).T
        np.add.at(edges, p1, 1)
        np.add.at(edges, p2 + WIDTH, -1)
    return np.cumsum(edges[:-1]) > 0


_OUT = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, data, windows in zip(b.column(0).to_pylist(), _unpacked(b.column(1)), b.column(2)):
                gone = repeated_bytes(len(data), windows.as_py() or [])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((row, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in _OUT.split(", ")])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) with distinct row numbers that stay the same in each pass."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = d.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0
    return d.withColumn("row", F.col("doc_id")) if once else stage_table(d.withColumn("row", F.monotonically_increasing_id()), "numbered", like=docs)


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with with_kept
    the remaining bytes as `kept`.

    Texts are judged whole, as UTF-8, in chunks of CHUNK bytes if they are very long; null counts as empty. Texts under 200 bytes lose nothing. Repeated rows and equal or null
    ids are rows of their own, so a repeated long text is removed entirely. Other columns are ignored; an empty table gives
    an empty result.
    """
    docs = _numbered(docs)
    texts = docs.select("row", "text")
    packed = texts.mapInArrow(_pack, "row long, packed binary")
    # One record for an anchor in a document, with all its places.
    places = texts.where(F.octet_length("text") >= WIDTH).mapInArrow(_anchor_rows, "h long, row long, places binary")
    places = stage_table(places, "places", like=docs)
    n = F.octet_length("places") / 12
    counts = places.groupBy("h").agg(F.count("*").alias("n"), F.sum(n).alias("in_all")).where("in_all > 1")
    counted = join_by_counts(places, stage_table(counts, "counts", like=places), ["h"])
    # One document's anchors.
    mine = counted.groupBy("row").agg(F.collect_list(F.struct("h", "places", (F.col("in_all") > HOT).alias("hot"))).alias("found"), F.sum(n).alias("n"))
    mine = stage_table(mine, "anchors", like=places)
    drop_staged(places)
    n_shards = max(4, math.ceil((mine.agg(F.sum("n")).first()[0] or 0) / SHARD_SUFFIXES))
    runs = packed.join(mine.hint("merge"), "row").select("row", "packed", "found").mapInArrow(_suffix_runs(n_shards), _RUN)
    runs = stage_table(runs, "runs", like=docs)
    merged = runs.where("row is null").groupBy("shard").applyInArrow(_merge, "row long, p1 int, p2 int")
    windows = merged.unionByName(runs.where("row is not null").select("row", "p1", "p2"))
    spans = stage_table(windows.groupBy("row").agg(F.collect_list(F.struct("p1", "p2")).alias("windows")), "windows", like=runs)
    done = packed.join(spans.hint("merge"), "row", "left").select("row", "packed", "windows").mapInArrow(_removed(with_kept), _OUT)
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    if "doc_id" in docs.columns and not hasattr(docs, "_staged_path"):
        return done.select(F.col("row").alias("doc_id"), *cols)
    return done.join(docs.select("row", "doc_id"), "row").select("doc_id", *cols)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
