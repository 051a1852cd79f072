r"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, and overlap checks.

Items become an inverted index: term -> postings (item, impact), in blocks with their largest impact. Impacts are BM25
weights divided by the item's score against itself, so that one threshold means the same share of every item. Every
document is cut into overlapping passages of twice the longest item, so that any stretch as long as an item lies within
one passage. Each passage is a query of its distinct terms: block-max WAND, a block of items at a time so that numpy does
the sums, finds every item whose score reaches the threshold. The whole text is asked first, as no passage of it can score
more. A hit counts if the passage has at least `overlap` of the five-word shingles both
of the item's question (all but its last sentence) and of its answer (the last one).

Scale: items are indexed in blocks of about MAX_ITEMS, each a bounded broadcast. The documents are read once: a task holds some
of its texts while it loads one index after the other. Texts never move, and no step groups by a term or a passage, so frequent
ones cost no skew.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_without, frugal, stage_table, table

MAX_ITEMS = 20_000
#: Characters of texts held while one index after the other is loaded, where there are several.
TOGETHER = 1 << 24
K1, B, BLOCK = 1.2, 0.75, 64
SHINGLE = 5
_CUT = bytes(ord(LOWER[UPPER.index(chr(i))]) if chr(i) in UPPER else i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at every ASCII character that is neither letter nor digit."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CUT).split()


def shingles(w: list[bytes]) -> set[bytes]:
    """Five-word shingles; the whole sequence if shorter."""
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; a single sentence's last third is its answer."""
    parts = [w for w in map(words, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    w = parts[0] if parts else []
    at = len(w) - len(w) // 3
    return w[:at], w[at:]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    n = hi - lo
    return np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())


class Index:
    """Term -> postings (item, impact) in blocks with their largest impact. Impacts are BM25 weights over the item's own
    score, so an item scores 1 against itself. Items lie in the order of their commonest term and length, so that a block
    holds items alike."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t, w) for i, t in items if (w := words(t))]
        df = Counter(x for _, _, w in kept for x in set(w))
        kept.sort(key=lambda x: (max(x[2], key=lambda y: (df[y], y)), len(x[2])))
        self.ids = [i for i, _, _ in kept]
        self.longest = max([len(w) for _, _, w in kept], default=0)
        self.parts = [tuple(shingles(p) for p in question_answer(t)) for _, t, _ in kept]
        mean = sum(len(w) for _, _, w in kept) / max(1, len(kept))
        lists = defaultdict(list)
        for n, (_, _, w) in enumerate(kept):
            idf = lambda x: math.log(1 + (len(kept) - df[x] + 0.5) / (df[x] + 0.5))
            impact = {x: idf(x) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in Counter(w).items()}
            own = sum(impact.values())
            for x, v in impact.items():
                lists[x].append((n, v / own))
        self.term = {x: k for k, x in enumerate(lists)}
        postings = [(t, n // BLOCK, n, v) for t, p in enumerate(lists.values()) for n, v in p]
        term, block, self.item, self.impact = (np.array(c) for c in zip(*postings)) if postings else (np.zeros(0, np.int64),) * 4
        self.n_blocks = len(kept) // BLOCK + 1
        starts = np.flatnonzero(np.diff(term * self.n_blocks + block, prepend=-1))  # of a term's postings in a block
        self.block, self.posting = block[starts], np.append(starts, len(term))
        self.most = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0)
        self.entry = np.searchsorted(term[starts], np.arange(len(self.term) + 1))
        self.bound = np.array([max(v for _, v in p) for p in lists.values()] + [0.0])  # the last: terms of no item

    def wand(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """Every (item, score) with score >= least for a query of distinct terms, a block at a time: no item if the lists'
        bounds can't reach it, no item of a block if the blocks' can't, and full scores in the blocks that are left."""
        least -= 1e-9
        if self.bound[terms].sum() < least:
            return []
        e = _ranges(self.entry[terms], self.entry[terms + 1])
        e = e[(np.bincount(self.block[e], self.most[e], self.n_blocks) >= least)[self.block[e]]]
        p = _ranges(self.posting[e], self.posting[e + 1])
        scores = np.bincount(self.item[p], self.impact[p], len(self.ids))
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= least)]

    def search(self, text: str | None, least: float, overlap: float) -> dict[int, tuple]:
        """item -> (score, question overlap, answer overlap, first word of the passage), the best passage of each item."""
        w, best = words(text), {}
        if not w or not self.ids:
            return best
        other = len(self.bound) - 1
        ids = np.fromiter(map(self.term.get, w, [other] * len(w)), np.int64, len(w))
        distinct = lambda x: (u := np.unique(x))[u != other]
        # No passage scores more than the whole text.
        if not self.wand(distinct(ids), least):
            return best
        for at in range(0, max(1, len(w) - self.longest), self.longest):
            to = min(len(w), at + 2 * self.longest)
            own = None
            for item, score in self.wand(distinct(ids[at:to]), least):
                own = own or self._shingles(w[at:to])
                q, a = (sum(s in own[min(len(s.split()), SHINGLE)] for s in p) / len(p) if p else 1.0 for p in self.parts[item])
                if q >= overlap and a >= overlap and (item not in best or (q + a, score) > (sum(best[item][1:3]), best[item][0])):
                    best[item] = (score, q, a, at)
        return best

    @staticmethod
    def _shingles(w: list[bytes]) -> list[set[bytes]]:
        """By length, as the parts of short items are shorter than five words."""
        return [set()] + [{b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, SHINGLE + 1)]


def _together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of at least so many characters together, but for the last."""
    ids, texts, n = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            texts.append(t.as_py())
            n += len(texts[-1] or "")
            if n >= size:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


_HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_word int"


def find_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_word) for each row of docs (doc_id, text) and
    item of items (item_id, text) that some passage of the text reaches with a BM25 score of at least `least` of the item's
    own and `overlap` of its question and answer shingles; of several passages the one with the most overlap.

    Null and empty texts and items without words match nothing; items with equal texts or ids are found each; repeated rows
    are searched each; a very long text is searched whole, by passages; other columns are ignored. Without documents or items
    the result is empty. However many items there are, the documents are read once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_blocks = max(1, math.ceil(listed.count() / MAX_ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    # Each about MAX_ITEMS items, whatever the size of the benchmark.
    indexes = [spark.sparkContext.broadcast(Index([tuple(r) for r in listed.where(block == k).orderBy("item_id", "text").collect()])) for k in range(n_blocks)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in _together(batches, 0 if n_blocks == 1 else TOGETHER):
            for index in indexes:
                ix = index.value
                rows = [(d, ix.ids[i], *x) for d, t in zip(ids, held) for i, x in ix.search(t, least, overlap).items()]
                if n_blocks > 1:  # one index in memory at a time
                    del ix, index._value
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _HITS.split(", ")])

    return texts.mapInArrow(frugal(search), _HITS)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with all columns; rows without an id stay."""
    return drop_without(docs, stage_table(find_contaminated(docs, items).where("doc_id is not null").select("doc_id").distinct(), "leaks", like=docs))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
