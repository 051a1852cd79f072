"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. With target weight w, a share of all weights kept as an exact fraction, its j-th block
(from 0) is released at floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with the earliest deadline
runs (ties: the source first by name). One slot a block and weights that fill the time make these windows feasible, and
earliest-deadline-first meets them, so that at any slot a source is less than one block from its target, over the whole run.

A source that has run out leaves its slots empty; the others close up and keep their weights to one another. When those that
have run out hold half of the weights, the rest start a schedule of their own, so that slots are at most about twice the
blocks. Sources of weight 0 come after all others, by equal weights. Every document is placed once: none is dropped or
repeated to force the weights.

Scale: the driver runs the schedule, linear in the blocks, and writes it in parts of PART_BLOCKS, so that it holds a few numbers
a source and one part, whatever the number of blocks. Blocks are of one size for tables of any size. A document needs its rank in its
source, by the digest of its id: ranks are counted over keys alone, within digest ranges of a bounded number of rows, and
shifted by the ranges before, so a large source is spread over many tasks. A range gets the slots and positions of its blocks
as arrays. Documents themselves are shuffled once, to meet their positions by row, and there is no global sort.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, numbered, stage_parts, stage_table, table

FRAME, BLOCK_DOCS, ALPHA = 512, 8, 0.5
#: The driver holds so many blocks of the schedule at a time. Results don't depend on it.
PART_BLOCKS = 1 << 18

_EDF = """aggregate(sequence(0, cast(slots AS int) - 1),
  named_struct('k', transform(q, x -> 0L), 'o', cast(array() AS array<struct<i:int,k:array<bigint>>>)),
  (acc, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(q) - 1), i -> acc.k[i] < q[i].a AND (acc.k[i] * slots) div q[i].a <= t),
      i -> named_struct('due', ((acc.k[i] + 1) * slots + q[i].a - 1) div q[i].a, 'i', i)))),
    p -> named_struct('k', transform(acc.k, (v, x) -> v + if(x = p.i, 1L, 0L)), 'o', concat(acc.o, array(named_struct('i', p.i, 'k', acc.k)))))[0]).o"""


def schedule(sizes: DataFrame, frame: int = FRAME) -> DataFrame:
    """The schedule of a frame of quotas rounded to whole slots, as OP4_SQL has it; mix() follows whole_run() instead.

    sizes (source, n, weight) -> one row a slot of the frame: source, a, slots, slot, block (of the source, in the
    frame), quotas, sizes and before (blocks each source has had by then), the arrays by source name."""
    total = sizes.agg(F.sum("weight").alias("total"))
    # One row.
    q = sizes.join(F.broadcast(total), F.lit(True)).select("source", "n", F.greatest(F.lit(1), F.round(F.coalesce(F.try_divide("weight", "total"), F.lit(0.0)) * frame)).cast("long").alias("a"))
    # One element a source; `frame` bounds their number in earnest use.
    q = q.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "a", "n"))).alias("q"), F.sum("a").alias("slots")).where("size(q) > 0")
    return q.select("q", "slots", F.posexplode(F.expr(_EDF)).alias("slot", "o")).select(
        F.expr("q[o.i].source").alias("source"), F.expr("q[o.i].a").alias("a"), "slots", F.col("slot").cast("long").alias("slot"), F.expr("o.k[o.i]").alias("block"),
        F.col("q.a").alias("quotas"), F.col("q.n").alias("sizes"), F.col("o.k").alias("before"),
    )


def run_in_parts(blocks: list[int], weights: list[float], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source, slot) of every block in the order of slots, the source by its place in the lists, in parts of `most` blocks."""
    left = list(blocks)
    sources, slots, offset = array("q"), array("q"), 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        # In whole numbers, without rounding.
        w = {i: Fraction(weights[i]) for i in active if weights[i] > 0} or {i: Fraction(1) for i in active}
        unit = math.lcm(*(x.denominator for x in w.values()))
        w = {i: int(x * unit) for i, x in w.items()}
        total = running = sum(w.values())
        run = dict.fromkeys(w, 0)
        waiting, ready, t = [(0, i) for i in w], [], 0
        while 2 * running > total:
            while waiting and waiting[0][0] <= t:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(run[i] + 1) * total // w[i]), i))
            if ready:
                i = heapq.heappop(ready)[1]
                run[i] += 1
                heapq.heappush(waiting, (run[i] * total // w[i], i))
                if left[i]:
                    sources.append(i)
                    slots.append(offset + t)
                    left[i] -= 1
                    running -= 0 if left[i] else w[i]
                    if len(sources) == most:
                        yield np.array(sources, np.int64), np.array(slots, np.int64)
                        sources, slots = array("q"), array("q")
            t += 1
        offset += t
    if sources:
        yield np.array(sources, np.int64), np.array(slots, np.int64)


def whole_run(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """run_in_parts as one part."""
    return next(run_in_parts(blocks, weights, sum(blocks)), (np.array([], np.int64), np.array([], np.int64)))


def _placed(sizes: DataFrame, block_docs: int) -> Iterator[DataFrame]:
    """sizes (source, n, weight) -> source, nth (block of the source), slot, start (position of the block's first document), in
    parts of PART_BLOCKS blocks."""
    # A row a source.
    rows = sorted(sizes.collect(), key=lambda r: r["source"].encode("utf-8", "surrogatepass"))
    n = np.array([r["n"] for r in rows], np.int64)
    names = pa.array([r["source"] for r in rows], pa.string())
    had, start = np.zeros(len(rows), np.int64), 0
    for source, slot in run_in_parts((-(-n // block_docs)).tolist(), [r["weight"] for r in rows], PART_BLOCKS):
        by = np.argsort(source, kind="stable")
        nth = np.empty(len(source), np.int64)
        nth[by] = np.arange(len(source)) - np.searchsorted(source[by], source[by])
        nth += had[source]
        had += np.bincount(source, minlength=len(rows))
        held = np.minimum(block_docs, n[source] - nth * block_docs)
        end = start + np.cumsum(held)
        part = pa.table([names.take(pa.array(source)), pa.array(nth), pa.array(slot), pa.array(end - held)], ["source", "nth", "slot", "start"])
        yield sizes.sparkSession.createDataFrame(part)
        start = int(end[-1])


def _weights(sizes: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    if weights is None:
        return sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    given = pa.table([pa.array(list(weights), pa.string()), pa.array([float(v) for v in weights.values()], pa.float64())], ["source", "weight"])
    return sizes.join(sizes.sparkSession.createDataFrame(given), "source", "left").fillna(0.0, ["weight"])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_docs: int = BLOCK_DOCS, seed: str = "mix", range_rows: int = 2000) -> DataFrame:
    """The rows of docs with mix_slot and mix_position (from 0, without gaps).

    weights by source name; without them a source weighs its documents to the power alpha. A source without a weight,
    or with one of 0, comes after the others. A null source is a source of its own, mixed as the empty name (with documents that have that name).
    Documents of a source come in the order of the digest of seed and id, null ids as the empty string, equal ids next to each other in
    any order. Blocks have block_docs documents. Columns mix_slot and mix_position of docs are replaced; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("mix_slot", "mix_position")]
    source = F.coalesce(F.col("doc.source").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))))
    d = numbered(docs.drop("mix_slot", "mix_position"))
    keys = d.select("row", source.alias("source"), digest.alias("digest"), F.col("doc.doc_id").alias("id"))
    sizes = stage_table(keys.groupBy("source").agg(F.count("*").alias("n")), "sizes", like=keys)
    if not sizes.limit(1).count():
        return docs.select(*names, F.lit(0).cast("long").alias("mix_slot"), F.lit(0).cast("long").alias("mix_position"))
    largest = sizes.agg(F.max("n")).first()[0]
    blocks = stage_parts(_placed(_weights(sizes, weights, alpha), block_docs), "blocks", like=keys)
    n_ranges = max(1, math.ceil(largest / range_rows))
    in_range = lambda c: F.floor(F.conv(F.substring(c, 1, 8), 16, 10).cast("long") * n_ranges / (1 << 32))
    ranged = keys.withColumn("range", in_range(F.col("digest")))
    held = ranged.groupBy("source", "range").agg(F.count("*").alias("held"))
    # As many rows a source as ranges.
    before = held.withColumn("shift", F.sum("held").over(Window.partitionBy("source").orderBy("range")) - F.col("held"))
    first, last = F.floor(F.col("shift") / block_docs), F.floor((F.col("shift") + F.col("held") - 1) / block_docs)
    asked = before.select("source", "range", "shift", first.alias("first"), F.explode(F.sequence(first, last)).alias("nth"))
    places = asked.join(blocks, ["source", "nth"]).groupBy("source", "range", "shift", "first")
    before = stage_table(places.agg(F.array_sort(F.collect_list(F.struct("nth", "slot", "start"))).alias("places")), "places", like=keys)
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("source", "range").orderBy("digest", "id")) - 1)
    ranked = ranked.join(before, ["source", "range"]).withColumn("rank", F.col("rank") + F.col("shift"))
    place = F.get("places", (F.floor(F.col("rank") / block_docs) - F.col("first")).cast("int"))
    position = (place["start"] + F.col("rank") % block_docs).alias("mix_position")
    placed = ranked.select("row", place["slot"].alias("mix_slot"), position)
    # The narrow side is hashed, so that whole documents are shuffled once and never sorted.
    out = d.join(placed.hint("shuffle_hash"), "row")
    return few_files(out.select(*[F.col(f"doc.`{c}`").alias(c) for c in names], "mix_slot", "mix_position"), docs)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
quota AS (
  SELECT source, n, greatest(1, CAST(round(sqrt(n) / (SELECT sum(sqrt(n)) FROM sizes) * {FRAME}) AS BIGINT)) AS a FROM sizes),
q AS (SELECT list(source ORDER BY source) AS names, list(a ORDER BY source) AS a, list(n ORDER BY source) AS n, CAST(sum(a) AS BIGINT) AS slots FROM quota),
edf AS (
  SELECT CAST(0 AS BIGINT) AS slot, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS k, CAST(NULL AS BIGINT) AS i FROM q
  UNION ALL
  SELECT slot + 1, list_transform(k, lambda v, x: v + CASE WHEN x = nxt THEN 1 ELSE 0 END), nxt
  FROM (
    SELECT e.slot, e.k, list_min(list_transform(
             list_filter(range(1, len(q.a) + 1), lambda s: e.k[s] < q.a[s] AND (e.k[s] * q.slots) // q.a[s] <= e.slot),
             lambda s: (((e.k[s] + 1) * q.slots + q.a[s] - 1) // q.a[s]) * 100000 + s)) % 100000 AS nxt
    FROM edf e, q WHERE e.slot < q.slots)),
slots AS (
  SELECT q.names[e.i] AS source, q.a[e.i] AS a, e.slot - 1 AS slot, e.k[e.i] - 1 AS block, q.slots, q.a AS quotas, q.n AS sizes,
         list_transform(e.k, lambda v, x: v - CASE WHEN x = e.i THEN 1 ELSE 0 END) AS before
  FROM edf e, q WHERE e.i IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank
  FROM documents),
placed AS (
  SELECT r.*, (r.rank // {BLOCK_DOCS}) // u.a AS turn, (r.rank // {BLOCK_DOCS}) % u.a AS block
  FROM ranked r JOIN quota u ON coalesce(r.source, '') = u.source)
SELECT p.doc_id, p.text, p.lang, p.source, p.n_chars, p.turn * s.slots + s.slot AS mix_slot,
       CAST(list_sum(list_transform(s.quotas, lambda a, x: least(s.sizes[x], {BLOCK_DOCS} * (p.turn * a + s.before[x])))) AS BIGINT) + p.rank % {BLOCK_DOCS} AS mix_position
FROM placed p JOIN slots s ON coalesce(p.source, '') = s.source AND p.block = s.block
"""
