r"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors gain one component that brings all to the same norm, so that the largest inner product is the smallest distance.
Balanced hierarchical clustering of a bounded sample gives centroids whose lists are of similar size. A navigable graph
over the centroids, small enough for a task's memory, is searched by best-first steps for many vectors at once. Each vector
goes to its nearest list, and a boundary vector, whose other centroids are nearly as near, to several. A query searches
the lists whose centroid's distance is within a ratio of its nearest one's, a few at least and at most a share of all lists
that doesn't fall as they multiply.

Equal vectors are one point with its 21 smallest ids, which is all that any answer of 20 can use, so copies don't make a
list long; a query vector is searched once for all its copies.

Scale: the sample is at most SAMPLE vectors and the centroids at most SAMPLE / 8, which bounds what the driver holds and what
is broadcast. Neighbouring lists form bundles, and a query goes to a bundle once, with the lists it searches there. Bundles are
cut into chunks of points and their queries into blocks, dealt evenly, so that a list of any length is many small tasks'
work; each returns its best 21 points a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_table, table

SAMPLE, LIST_POINTS, BUNDLES, CHUNK, QUERY_BLOCK = 65_536, 64, 64, 16_384, 16_384
COPIES, BOUNDARY, PROBES, LEAST_PROBES, RATIO = 6, 1.2, 160, 8, 1.5
#: Of the lists, beyond 160 / PROBE_SHARE of them.
PROBE_SHARE = 0.125


def n_probes(n_lists: int) -> int:
    return max(PROBES, math.ceil(n_lists * PROBE_SHARE))


def _cluster(x: np.ndarray, target: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of a balanced hierarchical clustering: parts of more than target rows are cut into up to 8 by k-means
    whose assignments pay for the size of a part."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= target:
            out.append(x[at].mean(axis=0))
            continue
        k = min(8, max(2, math.ceil(len(at) / target)))
        c = x[rng.choice(at, k, replace=False)]
        size = np.zeros(k)
        for _ in range(8):
            d = ((x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ c.T + (c**2).sum(1)).clip(0)
            part = (d + d.mean() * 0.2 * (size / max(1.0, size.mean()) - 1 if size.any() else size)).argmin(1)
            size = np.bincount(part, minlength=k).astype(float)
            c = np.stack([x[at[part == j]].mean(axis=0) if size[j] else x[rng.choice(at)] for j in range(k)])
        if size.max() == len(at):  # nothing tells them apart
            part = np.arange(len(at)) % k
        todo += [at[part == j] for j in range(k) if (part == j).any()]
    return out


class CentroidGraph:
    """Centroids with edges to their nearest and to some random ones."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, extra: int = 4, seed: int = 1):
        self.c = centroids
        n, rng = len(centroids), np.random.default_rng(seed)
        self.sq = (centroids**2).sum(1)
        near = [np.argsort(self.sq - 2 * centroids[i : i + 256] @ centroids.T, axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 256)]
        self.edges = np.hstack([np.concatenate(near), rng.integers(0, n, (n, extra))]).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int32))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the beam nearest found for each row of q, nearest first; -1 and inf where fewer."""
        n, b = len(self.c), min(beam, len(self.c))
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        seen[:, self.entries] = True
        dist = lambda ids: (self.sq[ids] - 2 * np.einsum("qkd,qd->qk", self.c[ids], q)) + (q**2).sum(1)[:, None]
        ids = np.broadcast_to(self.entries, (len(q), len(self.entries))).copy()
        d, done = dist(ids), np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :b]
            ids, d, done = ids[rows, order], d[rows, order], done[rows, order]
            open_d = np.where(done | ~np.isfinite(d), np.inf, d)
            if not np.isfinite(open_d).any():
                return np.where(np.isfinite(d), ids, -1), np.sqrt(d.clip(0))
            step = np.argsort(open_d, axis=1, kind="stable")[:, :4]
            live = np.isfinite(open_d[rows, step])
            done[rows, step] = True
            new = self.edges[ids[rows, step]].reshape(len(q), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.edges.shape[1], axis=1)
            # Each centroid once a row.
            by = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros(new.shape, bool)
            ordered = new[rows, by]
            twice[rows, by[:, 1:]] = ordered[:, 1:] == ordered[:, :-1]
            fresh &= ~twice
            seen[rows, new] |= np.repeat(live, self.edges.shape[1], axis=1)
            ids, d, done = np.hstack([ids, new]), np.hstack([d, np.where(fresh, dist(new), np.inf)]), np.hstack([done, np.zeros(new.shape, bool)])


    def scan(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """As search(), by comparing with all centroids: exact, and for a wide beam cheaper than the graph."""
        d = (self.sq - 2 * q @ self.c.T + (q**2).sum(1)[:, None]).clip(0)
        b = min(beam, len(self.c))
        ids = np.argpartition(d, b - 1, axis=1)[:, :b]
        rows = np.arange(len(q))[:, None]
        ids = ids[rows, np.argsort(d[rows, ids], axis=1, kind="stable")]
        return ids, np.sqrt(d[rows, ids])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of those that take part: an id, no null, NaN or infinite component, not zero, and as many components as
    most vectors have (of equally frequent numbers the larger)."""
    vec = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and size(vec) > 0")
    v = v.where(F.forall("vec", fine) & F.exists("vec", lambda x: x != 0))
    dims = v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return v.where(F.size("vec") == (dims["dim"] if dims else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k
    others found with the largest inner product (double precision, on the vectors as given), ties to the smaller id.

    What usable() leaves out takes no part. Rows with equal ids count each, but none is its own neighbour. With fewer than k
    other vectors all are returned; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = stage_table(usable(vectors), "vectors")
    w = Window.partitionBy("vec").orderBy("vec_id")
    # At most k + 1 ids to a vector.
    points = v.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stage_table(points.select(F.xxhash64("vec").alias("point"), "vec", "ids"), "points")
    n, norm = points.agg(F.count("*"), F.sqrt(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = max(1, math.ceil(n / SAMPLE))
    # At most about SAMPLE vectors.
    sample = points.where(F.pmod("point", F.lit(share)) == 0).select("point", "vec").toArrow().combine_chunks().sort_by("point")
    lift = lambda x: np.hstack([x, np.sqrt((norm**2 - (x**2).sum(1)).clip(0))[:, None]])
    x = lift(_matrix(sample["vec"].combine_chunks())) if len(sample) else np.zeros((1, len(points.first()["vec"]) + 1))
    centroids = np.stack(_cluster(x, max(8, LIST_POINTS // share), np.random.default_rng(0)))
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))
    probed, bundled = n_probes(len(centroids)), math.ceil(len(centroids) / BUNDLES)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, d = graph.value.search(lift(_matrix(part["vec"])), 16)
                row, col = np.nonzero((d <= BOUNDARY * d[:, :1] + 1e-12)[:, :COPIES] & (ids[:, :COPIES] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col], pa.int32()), *(part[c].take(pa.array(row)) for c in ("point", "vec", "ids"))], ["list", "point", "vec", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = _matrix(part["vec"])
                lifted = np.hstack([q, np.zeros((len(q), 1))])
                ids, d = graph.value.scan(lifted, probed) if probed > PROBES else graph.value.search(lifted, probed)
                row, col = np.nonzero(((d <= RATIO * d[:, :1]) | (np.arange(d.shape[1]) < LEAST_PROBES)) & (ids >= 0))
                lists = ids[row, col]
                order = np.lexsort((lists, row))
                row, lists = row[order], lists[order].astype(np.int32)
                first = np.nonzero(np.diff(row, prepend=-1) | np.diff(lists // bundled, prepend=-1))[0]
                asked = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(lists))
                yield pa.RecordBatch.from_arrays([pa.array(lists[first] // bundled), asked, *(part[c].take(pa.array(row[first])) for c in ("point", "vec"))], ["bundle", "lists", "point", "vec"])

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            left = left.sort_by("list")
            x, q = (_matrix(t["vec"].combine_chunks()) for t in (left, right))
            lists, start = np.unique(left["list"].to_numpy(), return_index=True)
            ends = np.append(start[1:], len(x))
            # A point is one column, however many lists hold it.
            points, row_of, column = np.unique(left["point"].to_numpy(), return_index=True, return_inverse=True)
            wanted = right["lists"].combine_chunks()
            asks_for = np.zeros((len(q), len(lists)), bool)
            flat, owner = wanted.flatten().to_numpy(), np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
            at = np.searchsorted(lists, flat).clip(max=len(lists) - 1)
            asks_for[owner[lists[at] == flat], at[lists[at] == flat]] = True
            asked, m = right["point"].to_numpy(), min(k + 1, len(points))
            for begin in range(0, len(q), 256):
                near = np.full((len(q[begin : begin + 256]), len(points)), -np.inf)
                for n in range(len(lists)):
                    rows = np.nonzero(asks_for[begin : begin + 256, n])[0]
                    near[np.ix_(rows, column[start[n] : ends[n]])] = q[begin + rows] @ x[start[n] : ends[n]].T
                seen = np.isfinite(near)
                least = np.partition(near, len(points) - m, axis=1)[:, len(points) - m] - 1e-9 * (1 + np.abs(near, where=seen, out=np.zeros_like(near)).max(axis=1))
                i, j = np.nonzero((near >= least[:, None]) & seen)
                # The scores again, each by the same order of additions.
                got.append((asked[begin + i], points[j], (q[begin + i] * x[row_of[j]]).sum(axis=1)))
        return pa.table([np.concatenate(c) for c in zip(*got)], ["asked", "point", "score"])

    postings = stage_table(points.mapInArrow(post, "list int, point long, vec array<double>, ids array<long>"), "postings")
    asks = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("asked"), "vec")
    asked = points.join(asks.select(F.col("asked").alias("point")).distinct(), "point", "left_semi").select("point", "vec")
    probes = stage_table(asked.mapInArrow(probe, "bundle int, lists array<int>, point long, vec array<double>"), "probes")
    postings = postings.withColumn("bundle", F.expr(f"cast(list div {bundled} AS int)"))
    # A row a bundle.
    cut = lambda df, size, name: df.groupBy("bundle").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(cut(postings, CHUNK, "chunks").join(cut(probes, QUERY_BLOCK, "blocks"), "bundle"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("point", F.lit(n)), F.col(n)).cast("int")
    left = postings.join(sizes, "bundle").select("bundle", "list", mine("chunks").alias("chunk"), each("blocks").alias("block"), "point", "vec")
    right = probes.join(sizes, "bundle").select("bundle", "lists", each("chunks").alias("chunk"), mine("blocks").alias("block"), "point", "vec")
    pairs = left.groupBy("bundle", "chunk", "block").cogroup(right.groupBy("bundle", "chunk", "block")).applyInArrow(best, "asked long, point long, score double")
    by_score = [F.desc("score"), F.asc("vec_id")]
    found = pairs.distinct().join(points.select("point", "ids"), "point").select("asked", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("asked").orderBy(*by_score))).where(F.col("nth") <= k + 1)
    rows = asks.drop("vec").distinct().join(found, "asked").where("vec_id <> query_id")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score))).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
