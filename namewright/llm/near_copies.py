r"""Near copies for the pipeline: SimHash near-dedup of five-word shingles, verified and completed to a similarity of 0.8.

Texts are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. The SimHash operator's deletion
variants give the candidates whose fingerprints of those sets differ in at most 2 bits. Most edited copies at this similarity
differ in more, beyond what segments with one wildcard can reach, so MinHash adds the others: a signature of BANDS x ROWS
minima, cut into bands. Texts that share a band are candidates; at a similarity of exactly 0.8 all bands of a pair differ with
a probability of (1 - 0.8^ROWS)^BANDS, 6 in 100,000, and less above. Candidates that hang together form a
cluster, in which the links are decided on the sets themselves: a search goes from text to text and counts the shingles
shared with every text not reached yet, so neither a missing band nor a false one changes what is linked within a cluster.

A cluster of more than BLOCK_SHINGLES is dealt to blocks of about that size. Each block is searched together with the first,
which is a random part of the cluster, so that what is dense hangs together through it. Texts that are then outside their
cluster's largest part are the odd ones; they are dealt to shards of a block's size, and every shard meets every block. Of two
linked texts in different parts at least one is odd, so no link is missed, at any size.

Scale: texts with equal sets are one node. One Arrow pass makes a node and its bands (8 bytes each) of every text; only the
texts of candidates are read again. A task holds the sets of two blocks at most, however large the cluster. The work is linear
in a cluster that hangs together, and blocks times shards in one that doesn't: candidates that turn out unlike are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_staged, drop_without, few_files, frugal, join_by_counts, keep_within, stage_table
from .components import components
from .simhash import majority, near_links

SHINGLE_WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
#: Shingles, of 8 bytes, in a block of a cluster.
BLOCK_SHINGLES = 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SEEDS, _FACTORS = (np.random.default_rng(7).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.array([[[0]], [[1]]], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles in order. Words are cut at ASCII white space and A-Z lower-cased; a text of
    fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n_words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(h) + j])
    return np.unique(h)


def node(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 1)).view(np.int64))


def bands(s: np.ndarray) -> np.ndarray:
    """The bands' keys, none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(least, ((s[None, at : at + 2048] ^ _SEEDS) * _FACTORS).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            ids, texts = (c.slice(at, 512) for c in b.columns)
            sets = [shingles(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(node, sets), pa.int64()), pa.array(map(majority, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], ["doc_id", "node", "fp", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            sets = [shingles(t.as_py()) for t in b.column(1).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(map(node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "hashes"])


def linked_parts(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the number of its part; parts are connected over pairs of the similarity or more."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    offset = np.concatenate([[0], np.cumsum(sizes)])
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    part = np.full(m, -1)

    def index() -> tuple[np.ndarray, np.ndarray]:
        """Of the sets not reached, by shingle: where its owners start, and the owners."""
        left = np.nonzero(part[owner] < 0)[0]
        at = left[np.argsort(which[left], kind="stable")]
        return np.searchsorted(which[at], np.arange(len(names) + 1)), owner[at]

    start, owners = index()
    indexed = left = m
    for first in range(m):
        if part[first] >= 0:
            continue
        part[first], todo, left = first, [first], left - 1
        while todo and left:
            if left <= indexed // 2:
                start, owners = index()
                indexed = left
            x = todo.pop()
            mine = which[offset[x] : offset[x + 1]]
            n = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owners[at], minlength=m)
            near = np.nonzero((part < 0) & (common > 0) & (common >= similarity * (sizes + sizes[x] - common) - 1e-9))[0]
            part[near] = first
            todo += near.tolist()
            left -= len(near)
    return part


def _listed(group: pa.Table) -> list[np.ndarray]:
    hashes = group["hashes"].combine_chunks()
    return np.split(hashes.flatten().to_numpy().view(np.uint64), np.cumsum(hashes.value_lengths().to_numpy())[:-1])


def _verify(block: pa.Table) -> pa.Table:
    nodes = block["node"].to_numpy()
    part = linked_parts(_listed(block))
    return pa.table([pa.array(nodes), pa.array(nodes[part]), block["blocks"]], ["node", "root", "blocks"])


def linked_labels(sets: list[np.ndarray], labels: np.ndarray, odd: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(place, label) for each set marked odd and each other label of the unmarked sets that are similar to it."""
    base = np.nonzero(~odd)[0]
    sizes = np.array([len(sets[i]) for i in base], np.int64)
    flat = np.concatenate([sets[i] for i in base]) if len(base) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owners = flat[order], np.repeat(np.arange(len(base)), sizes)[order]
    out = []
    for x in np.nonzero(odd)[0].tolist():
        first = np.searchsorted(flat, sets[x])
        n = np.searchsorted(flat, sets[x], "right") - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owners[at], minlength=len(base))
        near = base[(common > 0) & (common >= similarity * (sizes + len(sets[x]) - common) - 1e-9)]
        out += [(x, label) for label in np.unique(labels[near]).tolist() if label != labels[x]]
    return out


def _verify_odd(pair: pa.Table) -> pa.Table:
    found = linked_labels(_listed(pair), pair["label"].to_numpy(), pair["odd"].to_numpy(zero_copy_only=False))
    nodes = pair["node"].to_numpy()
    return pa.table([pa.array([int(nodes[x]) for x, _ in found], pa.int64()), pa.array([label for _, label in found], pa.int64())], ["u", "v"])


def _across(parts: DataFrame, members: DataFrame, sets: DataFrame, block_shingles: int) -> DataFrame:
    """(node, root) of clusters of several blocks.

    parts (node, root): links found in the blocks, each searched with the first; members (node, size, cluster, block, blocks)
    and sets (node, cluster, block, blocks, hashes) of those clusters."""
    found = components(parts.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = stage_table(members.join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled", like=members)
    weights = labelled.groupBy("cluster", "label").agg(F.sum("size").alias("weight"))
    # A row a cluster of several blocks.
    by_cluster = weights.groupBy("cluster").agg(
        F.max_by("label", F.struct("weight", "label")).alias("main"), F.ceil((F.sum("weight") - F.max("weight")) / block_shingles).cast("long").alias("shards"), F.count("*").alias("labels"))
    n = members.groupBy("cluster").agg(F.count("*").alias("n"))
    by_cluster = stage_table(by_cluster.join(n, "cluster").where("labels > 1").drop("labels"), "by-cluster", like=members)
    odd = join_by_counts(labelled, by_cluster, ["cluster"]).withColumn("odd", F.expr("label <> main"))
    odd = stage_table(odd.select("node", "label", "odd", "shards", F.expr("pmod(xxhash64(node, 2), shards)").alias("shard")), "odd", like=members)
    rows = sets.join(odd, "node")
    columns = ["node", "label", "hashes", "cluster"]
    whole = rows.select(*columns, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(False).alias("odd"))
    shards = rows.where("odd").select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "shard", "odd")
    links = whole.unionByName(shards).groupBy("cluster", "block", "shard").applyInArrow(frugal(_verify_odd), "u long, v long")
    links = links.unionAll(labelled.select(F.col("node").alias("u"), F.col("label").alias("v")))
    final = components(links)
    return members.select("node").join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, component_id. block_shingles bounds a task's work, not the result.

    component_id is the smallest doc_id reachable over links of a similarity of 0.8 or more; null only if all reachable ids
    are null. A null text counts as empty; texts without words are alike and link to no other. Rows with equal ids count each.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = stage_table(d.mapInArrow(frugal(_signed), "doc_id long, node long, fp long, size long, bands array<long>"), "signatures", like=docs)
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.count("*").alias("n"))
    nodes = stage_table(nodes, "nodes", like=marked)
    # Texts with words: by fingerprint the smallest node, and what is within 2 bits of it.
    worded = nodes.where("size(bands) > 0").select("fp", "node")
    by_fp = stage_table(worded.groupBy("fp").agg(F.min("node").alias("u")), "by-fingerprint", like=nodes)
    alike = worded.join(by_fp, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    near = near_links(by_fp.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    near = near.join(by_fp.select(F.col("fp").alias("a"), "u"), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("u").alias("v")), "b").select("u", "v")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("u")).where("n > 1").select("band", "u")
    banded = banded.join(buckets, "band").where("node <> u").select("u", F.col("node").alias("v"))
    together = components(banded.unionAll(alike).unionAll(near))
    clusters = together.unionAll(together.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "cluster")
    clusters = stage_table(clusters.join(nodes.select("node", "first", "size"), "node"), "clusters", like=nodes)
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.sum("size") / block_shingles).alias("blocks"), F.count("*").alias("n"))
    large = stage_table(blocks.where("blocks > 1"), "large", like=clusters, files=1)
    any_large = bool(large.limit(1).count())
    if any_large:
        several = join_by_counts(clusters, large, ["cluster"]).withColumn("block", F.expr("pmod(xxhash64(node, 1), blocks)"))
        clusters = clusters.join(several.select("node", "blocks", "block"), "node", "left").fillna({"blocks": 1, "block": 0})
        clusters = stage_table(clusters, "blocks", like=clusters)
    else:
        clusters = clusters.withColumns({"blocks": F.lit(1).cast("long"), "block": F.lit(0).cast("long")})
    texts = keep_within(d, stage_table(clusters.where("first is not null").select(F.col("first").alias("doc_id")).distinct(), "first-ids", like=clusters))
    if clusters.where("first is null").limit(1).count():
        texts = texts.unionAll(d.where("doc_id is null"))
    # An id may have other texts as well, and texts without id may be equal: one row a node.
    sets = texts.mapInArrow(frugal(_sets), "node long, hashes array<long>").join(clusters.select("node", "cluster", "blocks", "block"), "node").dropDuplicates(["node"])
    if any_large:
        sets = stage_table(sets, "sets", like=docs)
    # The first block goes to every block's task.
    tasks = F.when(F.col("block") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    parts = sets.select("node", "hashes", "blocks", "cluster", F.explode(tasks).alias("task")).groupBy("cluster", "task")
    parts = stage_table(parts.applyInArrow(frugal(_verify), "node long, root long, blocks long"), "parts", like=clusters)
    if any_large:
        several = _across(parts.where("blocks > 1"), clusters.where("blocks > 1"), sets.where("blocks > 1"), block_shingles)
        parts = parts.where("blocks = 1").select("node", "root").unionByName(several)
    parts = parts.select("node", "root").join(nodes.select("node", "first"), "node")
    least = parts.groupBy("root").agg(F.min("first").alias("least"))
    named = parts.join(least, "root").select("node", "least")
    ids = stage_table(nodes.join(named, "node", "left").select("node", "n", F.coalesce("least", "first").alias("component_id")), "named", like=nodes)
    drop_staged(sets)
    return join_by_counts(marked.select("doc_id", "node"), ids, ["node"]).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that near_copies puts into the component of another, smaller id. All columns stay.
    Of rows that share the kept id one stays; rows without an id can't be told apart by it and stay."""
    found = near_copies(docs)
    gone = stage_table(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies", like=docs)
    out = drop_without(docs, gone)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return few_files(out, docs)
