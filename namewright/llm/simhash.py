r"""SimHash near-dedup with deletion-variant signatures.

Fingerprints link at 2 or fewer differing bits. A fingerprint is cut into two segments of 32 bits, so that of a linked pair
either one segment is equal, or each differs by exactly one bit. The index therefore holds both segments as they are, and
the 32 one-wildcard variants of the first (bit i left out). Buckets are equality groups of these 34 signatures:

- a bucket of two is one candidate pair, verified on all 64 bits;
- in a bucket of up to LISTED members each is compared with the others, which are held as one list;
- a larger bucket isn't paired up. In one of a whole segment the members are dealt again by the other segment and its 32
  one-bit neighbours: two members of a dealt group differ by at most 2 bits, no linked pair is missed, and a group has at most
  33 distinct fingerprints; each is verified against the group's smallest and linked to it. In one of a wildcard the members
  of the rarer bit look for the 32 one-bit neighbours of their second segment among those of the other bit, where each has one
  place; what they find is linked.

A linked pair is looked for in one bucket only: those with an equal segment in that segment's, the others, which differ by one
bit in each, in that of the wildcard in the first. So wildcard buckets whose members all have the same bit are left out: a
large group around one fingerprint fills all 34 buckets, but most of its members aren't dealt again more than once.

So work is linear in the distinct fingerprints, however many copies there are. Components come from components.py.

Scale: one Arrow pass makes (doc_id, fingerprint); everything later works on distinct fingerprints, 8 bytes each, until the
documents meet their fingerprint's component, the commonest fingerprints by a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_by_counts, stage_table, table
from .components import components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, n_words: int = 3) -> int:
    """The 64 bits as a signed integer. Words are cut at ASCII white space; no word: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], 42) for s, e in zip((ends - lens).tolist(), ends[n_words - 1 :].tolist())], np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """Of unsigned 64-bit hashes the bits that are set in over half of them, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


_LOW = 0xFFFFFFFF


def _segments(fp):
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(_LOW))


def _signatures(fps: DataFrame) -> DataFrame:
    """(sig, fp): tag * 2^32 + segment; tags 0 and 1: whole segments, 2 to 33: the first segment without bit tag - 2."""
    hi, lo = _segments(F.col("fp"))
    sigs = [hi, lo + F.lit(1 << 32)] + [hi.bitwiseAND(F.lit(_LOW & ~(1 << i))) + F.lit((2 + i) << 32) for i in range(32)]
    return fps.select(F.explode(F.array(*sigs)).alias("sig"), "fp")


#: Most members of a bucket that are compared with each other: about half of them a member, as many as the rows of dealing it again.
LISTED = 64
#: From here on signatures leave out a bit.
_WILD = 2 << 32


def near_links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp. Links (u, v), each verified, that connect all fingerprints at 2 or fewer differing bits."""
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    buckets = _signatures(fps).groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    # The smallest and the largest have different first segments if the wildcard's bit is set in some only.
    buckets = buckets.where((F.col("sig") < _WILD) | (F.shiftrightunsigned(F.col("u").bitwiseXOR(F.col("v")), 32) != 0))
    buckets = stage_table(buckets, "buckets", like=fps)
    links = buckets.where("n = 2").where(near(F.col("u"), F.col("v"))).select("u", "v")
    several = stage_table(_signatures(fps).join(buckets.where("n > 2").select("sig", "n"), "sig"), "several", like=fps)
    lists = several.where(F.col("n") <= LISTED).groupBy("sig").agg(F.collect_list("fp").alias("fps"))

    def linked(v):
        hi, lo = _segments(v.bitwiseXOR(F.col("u")))
        return (v > F.col("u")) & near(v, F.col("u")) & ((F.col("sig") < _WILD) | ((hi != 0) & (lo != 0)))

    listed = lists.select("sig", "fps", F.explode("fps").alias("u"))
    links = links.unionAll(listed.select("u", F.explode(F.filter("fps", linked)).alias("v")))
    if buckets.where(F.col("n") > LISTED).limit(1).count():
        large = several.where(F.col("n") > LISTED)
        links = links.unionAll(_by_segment(large.where(F.col("sig") < _WILD))).unionAll(_by_wildcard(large.where(F.col("sig") >= _WILD)))
    return links.distinct()


def _by_segment(large: DataFrame) -> DataFrame:
    """Links of buckets (sig, fp) of a whole segment."""
    hi, lo = _segments(F.col("fp"))
    other = F.when(F.col("sig") < 1 << 32, lo).otherwise(hi)
    dealt = large.select("sig", "fp", F.explode(F.array(other, *[other.bitwiseXOR(F.lit(1 << i)) for i in range(32)])).alias("sub"))
    # At most 33 fingerprints to a group.
    groups = dealt.groupBy("sig", "sub").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    starred = groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return starred.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def _by_wildcard(large: DataFrame) -> DataFrame:
    """Links of buckets (sig, fp, n) of a wildcard whose fingerprints differ by one bit in both segments."""
    _, lo = _segments(F.col("fp"))
    # Tag 2 leaves out the lowest bit of the first segment.
    large = large.select("sig", "fp", "n", lo.alias("lo"), F.expr("shiftrightunsigned(fp, cast(shiftrightunsigned(sig, 32) as int) + 30) & 1").alias("bit"))
    rarer = large.groupBy("sig").agg(F.expr("if(2 * sum(bit) < max(n), 1, 0)").alias("rarer"))
    large = large.join(rarer, "sig")
    asked = F.array(*[F.col("lo").bitwiseXOR(F.lit(1 << i)) for i in range(32)])
    asking = large.where("bit = rarer").select("sig", F.col("fp").alias("u"), F.explode(asked).alias("lo"))
    return asking.join(large.where("bit <> rarer").select("sig", F.col("fp").alias("v"), "lo"), ["sig", "lo"]).select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of 2 or fewer differing bits; null only if all reachable ids
    are null. A null text counts as empty; texts without words share fingerprint zero, which links like any other. Equal
    texts are one fingerprint, repeated rows and ids keep a row each, a text of any length is read whole, other columns are
    ignored, and an empty table gives an empty result.
    """
    marked = stage_table(fingerprints(docs), "fingerprints", like=docs)
    distinct = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct", like=marked)
    roots = stage_table(components(near_links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root"), "roots", like=distinct)
    # Of each component with more than one fingerprint, the smallest id.
    members = roots.unionAll(roots.select(F.col("root").alias("fp"), "root").distinct())
    firsts = members.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = members.join(firsts, "root").select("fp", "least")
    ids = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    out = join_by_counts(marked, stage_table(ids, "components", like=distinct), ["fp"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
