r"""Quality classifier: interpolated modified Kneser-Ney n-grams trained on trusted text, thresholds by language.

Units are symbols, one to a UTF-8 byte: small letters, common marks and all bytes of other scripts stand for themselves,
while capitals share a symbol, digits another, and so do rare marks; the space between a word and its own repetition has one
too. A document's perplexity under the five-gram model tells shouting, menus, symbol noise and stuttering from prose. What is
too high is a quantile of the perplexities of trusted documents in the same language that were held out of the training.

The n-grams are a table that grows with the corpus: every document's are gathered, in chunks of bounded text, counted for
the trusted ones and joined, by n-gram, to the probabilities. No size is fixed, and no n-grams are broadcast unless Spark finds them under its threshold.

1. Each task reads its documents in chunks and sends each chunk's distinct n-grams once. Summed by n-gram with those of the
   training texts they are the sharded counts: n is 0 for an n-gram that is only asked for.
2. Continuation counts of each shorter order are grouped from the order above, and probabilities are made from the shortest
   order up, each by one equi-join on the n-gram without its first symbol. Contexts have at most 256 followers.
3. The chunks' n-grams join their probabilities, which meet the chunk's symbols, compressed, and are summed by document.

Scale: all joins are on n-grams or chunks, which are many and bounded, so a hot source or copied text makes no skew. A very
long text is a chunk of its own and its symbols are read in blocks.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_without, frugal, keep_within, stage_table, table

ORDER, BITS = 5, 8
BEGIN, END, STUTTER, CAPITAL, DIGIT, RARE = range(6)
_MARKS = b" \n.,;:!?'\"-()|%#&*$@/_=+<>[]"
#: Symbols of texts in one block of arrays, and in one chunk, whose n-grams travel once.
BLOCK, CHUNK = 1 << 19, 1 << 23
_LEVEL = 4


def _symbols() -> bytes:
    of = np.full(256, RARE, np.uint8)
    of[STUTTER] = STUTTER
    of[48:58], of[65:91], of[97:123], of[128:] = DIGIT, CAPITAL, np.arange(97, 123), np.arange(128, 256)
    of[list(_MARKS)] = list(_MARKS)
    return of.tobytes()


SYMBOL = _symbols()


def symbols(text: str | None) -> bytes:
    """A text's symbols between the marks of its begin and its end; none for an empty text."""
    data = (text or "").encode("utf-8", "surrogatepass").replace(b"\x02", b"\x01")
    if not data:
        return b""
    words = data.split(b" ")
    if any(map(operator.eq, words, words[1:])):
        gaps = [b"\x02" if a == b and a else b" " for a, b in zip(words, words[1:])] + [b""]
        data = b"".join(x for pair in zip(words, gaps) for x in pair)
    return bytes([BEGIN] * (ORDER - 1)) + data.translate(SYMBOL) + bytes([END])


def grams(data: bytes) -> np.ndarray:
    """The codes of all n-grams of a text's symbols, the first symbol highest."""
    s = np.frombuffer(data, np.uint8)
    n = max(0, len(s) - ORDER + 1)
    code = np.zeros(n, np.int64)
    for i in range(ORDER):
        code <<= BITS
        code |= s[i : i + n]
    return code


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting is quicker here than numpy's own."""
    x = np.sort(x)
    return x[np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1])]


def _across(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with so many symbols, written one after the other: which n-grams lie within a text, and the number of the
    text they are of."""
    held = np.maximum(0, sizes - (ORDER - 1))
    starts = np.cumsum(sizes) - sizes
    n = held.sum()
    return np.repeat(starts - (np.cumsum(held) - held), held) + np.arange(n), np.repeat(np.arange(len(sizes)), held)


def _blocks(texts: Iterator[str | None]) -> Iterator[tuple[list[int], bytes]]:
    """(sizes, symbols) of texts in a row, about BLOCK symbols together unless one text has more."""
    sizes, held, n = [], [], 0
    for t in texts:
        s = symbols(t)
        if sizes and (n + len(s) > BLOCK or len(sizes) == 1 << 16):
            yield sizes, b"".join(held)
            sizes, held, n = [], [], 0
        sizes.append(len(s))
        held.append(s)
        n += len(s)
    if sizes:
        yield sizes, b"".join(held)


def _within(sizes: list[int], data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, number of the text) of a block's n-grams, at most about BLOCK at once."""
    if len(sizes) == 1:
        for at in range(0, len(data), BLOCK):
            code = grams(data[at : at + BLOCK + ORDER - 1])
            yield code, np.zeros(len(code), np.int64)
    else:
        at, of = _across(np.array(sizes, np.int64))
        yield grams(data)[at], of


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> code, n: a task's own sums, sent on whenever they are many."""
    total = pa.table({"code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    for sizes, data in _blocks(t.as_py() for b in batches for t in b.column(0)):
        for code, _ in _within(sizes, data):
            u, n = np.unique(code, return_counts=True)
            total = pa.concat_tables([total, pa.table({"code": u, "n": n.astype(np.int64)})])
        if len(total) > 4 * BLOCK:
            total = total.group_by("code").aggregate([("n", "sum")]).rename_columns(["code", "n"])
            if len(total) > 2 * BLOCK:
                yield from total.to_batches()
                total = total.slice(0, 0)
    yield from total.group_by("code").aggregate([("n", "sum")]).rename_columns(["code", "n"]).to_batches()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list[int], bytes]]:
    """(chunk, ids, languages, sizes, symbols) by block, of batches of (doc_id, lang, text); the same at each reading of the
    same rows."""
    chunk, n = TaskContext.get().partitionId() << 32, 0
    known: list[tuple] = []

    def texts() -> Iterator[str | None]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for i, lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    known.append((i, lang))
                    yield t.as_py()

    for sizes, data in _blocks(texts()):
        if n and n + len(data) > CHUNK:
            chunk, n = chunk + 1, 0
        n += len(data)
        ids, langs = zip(*known[: len(sizes)])
        del known[: len(sizes)]
        yield chunk, list(ids), list(langs), sizes, data


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct n-grams."""
    now, seen = None, np.zeros(0, np.int64)

    def sent() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now)), pa.array(part)], ["chunk", "code"])

    for chunk, _, _, sizes, data in _chunks(batches):
        if chunk != now:
            yield from sent()
            now, seen = chunk, np.zeros(0, np.int64)
        for code, _ in _within(sizes, data):
            seen = distinct(np.concatenate([seen, distinct(code)]))
    yield from sent()


_PACKED = "chunk long, ids array<long>, langs array<string>, sizes array<int>, z binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=_LEVEL)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
    for chunk, ids, langs, sizes, data in _chunks(batches):
        row = (chunk, ids, langs, sizes, codec.compress(data, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in _PACKED.split(", ")])


_SCORES = "doc_id long, lang string, n_symbols long, log_ppl double"


def _summed(key: tuple, packed: pa.Table, given: pa.Table) -> pa.Table:
    """A chunk's documents with their scores."""
    code, logp = given["code"].combine_chunks(), given["logp"].to_numpy()
    codec, parts = pa.Codec("zstd"), []
    for row in range(len(packed)):
        ids, langs, sizes, z = (packed[c][row].as_py() for c in ("ids", "langs", "sizes", "z"))
        n, total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        data = codec.decompress(z, sum(sizes), asbytes=True) if sum(sizes) else b""
        for own, of in _within(sizes, data):
            at = pc.index_in(pa.array(own), value_set=code)
            if at.null_count:
                raise RuntimeError("the documents were read in another order the second time; give classify() a stored table")
            n += np.bincount(of, minlength=len(ids))
            total += np.bincount(of, logp[at.to_numpy()] if len(own) else None, len(ids))
        with np.errstate(divide="ignore", invalid="ignore"):
            parts.append(pa.table([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(n), pa.array(-total / n, mask=n == 0)], ["doc_id", "lang", "n_symbols", "log_ppl"]))
    return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int64(), pa.float64())], ["doc_id", "lang", "n_symbols", "log_ppl"])


def _discounts(counts: DataFrame) -> DataFrame:
    """One row: d1, d2, d3 of modified Kneser-Ney from the counts of counts 1 to 4; absolute 0.5 where they don't give any."""
    k = counts.agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5)))) for i in (1, 2, 3)]
    return k.select(*[x.alias(f"d{i}") for i, x in enumerate(d, 1)])


def probabilities(counts: DataFrame) -> DataFrame:
    """counts (code, n): each n-gram once, n = 0 for those only asked for -> (code, p), interpolated over all orders down to
    the single symbol and, below that, the uniform share of 1 / 256. Without any count every p is that."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))
        by_order[k] = stage_table(by_order[k + 1].groupBy(suffix.alias("code")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n")), f"order-{k}", like=by_order[k + 1])
    p = None
    for k in range(1, ORDER + 1):
        d = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # _discounts has one row.
        c = by_order[k].join(F.broadcast(_discounts(by_order[k])), F.lit(True)).select("code", "n", d.alias("d"))
        context = c.withColumn("context", F.shiftright("code", BITS))
        # At most 256 followers to a context.
        w = Window.partitionBy("context")
        c = context.select("code", "n", "d", F.sum("n").over(w).alias("total"), F.sum("d").over(w).alias("held"))
        if p is None:
            c = c.withColumn("lower", F.lit(1.0 / (1 << BITS)))
        else:
            c = c.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(p.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
        own = F.when(F.col("total") > 0, (F.col("n") - F.col("d") + F.col("held") * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        p = c.select("code", own.alias("p"))
    return p


def perplexities(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, log_ppl for each row of docs (doc_id, text, lang), under the model of training (text);
    log_ppl is null for an empty text. docs is read thrice and must give the same rows in the same order, as a stored table
    does; if it doesn't, the job fails rather than return other scores."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    asked = read.mapInArrow(frugal(_asked), "chunk long, code long")
    counted = training.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(_counts), "code long, n long")
    counts = stage_table(counted.unionByName(asked.select("code", F.lit(0).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("n")), "counts", like=docs)
    model = stage_table(probabilities(counts).select("code", F.log("p").cast("float").alias("logp")), "model", like=counts)
    given = asked.join(model, "code").select("chunk", "code", "logp")
    return read.mapInArrow(frugal(_packed), _PACKED).groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(frugal(_summed), _SCORES)


def thresholds(scores: DataFrame, quantile: float, steps: int = 2000, least: int = 200) -> DataFrame:
    """(lang, log_limit): the quantile of log_ppl by language, to 1/steps; lang null: over all, for languages with fewer
    than `least` scores. Scores are first counted by step, so a language's rows are as many as its steps."""
    counted = scores.where("log_ppl is not null").groupBy("lang", F.ceil(F.col("log_ppl") * steps).alias("step")).agg(F.count("*").alias("n"))
    counted = counted.unionByName(counted.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    at = counted.withColumn("seen", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    at = at.where((F.col("seen") >= F.col("all") * quantile) & (F.col("lang").isNull() | (F.col("all") >= least)))
    return at.groupBy("lang").agg((F.min("step") / steps).alias("log_limit"))


#: One trusted document in so many is held out of the training and sets the limits.
HELD_OUT = 5


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.995, margin: float = 0.06, nats: float = 16.0) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang): doc_id, lang, n_symbols, perplexity, limit, kept.

    trusted_ids (doc_id) names the documents that train the model or, one in HELD_OUT by the hash of its id, set the limits:
    a document is kept if its log perplexity is at most its language's quantile plus margin plus nats / n_symbols: a few odd
    symbols, worth `nats` of surprise in all, don't condemn a short text. Languages with fewer than 200 held-out documents,
    null and unknown ones use the quantile over all languages. Null and empty texts have no perplexity and aren't kept.
    Without any held-out document there is no limit, and whatever has a perplexity is kept. Repeated rows are judged row by
    row; other columns are ignored. docs must be a stored table, or read alike each time.
    """
    ids = stage_table(trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted", like=trusted_ids)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    scores = stage_table(perplexities(docs, keep_within(docs.select("doc_id", "text"), ids.where(~aside))), "perplexities", like=docs)
    limits = stage_table(thresholds(keep_within(scores, ids.where(aside)), quantile), "limits", files=1)
    overall = limits.where("lang is null").select(F.col("log_limit").alias("overall"))
    # As many rows as languages with 200 held-out documents; one row.
    out = scores.join(limits.where("lang is not null"), "lang", "left").join(F.broadcast(overall), F.lit(True), "left")
    limit = F.coalesce("log_limit", "overall", F.lit(float("inf"))) + margin + F.try_divide(F.lit(nats), F.col("n_symbols"))
    return out.select("doc_id", "lang", "n_symbols", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("limit"), F.coalesce(F.col("log_ppl") <= limit, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, with all columns. An id of which one row isn't kept goes with all its rows;
    rows without an id stay."""
    return drop_without(docs, stage_table(classify(docs, trusted_ids).where("NOT kept AND doc_id is not null").select("doc_id").distinct(), "rejected", like=docs))


def trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))
