"""Canonical firms, fuzzy resolution of firm names to domains, noisy variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import domain_of
from ..sources.tables import numbered_rows


def firm_domain_counts(df: DataFrame) -> DataFrame:
    d = df.withColumn("domain", domain_of(F.col("email"), "part")).where("firm is not null and domain is not null")
    return d.groupBy("firm", "domain").agg(F.count("*").alias("n"))


def canonical_firms(df: DataFrame) -> DataFrame:
    """Each firm's most frequent domain, ties by name."""
    w = Window.partitionBy("firm").orderBy(F.desc("n"), "domain")
    return firm_domain_counts(df).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("firm", "domain")


def fuzzy_top1(names: DataFrame, canonical: DataFrame, form: Callable[[Column], Column] = similarity.sort_tokens, threshold: float = 85.0) -> DataFrame:
    """(raw_firm, firm, domain, score): of the canonical firms reaching threshold the best, ties by firm. Scores are ratios of the
    lower-cased names in the given form.

    The distinct names meet the distinct firms on their lengths, which is lossless: an indel ratio of t needs a common
    subsequence of t/200 of both lengths together, so the shorter is at least t/(200-t) of the longer. Without a threshold
    every distinct name meets every firm.
    """
    raw = names.select("raw_firm").where("raw_firm is not null").distinct().withColumn("key", form(F.lower("raw_firm")))
    raw = raw.withColumn("masks", F.when(F.length("key") <= similarity.MASK_BITS, similarity.masks(F.col("key"))))
    firms = canonical.select("firm", "domain").distinct().withColumn("firm_key", form(F.lower("firm")))
    if threshold <= 0:
        pairs = raw.join(firms, F.lit(True))
    else:
        least = threshold / (200 - threshold)
        # Lengths that a name's length admits, by equality: one row for each.
        n, m = F.length("key"), F.length("firm_key")
        by_length = raw.withColumn("m", F.explode(F.sequence(F.ceil(n * least).cast("int"), F.floor(n / least).cast("int"))))
        pairs = by_length.join(firms.withColumn("m", m), "m").drop("m")
    scored = pairs.withColumn("score", similarity.masked_ratio(F.col("key"), F.col("masks"), F.col("firm_key"))).where(F.col("score") >= threshold)
    return scored.groupBy("raw_firm").agg(F.min_by(F.struct("firm", "domain", "score"), F.struct(-F.col("score"), F.col("firm"))).alias("b")).select("raw_firm", "b.*")


def resolve(
    names: DataFrame, canonical: DataFrame, cache: DataFrame | None = None, form=similarity.sort_tokens, threshold: float = 85.0, lower: bool = True, score_below: bool = True
) -> DataFrame:
    """(raw_firm, firm, domain, score) for each distinct name: from the cache, else the exact firm, else the best fuzzy match;
    below the threshold firm and domain are null, and score is that of the best match (null without any firm). Only names that
    the cheaper steps leave reach the fuzzy one, and only those that no firm reaches by the threshold meet every firm; without
    score_below none does, and their score is null."""
    key = lambda c: F.lower(c) if lower else F.col(c)
    raw = names.select("raw_firm").where("raw_firm is not null").distinct()
    parts = []
    left = raw
    if cache is not None:
        hit = left.join(cache.select("raw_firm", F.col("canonical_firm").alias("firm"), "domain", F.col("match_score").cast("double").alias("score")), "raw_firm")
        parts.append(hit)
        left = left.join(cache, "raw_firm", "left_anti")
    firms = canonical.groupBy(key("firm").alias("k")).agg(F.min(F.struct("firm", "domain")).alias("f"))
    exact = left.withColumn("k", key("raw_firm")).join(firms, "k").select("raw_firm", "f.firm", "f.domain", F.lit(100.0).alias("score"))
    rest = left.join(exact, "raw_firm", "left_anti")
    fuzzy = rest.join(fuzzy_top1(rest, canonical, form, threshold), "raw_firm", "left").select("raw_firm", "firm", "domain", "score")
    if score_below and threshold > 0:
        below = fuzzy_top1(fuzzy.where("firm IS NULL").select("raw_firm"), canonical, form, 0.0).select("raw_firm", F.col("score").alias("below"))
        fuzzy = fuzzy.join(below, "raw_firm", "left").select("raw_firm", "firm", "domain", F.coalesce("score", "below").alias("score"))
    out = exact.unionByName(fuzzy)
    for p in parts:
        out = out.unionByName(p)
    return out


def add_typo(name: Column, salt: str) -> Column:
    """One swapped, deleted or inserted character, by a hash of the name and salt; names under three characters stay."""
    h = F.xxhash64(name, F.lit(salt))
    n = F.length(name)
    i = F.pmod(h, (n - 1).cast("long")).cast("int")
    head, tail = lambda k: F.substring(name, F.lit(1), k), lambda k: F.substring(name, k + 1, n)
    swap = F.concat(head(i), F.substring(name, i + 2, F.lit(1)), F.substring(name, i + 1, F.lit(1)), tail(i + 2))
    delete = F.concat(head(i), tail(i + 1))
    insert = F.concat(head(i), F.char(97 + F.pmod(F.shiftrightunsigned(h, 20), F.lit(26))), tail(i))
    kind = F.pmod(F.shiftrightunsigned(h, 8), F.lit(3))
    return F.when(n < 3, name).when(kind == 0, swap).when(kind == 1, delete).otherwise(insert)


def noisy_variants(canonical: DataFrame) -> DataFrame:
    """(firm, variant): up to 11 spellings of each firm other than its own."""
    f = F.col("firm")
    title = F.initcap(f)
    made = [F.lower(f), F.upper(f), title, F.replace(f, F.lit(" "), F.lit("")), F.concat(f, F.lit(" Inc")), *[add_typo(f, f"a{k}") for k in range(3)], *[add_typo(title, f"b{k}") for k in range(3)]]
    return canonical.select("firm", F.explode(F.array_distinct(F.array(*made))).alias("variant")).where("variant <> firm")


def populate_cache(canonical: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Cache rows (raw_firm, canonical_firm, domain, match_score) of all variants that resolve."""
    return cache_rows(resolve(noisy_variants(canonical).select(F.col("variant").alias("raw_firm")), canonical, threshold=threshold, score_below=False))


def cache_rows(resolved: DataFrame) -> DataFrame:
    """Resolved names as rows of the match cache, to be written through to it."""
    return resolved.where("firm is not null").select("raw_firm", F.col("firm").alias("canonical_firm"), "domain", F.col("score").alias("match_score"))


def resolve_domains(names: DataFrame, canonical: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(raw_firm, firm, domain, score) as serving does it: the trimmed, lower-cased name is looked up among the canonical firms
    (100), then in the cache, and else gets the firm with the largest plain ratio, however small, ties by firm."""
    key = lambda c: F.lower(F.trim(c))
    raw = names.select("raw_firm").where("raw_firm is not null").distinct().withColumn("k", key(F.col("raw_firm")))
    firms = canonical.groupBy(key(F.col("firm")).alias("k")).agg(F.min(F.struct("firm", "domain")).alias("f"))
    exact = raw.join(firms, "k").select("raw_firm", "k", "f.firm", "f.domain", F.lit(100.0).alias("score"))
    left, out = raw.join(exact, "raw_firm", "left_anti"), exact.drop("k")
    if cache is not None:
        known = cache.groupBy(key(F.col("raw_firm")).alias("k")).agg(F.min_by(F.struct("canonical_firm", "domain", "match_score"), F.col("raw_firm")).alias("c"))
        hit = left.join(known, "k").select("raw_firm", F.col("c.canonical_firm").alias("firm"), "c.domain", F.col("c.match_score").cast("double").alias("score"))
        left, out = left.join(hit, "raw_firm", "left_anti"), out.unionByName(hit)
    best = left.select("raw_firm").join(fuzzy_top1(left.select("raw_firm"), canonical, F.trim, 0.0), "raw_firm", "left")
    return out.unionByName(best.select("raw_firm", "firm", "domain", "score"))


def resolver_test_set(canonical: DataFrame) -> DataFrame:
    """(raw_firm, domain): canonical firms with their spaces removed, and the domain that they should resolve to."""
    return canonical.select(F.replace("firm", F.lit(" "), F.lit("")).alias("raw_firm"), "domain")


def seed_sql(seeds: DataFrame, batch: int = 5000) -> DataFrame:
    """(batch, sql): INSERT statements of the seeded firms and their domains, in batches of firm ids."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    rows = seeds.withColumn("batch", F.floor((F.col("firm_id") - 1) / batch))
    values = F.concat(F.lit("("), F.col("firm_id").cast("string"), F.lit(", "), quoted(F.col("firm")), F.lit(", "), quoted(F.col("domain")), F.lit(")"))
    # At most `batch` firms.
    made = rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("firm_id", "domain", values.alias("v")))), lambda x: x["v"]), ",\n").alias("v"))
    return made.select("batch", F.concat(F.lit("INSERT INTO firm_domains (firm_id, firm, domain) VALUES\n"), "v", F.lit(";")).alias("sql"))


def seed_firm_domains(df: DataFrame) -> DataFrame:
    """(firm_id, firm, domain): firms numbered by name, with their distinct domains."""
    pairs = df.withColumn("domain", domain_of(F.col("email"))).where("firm is not null and domain is not null").select("firm", "domain").distinct()
    ids = numbered_rows(pairs.select("firm").distinct(), ["firm"], "firm_id")
    return pairs.join(ids, "firm").select("firm_id", "firm", "domain")


def search_firms(firms: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Firms whose name holds the query, case-insensitive, in order; none for a query under two characters."""
    hit = F.contains(F.lower("firm"), F.lit(query.lower())) if len(query) >= 2 else F.lit(False)
    return firms.where(hit).orderBy("firm").limit(limit)


def domains_of_firm(seeds: DataFrame, firm_id: int) -> DataFrame:
    return seeds.where(F.col("firm_id") == firm_id).select("domain")
