"""Template catalogue: frequency, structure, rule statistics, ids; firm maps and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, tokens
from ..functions.text import domain_of, local_of


def encode_contacts(df: DataFrame) -> DataFrame:
    """df with local_part, domain and token_seq (replaced if there), without a shuffle."""
    d = df.withColumns({"local_part": F.lower(local_of(F.col("email"))), "domain": domain_of(F.col("email"), "part")})
    return d.withColumn("token_seq", tokens.tokenize_local(F.col("local_part"), names.decompose_train(F.col("investor"))))


def template_counts(df: DataFrame) -> DataFrame:
    """(template, support_count, coverage_pct): share of all rows with a template."""
    n = df.where("token_seq is not null").groupBy(F.col("token_seq").alias("template")).agg(F.count("*").alias("support_count"))
    # One row.
    total = n.agg(F.sum("support_count").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("template", "support_count", (F.col("support_count") / F.col("total")).alias("coverage_pct"))


def matching_rules(templates: DataFrame, rules: DataFrame) -> DataFrame:
    """Templates and the rules whose left and right side, in this order, are a subsequence of them. Rules and templates are
    both a few hundred; the rules go to the templates."""
    rules = rules.select(F.concat("lhs", "rhs").alias("both"), "confidence")
    return templates.select("template").join(F.broadcast(rules), tokens.is_subsequence(F.col("both"), F.col("template")))


def enrich_templates(df: DataFrame, rules: DataFrame) -> DataFrame:
    """template_counts with rule statistics (0 without a rule) and structure flags."""
    counts = template_counts(df)
    stats = matching_rules(counts, rules).groupBy("template").agg(F.max("confidence").alias("mx"), F.avg("confidence").alias("av"))
    out = counts.join(stats, "template", "left")
    return out.select(
        "template", "support_count", "coverage_pct", F.col("mx").isNotNull().alias("in_mined_rules"), F.coalesce("mx", F.lit(0.0)).alias("max_rule_confidence"),
        F.coalesce("av", F.lit(0.0)).alias("avg_rule_confidence"), *[c.alias(n) for n, c in tokens.structure_flags(F.col("template")).items()],
    )


def number_templates(enriched: DataFrame, least: int = 2) -> DataFrame:
    """Templates of at least that support, with ids from 1 by support, then by rendered template. One row a template, so the
    numbering is small."""
    w = Window.orderBy(F.desc("support_count"), F.array_join("template", " "))
    return enriched.where(F.col("support_count") >= least).select(F.row_number().over(w).cast("long").alias("template_id"), *enriched.columns)


def with_template_id(df: DataFrame, candidates: DataFrame) -> DataFrame:
    return df.join(candidates.select(F.col("template").alias("token_seq"), "template_id"), "token_seq", "left")


def firm_template_map(df: DataFrame) -> DataFrame:
    """By firm, of rows with template_id (null where pruned): sorted ids with repeats, counts, diversity and flags."""
    # A firm's contacts are a few thousand at most.
    return (
        df.where("firm is not null and token_seq is not null")
        .groupBy("firm")
        .agg(
            F.array_sort(F.collect_list("template_id")).alias("template_ids"), F.countDistinct("template_id").alias("num_templates"), F.count("investor").alias("num_investors"),
            F.bool_or("is_shared_infra").alias("is_shared_infra"), F.bool_or("firm_is_multi_domain").alias("firm_is_multi_domain"),
        )
        .withColumn("diversity_ratio", F.try_divide("num_templates", "num_investors"))
        .withColumn("is_single_template", F.col("num_templates") == 1)
    )


def firm_template_usage(firm_map: DataFrame) -> DataFrame:
    """(firm, template_id, support_count, coverage_pct, is_top_template), ties all top."""
    n = firm_map.select("firm", F.explode("template_ids").alias("template_id")).groupBy("firm", "template_id").agg(F.count("*").alias("support_count"))
    w = Window.partitionBy("firm")
    return n.select(
        "firm", "template_id", "support_count", (F.col("support_count") / F.sum("support_count").over(w)).alias("coverage_pct"),
        (F.col("support_count") == F.max("support_count").over(w)).alias("is_top_template"),
    )


def in_id_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("template_id")


def firm_template_strings(firm_map: DataFrame, candidates: DataFrame) -> DataFrame:
    """(firm, templates): the distinct templates of each firm, rendered, in the order of their ids."""
    listed = firm_map.select("firm", F.explode(F.array_distinct("template_ids")).alias("template_id"))
    named = listed.join(candidates.select("template_id", F.array_join("template", " ").alias("template")), "template_id")
    # No more items to a firm than there are templates.
    return named.groupBy("firm").agg(F.transform(F.array_sort(F.collect_list(F.struct("template_id", "template"))), lambda x: x["template"]).alias("templates"))
