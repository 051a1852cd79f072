"""Firm profiles, their drift, and synthetic padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NAME_FLAGS


def firm_profile(df: DataFrame, firm_map: DataFrame, firms: DataFrame | None = None, repeat: bool = False) -> DataFrame:
    """(firm, template_id, uses, weight, and the mean of each name flag) for each template in a firm's map.

    df has firm, template_id and the flags. With repeat every use of a template is a row of its own, so that weights go with
    the square of the count.
    """
    m = firm_map.join(firms.select("firm").distinct(), "firm", "left_semi") if firms is not None else firm_map
    listed = m.select("firm", F.explode(F.col("template_ids") if repeat else F.array_distinct("template_ids")).alias("template_id"))
    flags = [F.avg(F.col(f).cast("double")).alias(f"p_{f}") for f in NAME_FLAGS]
    uses = df.where("template_id is not null").groupBy("firm", "template_id").agg(F.count("*").alias("uses"), *flags)
    p = listed.join(uses, ["firm", "template_id"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    total = F.sum("uses").over(Window.partitionBy("firm"))
    return p.withColumn("weight", F.coalesce(F.try_divide(F.col("uses").cast("double"), total), F.lit(0.0)))


def nested_profiles(profile: DataFrame, firm_map: DataFrame) -> DataFrame:
    """One row a firm: flags, num_investors and templates as array<struct<template_id, weight, flag_probs>>."""
    probs = F.create_map(*[x for f in NAME_FLAGS for x in (F.lit(f), F.col(f"p_{f}"))])
    nested = profile.groupBy("firm").agg(F.array_sort(F.collect_list(F.struct("template_id", "weight"))).alias("templates"), F.transform(F.array_sort(F.collect_list(F.struct("template_id", F.to_json(probs).alias("flag_probs")))), lambda x: F.struct(x["template_id"].alias("template_id"), F.from_json(x["flag_probs"], "map<string,double>").alias("flag_probs"))).alias("probabilities"))
    return nested.join(firm_map.select("firm", "is_shared_infra", "firm_is_multi_domain", "num_investors"), "firm", "left")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(firm, weight_drift, flag_drift, mismatched): per firm the largest changes over its templates, which either profile
    may lack."""
    cols = ["weight", *[f"p_{f}" for f in NAME_FLAGS]]
    side = lambda df, s: df.select("firm", "template_id", *[F.col(c).alias(f"{c}_{s}") for c in cols], F.lit(True).alias(f"in_{s}"))
    j = side(before, "b").join(side(after, "a"), ["firm", "template_id"], "full")
    gap = lambda c: F.abs(F.coalesce(f"{c}_b", F.lit(0.0)) - F.coalesce(f"{c}_a", F.lit(0.0)))
    both = F.col("in_a") & F.col("in_b")
    return j.groupBy("firm").agg(
        F.max(gap("weight")).alias("weight_drift"), F.max(F.when(both, F.greatest(*[gap(c) for c in cols[1:]]))).alias("flag_drift"), F.count_if(~F.coalesce(both, F.lit(False))).alias("mismatched")
    )


def drift_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    d = drift(before, after)
    return d.agg(F.max("weight_drift").alias("max_weight_drift"), F.max("flag_drift").alias("max_flag_drift"), F.sum("mismatched").alias("template_mismatches"), F.count("*").alias("firms"))


def apportion(profile: DataFrame, totals: DataFrame) -> DataFrame:
    """(firm, template_id, n): totals (firm, total) dealt by weight; floors first, then one each by largest remainder, ties by
    template."""
    x = profile.join(totals, "firm").withColumn("exact", F.round(F.col("weight") * F.col("total"), 9)).withColumn("base", F.floor("exact"))
    w = Window.partitionBy("firm")
    short = F.col("total") - F.sum("base").over(w)
    rn = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), "template_id"))
    return x.select("firm", "template_id", (F.col("base") + F.when(rn <= short, 1).otherwise(0)).cast("long").alias("n"))


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) by a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def synthetic_contacts(profile: DataFrame, firm_map: DataFrame, target: int, starting_id: int = 1_000_000) -> DataFrame:
    """Rows that bring every firm of the profile to `target` investors: ids from starting_id + 1 by firm and template, names
    synthetic_investor_{firm}_{id}, flags drawn by their probabilities.

    Ids are a prefix sum over the firms, one small row each, so only firms are ordered in one place.
    """
    totals = firm_map.select("firm", (F.lit(target) - F.col("num_investors")).cast("long").alias("total")).where("total > 0")
    dealt = apportion(profile, totals).where("n > 0")
    firms = dealt.groupBy("firm").agg(F.sum("n").alias("n"))
    before = firms.select("firm", (F.sum("n").over(Window.orderBy("firm").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shift"))
    within = F.sum("n").over(Window.partitionBy("firm").orderBy("template_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = dealt.withColumn("within", within).join(before, "firm").join(profile.drop("uses", "weight"), ["firm", "template_id"])
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("id", F.lit(starting_id) + F.col("shift") + F.col("within") + F.col("k"))
    flags = [(_uniform("id", F.lit(f)) < F.col(f"p_{f}")).alias(f) for f in NAME_FLAGS]
    return rows.select(F.col("id").cast("long").alias("id"), F.concat(F.lit("synthetic_investor_"), "firm", F.lit("_"), F.col("id").cast("string")).alias("investor"), "firm", "template_id", *flags)


def pad(df: DataFrame, profile: DataFrame, firm_map: DataFrame, target: int, starting_id: int = 1_000_000) -> DataFrame:
    """df with synthetic rows, which have null in columns of df that they lack."""
    return df.unionByName(synthetic_contacts(profile, firm_map, target, starting_id), allowMissingColumns=True)
