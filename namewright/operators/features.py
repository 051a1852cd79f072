"""The (contact x template) feature matrix, for training and for serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FEATURES, NAME_FLAGS, TEMPLATE_FLAGS, require_columns

CONTACT_COLUMNS = ("id", "investor", "firm", "is_shared_infra", "firm_is_multi_domain", *NAME_FLAGS)


def clash_train(tokens: Column) -> Column:
    any_of = lambda f: F.exists(tokens, f)
    has = lambda word: lambda t: F.contains(t, F.lit(word))
    return (
        (F.col("has_middle_name") & any_of(lambda t: t.startswith("m_") | has("middle")(t)))
        | (F.col("has_multiple_last_names") & any_of(lambda t: t.startswith("l_") | has("last")(t)))
        | (F.col("has_multiple_first_names") & any_of(lambda t: t.startswith("f_") | has("first_original_1")(t)))
        | (F.col("has_nfkd_normalized") & any_of(has("nfkd")))
        | (F.col("has_nickname") & any_of(has("nickname")))
    )


def clash_serve() -> Column:
    pairs = (("uses_middle_name", "has_middle_name"), ("uses_multiple_firsts", "has_multiple_first_names"), ("uses_multiple_middles", "has_multiple_middle_names"), ("uses_multiple_lasts", "has_multiple_last_names"))
    out = F.lit(False)
    for t, c in pairs:
        out = out | (F.col(t) & F.col(c))
    return out


def feature_rows(contacts: DataFrame, candidates: DataFrame, firm_map: DataFrame, usage: DataFrame, clash: str = "train", with_label: bool = True) -> DataFrame:
    """Every contact with every candidate template, the features in order, and label (template = token_seq).

    Candidates are a few hundred and go to the contacts, as the product is what is asked for; firms and usage join by key, the
    firms before the product is made. Firms without statistics have nulls, templates that a firm doesn't use 0 and false.
    """
    require_columns(contacts, (*CONTACT_COLUMNS, *(["token_seq"] if with_label else [])))
    c = contacts.select(*CONTACT_COLUMNS, *(["token_seq"] if with_label else []))
    stats = firm_map.select("firm", *[F.col(x).alias(f"firm_{x}") for x in ("num_templates", "num_investors", "diversity_ratio", "is_single_template")])
    use = usage.groupBy("firm").agg(F.map_from_entries(F.collect_list(F.struct("template_id", F.struct("support_count", "coverage_pct", "is_top_template")))).alias("usage"))
    c = c.join(stats, "firm", "left").join(use, "firm", "left")
    t = candidates.select("template_id", "template", F.col("support_count").alias("t_support"), F.col("coverage_pct").alias("t_coverage"), "in_mined_rules", "max_rule_confidence", "avg_rule_confidence", *TEMPLATE_FLAGS)
    x = c.crossJoin(F.broadcast(t)).withColumn("u", F.try_element_at("usage", F.col("template_id")))
    of = {
        "template_in_firm_templates": F.col("u").isNotNull(), "template_firm_support_count": F.coalesce("u.support_count", F.lit(0)),
        "template_firm_coverage_pct": F.coalesce("u.coverage_pct", F.lit(0.0)), "template_is_top_template": F.coalesce("u.is_top_template", F.lit(False)),
        "firm_is_shared_infra": F.col("is_shared_infra"), "firm_is_multi_domain": F.col("firm_is_multi_domain"),
        **{f"investor_{n}": F.col(n) for n in NAME_FLAGS}, "template_support_count": F.col("t_support"), "template_coverage_pct": F.col("t_coverage"),
        **{f"template_{n}": F.col(n) for n in ("in_mined_rules", "max_rule_confidence", "avg_rule_confidence", *TEMPLATE_FLAGS)},
        "template_name_characteristic_clash": clash_train(F.col("template")) if clash == "train" else clash_serve(),
        **{f"firm_{n}": F.col(f"firm_{n}") for n in ("num_templates", "num_investors", "diversity_ratio", "is_single_template")},
    }
    cols = [of[f].cast("double").alias(f) for f in FEATURES]
    label = [F.coalesce(F.col("template") == F.col("token_seq"), F.lit(False)).cast("long").alias("label")] if with_label else []
    return x.select(F.col("id").alias("clean_row_id"), "investor", "firm", "template_id", *cols, *label)


def check_labels(matrix: DataFrame) -> DataFrame:
    """(clean_row_id, labels, ok): one label a contact is expected."""
    return matrix.groupBy("clean_row_id").agg(F.sum("label").alias("labels")).withColumn("ok", F.col("labels") == 1)


def assert_labels(matrix: DataFrame) -> DataFrame:
    """The matrix; raises if a contact has no label or several."""
    bad = check_labels(matrix).where("NOT ok").limit(1).collect()
    if bad:
        raise ValueError(f"contact {bad[0]['clean_row_id']} has {bad[0]['labels']} labels")
    return matrix
