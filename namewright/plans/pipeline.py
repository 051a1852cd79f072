"""The batch pipeline over a Store: clean, mine templates, build training data. Every stage overwrites its tables, so that a
second run gives the same result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import domain_of
from ..operators import features, profile, quality, resolve, rules, split, templates
from ..schemas import SCHEMAS, TableName, with_missing_columns
from ..sources.tables import Store, combine_clean


@dataclass
class Settings:
    min_support: float = 0.01
    min_confidence: float = 0.01
    window: int = 3
    least_template_support: int = 2
    std_padding: int = 40
    complex_padding: int = 25
    val_ratio: float = 0.2
    test_ratio: float = 0.3
    seed: int = 42


def _fit(df: DataFrame, table: TableName) -> DataFrame:
    return with_missing_columns(df, SCHEMAS[table]).select(*SCHEMAS[table].names)


def clean_stage(store: Store) -> None:
    """lp_raw and gp_raw to lp_clean, gp_clean and combined_clean."""
    pairs = ((TableName.LP_RAW, TableName.LP_CLEAN), (TableName.GP_RAW, TableName.GP_CLEAN))
    for raw, table in pairs:
        d = quality.drop_invalid_local(quality.drop_missing_email(quality.standardise(store.read(raw))))
        store.replace(table, _fit(quality.flag_multi_domain(quality.flag_shared_domain(d)), table))
    both = combine_clean(store.read(TableName.LP_CLEAN), store.read(TableName.GP_CLEAN))
    both = both.withColumn("id", F.col("id") * 2 + F.when(F.col("source") == "gp", 1).otherwise(0))
    store.replace(TableName.COMBINED_CLEAN, _fit(both, TableName.COMBINED_CLEAN))


def template_stage(store: Store, s: Settings = Settings()) -> None:
    """combined_clean with flags and templates; candidate templates, firm map, canonical firms."""
    d = templates.encode_contacts(names.add_name_flags(store.read(TableName.COMBINED_CLEAN)))
    mined = rules.mine_rules(d, s.min_support, s.min_confidence, s.window)
    cand = templates.number_templates(templates.enrich_templates(d, mined), s.least_template_support)
    store.replace(TableName.CANDIDATE_TEMPLATES, _fit(cand, TableName.CANDIDATE_TEMPLATES))
    found = templates.with_template_id(d, store.read(TableName.CANDIDATE_TEMPLATES))
    store.replace(TableName.FIRM_TEMPLATE_MAP, _fit(templates.firm_template_map(found), TableName.FIRM_TEMPLATE_MAP))
    store.replace(TableName.CANONICAL_FIRMS, _fit(resolve.canonical_firms(d), TableName.CANONICAL_FIRMS))
    store.replace(TableName.COMBINED_CLEAN, _fit(found.where("template_id is not null"), TableName.COMBINED_CLEAN))


def feature_stage(store: Store, s: Settings = Settings()) -> dict[str, DataFrame]:
    """The two feature matrices, stored; the split of each: (id, split)."""
    cand = store.read(TableName.CANDIDATE_TEMPLATES)
    firm_map = store.read(TableName.FIRM_TEMPLATE_MAP)
    usage = templates.firm_template_usage(firm_map)
    d = templates.with_template_id(store.read(TableName.COMBINED_CLEAN), cand)
    splits = {}
    for part, table, least in zip(split.complexity_split(d), (TableName.FEATURE_MATRIX, TableName.FEATURE_MATRIX_COMPLEX), (s.std_padding, s.complex_padding)):
        low = split.low_investor_firms(firm_map, least)
        extra = profile.synthetic_contacts(profile.firm_profile(part, firm_map, low), firm_map.join(low, "firm", "left_semi"), least)
        flags = firm_map.select("firm", "is_shared_infra", "firm_is_multi_domain")
        extra = extra.join(flags, "firm", "left").join(cand.select("template_id", F.col("template").alias("token_seq")), "template_id")
        rows = part.unionByName(extra, allowMissingColumns=True)
        store.replace(table, _fit(features.feature_rows(rows, cand, firm_map, usage), table))
        splits[table.value] = split.stratified_split(part, domain_of(F.col("email")), s.val_ratio, s.test_ratio, s.seed)
    return splits


def run(store: Store, s: Settings = Settings()) -> dict[str, DataFrame]:
    clean_stage(store)
    template_stage(store, s)
    return feature_stage(store, s)
