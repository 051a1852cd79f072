"""Table catalogue, schemas and column contracts."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

NAME_FLAGS = ("has_german_char", "has_nfkd_normalized", "has_nickname", "has_multiple_first_names", "has_middle_name", "has_multiple_middle_names", "has_multiple_last_names")
DOMAIN_FLAGS = ("is_shared_infra", "firm_is_multi_domain")
TEMPLATE_FLAGS = ("uses_middle_name", "uses_multiple_firsts", "uses_multiple_middles", "uses_multiple_lasts")
CONTACT_TEXT = (
    "investor", "firm_type", "title", "firm", "alternative_name", "role", "job_title", "asset_class", "email", "tel", "city", "state", "country",
    "zip_code", "linkedin", "region", "address", "website", "general_email", "source_file",
)


class TableName(Enum):
    LP_RAW = "lp_raw"
    GP_RAW = "gp_raw"
    LP_CLEAN = "lp_clean"
    GP_CLEAN = "gp_clean"
    COMBINED_CLEAN = "combined_clean"
    CANONICAL_FIRMS = "canonical_firms"
    FIRM_MATCH_CACHE = "firm_match_cache"
    CANDIDATE_TEMPLATES = "candidate_templates"
    FIRM_TEMPLATE_MAP = "firm_template_map"
    FEATURE_MATRIX = "feature_matrix"
    FEATURE_MATRIX_COMPLEX = "feature_matrix_complex"


def _struct(*parts: tuple[Iterable[str], object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for names, t, nullable in parts for n in names])


_S, _L, _B, _D, _TOKENS = StringType(), LongType(), BooleanType(), DoubleType(), ArrayType(StringType())
_RAW = [(["id"], _L, False), (CONTACT_TEXT, _S, True), (["time_stamp"], TimestampType(), True)]
_CLEAN = [*_RAW, (DOMAIN_FLAGS, _B, True), (NAME_FLAGS, _B, True), (["token_seq"], _TOKENS, True)]
#: The 27 features of a (contact, template) row in the order that models take them.
FEATURES = (
    "template_in_firm_templates", "firm_is_shared_infra", "firm_is_multi_domain", "investor_has_german_char", "investor_has_nfkd_normalized",
    "investor_has_nickname", "investor_has_multiple_first_names", "investor_has_middle_name", "investor_has_multiple_middle_names",
    "investor_has_multiple_last_names", "template_support_count", "template_coverage_pct", "template_in_mined_rules", "template_max_rule_confidence",
    "template_avg_rule_confidence", "template_uses_middle_name", "template_uses_multiple_firsts", "template_uses_multiple_middles",
    "template_uses_multiple_lasts", "template_firm_support_count", "template_firm_coverage_pct", "template_is_top_template",
    "template_name_characteristic_clash", "firm_num_templates", "firm_num_investors", "firm_diversity_ratio", "firm_is_single_template",
)
_MATRIX = [(["clean_row_id"], _L, False), (["investor", "firm"], _S, True), (["template_id"], _L, False), (FEATURES, _D, True), (["label"], _L, False)]

SCHEMAS: dict[TableName, StructType] = {
    TableName.LP_RAW: _struct(*_RAW),
    TableName.GP_RAW: _struct(*_RAW),
    TableName.LP_CLEAN: _struct(*_CLEAN),
    TableName.GP_CLEAN: _struct(*_CLEAN),
    TableName.COMBINED_CLEAN: _struct(*_CLEAN, (["source"], _S, False), (["record_id"], _L, False)),
    TableName.CANONICAL_FIRMS: _struct((["id"], _L, True), (["firm", "domain"], _S, False)),
    TableName.FIRM_MATCH_CACHE: _struct((["raw_firm"], _S, False), (["canonical_firm", "domain"], _S, True), (["match_score"], _D, True)),
    TableName.CANDIDATE_TEMPLATES: _struct(
        (["template_id"], _L, False), (["template"], _TOKENS, False), (["support_count"], _L, False), (["coverage_pct"], _D, False), (["in_mined_rules"], _B, False),
        (["max_rule_confidence", "avg_rule_confidence"], _D, False), (TEMPLATE_FLAGS, _B, False),
    ),
    TableName.FIRM_TEMPLATE_MAP: _struct(
        (["firm"], _S, False), (["template_ids"], ArrayType(LongType()), False), (["num_templates", "num_investors"], _L, False), (["diversity_ratio"], _D, False),
        (["is_single_template", *DOMAIN_FLAGS], _B, False),
    ),
    TableName.FEATURE_MATRIX: _struct(*_MATRIX),
    TableName.FEATURE_MATRIX_COMPLEX: _struct(*_MATRIX),
}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_missing_columns(df: DataFrame, schema: StructType, default: object = None) -> DataFrame:
    """df with the columns of schema that it lacks, filled with default (additive migration)."""
    return df.withColumns({f.name: F.lit(default).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def check_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Raises on unknown columns and on missing ones that can't be null."""
    extra = [c for c in df.columns if c not in schema.names]
    missing = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns and f.name != "id"]
    if extra or missing:
        raise ValueError(f"unknown columns: {extra}; missing columns: {missing}")
    return df
