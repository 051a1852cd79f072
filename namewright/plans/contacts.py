"""Contacts derived from the part table, the carrier of the contact operators' queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, templates
from ..schemas import NAME_FLAGS

FLAG_MODULI = dict(zip(NAME_FLAGS, (3, 4, 5, 6, 7, 8, 9), strict=True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    d = table(spark, sf_dir, "part").select(
        e("p_partkey AS id"), e("p_name AS investor"), e("lower(replace(p_brand, '#', '_') || ' ' || p_type) AS firm"), e("p_type AS role"), e("cast(p_size AS bigint) AS title"),
        e("cast(replace(p_brand, 'Brand#', '') AS bigint) AS brand_no"), e("split_part(p_name, ' ', 1) AS first"), e("split_part(p_name, ' ', 2) AS last"),
    )
    d = d.withColumn("k", e("CASE WHEN id % 5 = 0 THEN id % 7 ELSE brand_no % 7 END"))
    d = d.withColumn("local", e("CASE k WHEN 2 THEN substring(first, 1, 1) || last WHEN 3 THEN first WHEN 4 THEN substring(first, 1, 1) || '.' || last WHEN 5 THEN first || '_' || last WHEN 6 THEN last || '.' || substring(first, 1, 1) ELSE first || '.' || last END"))
    d = d.withColumn("site", e("CASE WHEN id % 11 = 0 AND brand_no % 3 = 0 THEN 'gmail.com' WHEN brand_no % 4 = 0 THEN replace(replace(firm, ' ', ''), '_', '') || '.com' ELSE 'brand_' || brand_no || '.com' END"))
    d = d.withColumn("email", e("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'x?' || local || '@' || site ELSE local || '@' || site END"))
    d = d.withColumn("linkedin", e("CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'linkedin.com/company/' || last ELSE 'https://www.linkedin.com/in/' || first || '-' || last || '?trk=' || id END"))
    d = d.withColumns({"tel": e("'+' || (id % 90) || ' (' || brand_no || ') ' || title || '-' || id"), "website": e("' https://WWW.' || site || '/home?x=' || id"), "general_email": e("CASE WHEN id % 3 = 0 THEN NULL ELSE 'info@' || site END")})
    return d.select("id", "investor", "firm", "role", "title", "brand_no", "first", "last", "k", "email", "linkedin", "tel", "website", "general_email")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.drop_invalid_local(quality.drop_missing_email(contacts(spark, sf_dir)))
    return quality.flag_multi_domain(quality.flag_shared_domain(d))


_KEPT: dict[tuple, DataFrame] = {}


def _kept(make):
    """make's table, kept by the executors for as long as the application runs, so that the queries that need it share the
    tokenizing and numbering, and the branches of one plan too. What doesn't fit in memory goes to disk."""

    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, make.__name__, sf_dir)
        if key not in _KEPT:
            _KEPT[key] = make(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        return _KEPT[key]

    return table


@_kept
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean contacts with token_seq and flags by id, as the names have no structure of their own."""
    return templates.encode_contacts(clean(spark, sf_dir)).withColumns({f: F.col("id") % m == 0 for f, m in FLAG_MODULI.items()})


#: Rules with fixed confidences, so that enriched templates don't need the miner.
RULES = (("first_original_0", "last_original_0", 0.75), (".", "last_original_0", 0.5), ("f_0", "last_original_0", 0.25))


def rules(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.array(F.lit(a)).alias("lhs"), F.array(F.lit(b)).alias("rhs"), F.lit(c).alias("confidence")) for a, b, c in RULES])))


@_kept
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.number_templates(templates.enrich_templates(encoded(spark, sf_dir), rules(spark)))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.with_template_id(encoded(spark, sf_dir), candidates(spark, sf_dir))


@_kept
def firm_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.firm_template_map(identified(spark, sf_dir))


CONTACTS_SQL = """
parts AS (
  SELECT p_partkey AS id, p_name AS investor, lower(replace(p_brand, '#', '_') || ' ' || p_type) AS firm, p_type AS role, CAST(p_size AS BIGINT) AS title,
         CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_no, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last
  FROM part),
parts_k AS (SELECT *, CASE WHEN id % 5 = 0 THEN id % 7 ELSE brand_no % 7 END AS k FROM parts),
parts_l AS (
  SELECT *, CASE k WHEN 2 THEN substring(first, 1, 1) || last WHEN 3 THEN first WHEN 4 THEN substring(first, 1, 1) || '.' || last WHEN 5 THEN first || '_' || last
                   WHEN 6 THEN last || '.' || substring(first, 1, 1) ELSE first || '.' || last END AS local,
         CASE WHEN id % 11 = 0 AND brand_no % 3 = 0 THEN 'gmail.com' WHEN brand_no % 4 = 0 THEN replace(replace(firm, ' ', ''), '_', '') || '.com'
              ELSE 'brand_' || brand_no || '.com' END AS site
  FROM parts_k),
contacts AS (
  SELECT id, investor, firm, role, title, brand_no, first, last, k,
         CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN 'x?' || local || '@' || site ELSE local || '@' || site END AS email,
         CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'linkedin.com/company/' || last ELSE 'https://www.linkedin.com/in/' || first || '-' || last || '?trk=' || id END AS linkedin,
         '+' || (id % 90) || ' (' || brand_no || ') ' || title || '-' || id AS tel, ' https://WWW.' || site || '/home?x=' || id AS website,
         CASE WHEN id % 3 = 0 THEN NULL ELSE 'info@' || site END AS general_email
  FROM parts_l)"""
CLEAN_SQL = (
    CONTACTS_SQL
    + """,
kept AS (
  SELECT *, lower(regexp_extract(email, '@(.*)$', 1)) AS domain, split_part(email, '@', 1) AS local_part FROM contacts
  WHERE email IS NOT NULL AND contains(email, '@') AND regexp_matches(split_part(email, '@', 1), '^[A-Za-z0-9._-]+$')),
clean AS (
  SELECT k.*, coalesce(d.shared, false) AS is_shared_infra, coalesce(f.multi, false) AS firm_is_multi_domain
  FROM kept k
  LEFT JOIN (SELECT domain, count(DISTINCT firm) > 1 AS shared FROM kept GROUP BY domain) d ON k.domain = d.domain
  LEFT JOIN (SELECT firm, count(DISTINCT domain) > 1 AS multi FROM kept GROUP BY firm) f ON k.firm = f.firm)"""
)
_FLAGS = ", ".join(f"id % {m} = 0 AS {f}" for f, m in FLAG_MODULI.items())
ENCODED_SQL = (
    CLEAN_SQL
    + f""",
encoded AS (
  SELECT *, CASE k WHEN 2 THEN 'f_0 last_original_0' WHEN 3 THEN 'first_original_0' WHEN 4 THEN 'f_0 . last_original_0' WHEN 5 THEN 'first_original_0 _ last_original_0'
                   WHEN 6 THEN 'last_original_0 . f_0' ELSE 'first_original_0 . last_original_0' END AS template, {_FLAGS}
  FROM clean)"""
)
CANDIDATES_SQL = (
    ENCODED_SQL
    + f""",
rules(lhs, rhs, confidence) AS (VALUES {", ".join(str(r) for r in RULES)}),
counts AS (SELECT template, count(*) AS support_count, count(*) / sum(count(*)) OVER () AS coverage_pct FROM encoded GROUP BY template),
matched AS (
  SELECT c.template, max(r.confidence) AS mx, avg(r.confidence) AS av
  FROM counts c JOIN rules r ON list_position(string_split(c.template, ' '), r.lhs) < list_position(string_split(c.template, ' '), r.rhs)
  GROUP BY c.template),
candidates AS (
  SELECT row_number() OVER (ORDER BY c.support_count DESC, c.template) AS template_id, c.*, m.mx IS NOT NULL AS in_mined_rules, coalesce(mx, 0.0) AS max_rule_confidence,
         coalesce(av, 0.0) AS avg_rule_confidence
  FROM counts c LEFT JOIN matched m ON c.template = m.template WHERE c.support_count >= 2),
identified AS (SELECT e.*, c.template_id FROM encoded e LEFT JOIN candidates c ON e.template = c.template),
firm_map AS (
  SELECT firm, list(template_id ORDER BY template_id) FILTER (template_id IS NOT NULL) AS template_ids, count(DISTINCT template_id) AS num_templates, count(investor) AS num_investors,
         bool_or(is_shared_infra) AS is_shared_infra, bool_or(firm_is_multi_domain) AS firm_is_multi_domain,
         count(DISTINCT template_id) / count(investor) AS diversity_ratio, count(DISTINCT template_id) = 1 AS is_single_template
  FROM identified GROUP BY firm),
uses AS (SELECT firm, template_id, count(*) AS support_count FROM identified WHERE template_id IS NOT NULL GROUP BY firm, template_id),
usage AS (
  SELECT *, support_count / sum(support_count) OVER (PARTITION BY firm) AS coverage_pct, support_count = max(support_count) OVER (PARTITION BY firm) AS is_top_template FROM uses)"""
)
