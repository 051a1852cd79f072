"""URL filters: host-suffix and path-prefix expressions, joined to the rules on short hash prefixes.

Every distinct (host, path) is expanded into the expressions that some rule could equal: for each shape that occurs among
the rules (labels in the host, characters in the path), the host's last labels and the path's first characters. The
expressions meet the rules on the first hex digits of their SHA-256 digests, the full digests confirm, and the longest
rule wins. No step depends on a page's own depth or length, and nothing is cut off: an expression of another shape can
equal no rule.

Scale: the pages are reduced to distinct resources before the expansion, the rules are broadcast only if Spark finds them
under its own threshold, and all joins are equi-joins. Resources that very many pages share, and their number is bounded, meet
the pages by a broadcast, the others by a shuffle (join_by_counts).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_by_counts, let, literal_table, stage_table, table

#: (host, path, action)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default_verdict: str = "allow", prefix_digits: int = 8
) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, verdict. rules: host, path, action.

    Null urls and urls without '://' have an empty host and path, fit no rule and get default_verdict, as does every url
    that no rule fits. Of equally long rules the longer host wins, then block. Repeated rows are judged row by row; other
    columns of pages are ignored; an empty table gives an empty result. The shapes of the rules are the only thing
    collected, as one value: at most (labels of the deepest host) x (characters of the longest path) numbers.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action").where("rule_host is not null and rule_path is not null").distinct()
    r = r.select(F.size(F.split("rule_host", r"\.")).alias("n_labels"), F.length("rule_path").alias("n_path"), "rule_host", F.concat("rule_host", "rule_path").alias("rule"), "action")
    # One value, however many shapes there are, so that the plan doesn't grow with the rules.
    shapes = r.groupBy("n_labels").agg(F.array_sort(F.collect_set("n_path")).alias("n_paths")).orderBy("n_labels").collect()
    known = F.from_json(F.lit(json.dumps([s.asDict() for s in shapes])), "array<struct<n_labels:int,n_paths:array<int>>>")
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    resources = stage_table(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "resources", like=pages.select(id_col, url_col))
    labels = F.split("host", r"\.")

    def expressions(parts: Column, s: Column) -> Column:
        suffix = F.array_join(F.slice(parts, -s["n_labels"], s["n_labels"]), ".")
        return F.transform(F.filter(s["n_paths"], lambda n: n <= F.length("path")), lambda n: F.concat(suffix, F.substring(F.col("path"), F.lit(1), n)))

    every = let(labels, lambda parts: F.flatten(F.transform(F.filter(known, lambda s: s["n_labels"] <= F.size(parts)), lambda s: expressions(parts, s))))
    found = resources.select("host", "path", F.explode(every).alias("expression"))
    found = found.withColumn("digest", F.sha2("expression", 256)).select("host", "path", "digest", F.substring("digest", 1, prefix_digits).alias("prefix"))
    listed = r.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("rule_digest", 1, prefix_digits))
    best = (
        found.join(listed, "prefix")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block")).alias("best"))
    )
    judged = stage_table(resources.join(best, ["host", "path"], "left"), "judged", like=resources)
    out = join_by_counts(urls, judged, ["host", "path"])
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default_verdict)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), literal_table(spark, ("host", "path", "action"), RULES))


OP9_SQL = f"""
WITH rules(host, path, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
best AS (
  SELECT d.host, d.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.action, length(r.host || r.path)) AS action
  FROM (SELECT DISTINCT host, path FROM p) d
  JOIN rules r ON (d.host = r.host OR ends_with(d.host, '.' || r.host)) AND starts_with(d.path, r.path)
  GROUP BY d.host, d.path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""
