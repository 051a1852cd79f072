"""Batch prediction: contacts to ranked e-mail addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, tokens
from .features import feature_rows
from .rank import Scorer, WeightedScorer, top_k
from .resolve import resolve_domains
from .split import is_complex


def predict(requests: DataFrame, candidates: DataFrame, firm_map: DataFrame, usage: DataFrame, canonical: DataFrame | None = None, scorer: Scorer | None = None,
            top: int = 3, filter_before_topk: bool = False, complex_candidates: DataFrame | None = None, complex_scorer: Scorer | None = None, cache: DataFrame | None = None) -> DataFrame:
    """requests (id, investor, firm, domain) -> (id, rank, email, score, template_id, verified).

    A null domain is resolved from the firm's name. Names with structure beyond first and last go to the complex templates
    and scorer, if given. Templates are scored within the plan, never stored; of the best `top` those that a name can't fill are
    dropped afterwards, or before with filter_before_topk. verified is null: nothing is sent anywhere.
    """
    scorer = scorer or WeightedScorer()
    r = requests
    if canonical is not None:
        found = resolve_domains(r.where("domain is null").select(F.col("firm").alias("raw_firm")), canonical, cache)
        r = r.join(found.select(F.col("raw_firm").alias("firm"), F.col("domain").alias("resolved")), "firm", "left").withColumn("domain", F.coalesce("domain", "resolved")).drop("resolved")
    flagged = names.add_name_flags(r.withColumn("firm", F.lower("firm")), profile="serve")
    flagged = flagged.join(firm_map.select("firm", "is_shared_infra", "firm_is_multi_domain"), "firm", "left").na.fill(False, ["is_shared_infra", "firm_is_multi_domain"])
    if complex_candidates is None:
        scored = scorer.score(feature_rows(flagged, candidates, firm_map, usage, "serve", with_label=False)).join(F.broadcast(candidates.select("template_id", "template")), "template_id")
    else:
        plain = scorer.score(feature_rows(flagged.where(~is_complex()), candidates, firm_map, usage, "serve", False)).join(F.broadcast(candidates.select("template_id", "template")), "template_id")
        hard = (complex_scorer or scorer).score(feature_rows(flagged.where(is_complex()), complex_candidates, firm_map, usage, "serve", False))
        scored = plain.unionByName(hard.join(F.broadcast(complex_candidates.select("template_id", "template")), "template_id"))
    scored = scored.select("clean_row_id", "investor", "template_id", "template", "score")
    local = tokens.render(F.col("template"), names.decompose_serve(F.col("investor")))
    if filter_before_topk:
        best = top_k(scored.withColumn("local", local).where("local is not null"), top)
    else:  # only the best are rendered
        best = top_k(scored, top).withColumn("local", local).where("local is not null")
    out = best.join(r.select(F.col("id").alias("clean_row_id"), "domain"), "clean_row_id")
    return out.select(F.col("clean_row_id").alias("id"), F.col("rank").cast("long").alias("rank"), F.concat("local", F.lit("@"), "domain").alias("email"), "score", "template_id", F.lit(None).cast("boolean").alias("verified"))


def predict_one(spark: SparkSession, investor: str, firm: str, domain: str | None, **tables) -> list[dict]:
    """One request's predictions as dictionaries of email and confidence, best first."""
    one = spark.createDataFrame([(1, investor, firm, domain)], "id long, investor string, firm string, domain string")
    return [{"email": x.email, "confidence": x.score} for x in predict(one, **tables).orderBy("rank").collect()]


def by_verification(predictions: DataFrame, scores: DataFrame) -> DataFrame:
    """predictions (id, email, score) with the verification score of each address (email, verification; null without one), the
    surest first within an id, ties by their own score and the address."""
    return predictions.join(scores, "email", "left").orderBy("id", F.desc_nulls_last("verification"), F.desc("score"), "email")


class Predictor:
    """The serving surface over loaded tables: one request, or a batch of them."""

    def __init__(self, spark: SparkSession, **tables):
        self.spark, self.tables = spark, tables

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Predictor:
        from ..sources.tables import load_snapshot
        from .templates import firm_template_usage

        t = load_snapshot(spark, path)
        return cls(
            spark, candidates=t["std_candidates"], complex_candidates=t["complex_candidates"], firm_map=t["firm_template_map"], usage=firm_template_usage(t["firm_template_map"]),
            canonical=t["canonical_firms"], cache=t["firm_match_cache"],
        )

    def predict(self, investor: str, firm: str, domain: str | None = None) -> list[dict]:
        return predict_one(self.spark, investor, firm, domain, **self.tables)

    def predict_batch(self, requests: DataFrame, **options) -> DataFrame:
        return predict(requests, **self.tables, **options)
