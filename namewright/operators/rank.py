"""Scoring, per-group ranking and ranking metrics."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    def score(self, matrix: DataFrame) -> DataFrame: ...


class WeightedScorer:
    """A transparent score: a weighted sum of features, to nine decimals."""

    WEIGHTS = {"template_firm_coverage_pct": 1.0, "template_coverage_pct": 0.5, "template_max_rule_confidence": 0.05, "template_is_top_template": 0.2, "template_name_characteristic_clash": -0.1}

    def score(self, matrix: DataFrame) -> DataFrame:
        total: Column = F.lit(0.0)
        for f, w in self.WEIGHTS.items():
            total = total + F.lit(w) * F.col(f)
        return matrix.withColumn("score", F.round(total, 9))


class ModelScorer:
    """The probability of label 1 by a pyspark.ml model over an assembled vector."""

    def __init__(self, features: list[str], model):
        self.features, self.model = features, model

    @classmethod
    def fit(cls, matrix: DataFrame, features: list[str], kind: str = "gbt", **params) -> ModelScorer:
        from pyspark.ml.classification import GBTClassifier, LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        train = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(matrix.na.fill(0.0, features).withColumn("y", F.col("label").cast("double")))
        est = GBTClassifier(labelCol="y", featuresCol="x", seed=7, **params) if kind == "gbt" else LogisticRegression(labelCol="y", featuresCol="x", **params)
        return cls(features, est.fit(train))

    def score(self, matrix: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        x = VectorAssembler(inputCols=self.features, outputCol="x", handleInvalid="keep").transform(matrix.na.fill(0.0, self.features))
        return self.model.transform(x).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def ranked(scored: DataFrame, group: str = "clean_row_id", item: str = "template_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), item)))


def top_k(scored: DataFrame, k: int, group: str = "clean_row_id", item: str = "template_id") -> DataFrame:
    return ranked(scored, group, item).where(F.col("rank") <= k)


def first_hits(scored: DataFrame, group: str = "clean_row_id", item: str = "template_id") -> DataFrame:
    """(group, hit): the rank of the first positive; null without one."""
    return ranked(scored, group, item).groupBy(group).agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("hit"))


def ranking_metrics(scored: DataFrame, k: int = 3, group: str = "clean_row_id", item: str = "template_id") -> DataFrame:
    """One row: groups, accuracy at 1, recall at k, mean reciprocal rank, NDCG at k (one positive a group)."""
    hit = F.col("hit")
    at = lambda n: F.coalesce((hit <= n).cast("double"), F.lit(0.0))
    gain = F.when(hit <= k, 1 / F.log2(hit + 1.0)).otherwise(0.0)
    return first_hits(scored, group, item).agg(
        F.count("*").alias("n_groups"), F.avg(at(1)).alias("acc_at_1"), F.avg(at(k)).alias("recall_at_k"), F.avg(F.coalesce(1.0 / hit, F.lit(0.0))).alias("mrr"), F.avg(gain).alias("ndcg_at_k")
    )


def failed_groups(scored: DataFrame, k: int = 3, group: str = "clean_row_id", item: str = "template_id") -> DataFrame:
    return first_hits(scored, group, item).where(F.coalesce(F.col("hit") > k, F.lit(True))).select(group)


def group_sizes(matrix: DataFrame, group: str = "clean_row_id") -> DataFrame:
    return matrix.groupBy(group).agg(F.count("*").alias("n"))


def ablation(matrix: DataFrame, groups: dict[str, list[str]], fit) -> dict[str, DataFrame]:
    """Metrics with each group of features left out; fit(matrix, features) gives a Scorer."""
    every = [f for g in groups.values() for f in g]
    runs = {"all": every} | {f"without {n}": [f for f in every if f not in g] for n, g in groups.items()}
    return {n: ranking_metrics(fit(matrix, fs).score(matrix)) for n, fs in runs.items()}


def rank_decay(predictions: DataFrame) -> DataFrame:
    """Scores 1 - 0.1 x place (from 0), for predictions that come ranked without a score."""
    return predictions.withColumn("score", 1 - 0.1 * F.col("place"))


def named_failures(failures: DataFrame, candidates: DataFrame) -> DataFrame:
    """failures (clean_row_id, expected_id, predicted_id) with both templates, rendered; null where an id has none."""
    named = lambda alias: candidates.select(F.col("template_id").alias(f"{alias}_id"), F.array_join("template", " ").alias(f"{alias}_template"))
    return failures.join(named("expected"), "expected_id", "left").join(named("predicted"), "predicted_id", "left").select("clean_row_id", "expected_id", "expected_template", "predicted_id", "predicted_template")


def run_summary(runs: DataFrame, k: int = 3) -> DataFrame:
    """One row of runs (latency_ms, rank of the right answer or null): requests, mean latency, accuracy at 1, recall at k."""
    within = lambda n: F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0)))
    return runs.agg(F.count("*").alias("requests"), F.avg("latency_ms").alias("mean_latency_ms"), within(1).alias("acc_at_1"), within(k).alias("recall_at_k"))


def write_failures(scored: DataFrame, path: str, k: int = 3) -> None:
    """The report of groups without a hit among the first k, as CSV."""
    failed_groups(scored, k).write.mode("overwrite").csv(path, header=True)


class PairwiseScorer:
    """A linear ranking by the pairwise logistic objective: within each group the positive should score above every other row.

    Features are scaled to unit variance; after each round of iterations the gain on the validation groups is measured, and the
    fit stops when `patience` rounds haven't raised it, keeping the best.
    """

    def __init__(self, weights: dict[str, float], rounds: int, ndcg: float):
        self.weights, self.rounds, self.ndcg = weights, rounds, ndcg

    @classmethod
    def fit(cls, train: DataFrame, val: DataFrame, features: list[str], group: str = "clean_row_id", steps: tuple[int, ...] = (2, 5, 10, 20, 40), patience: int = 2) -> PairwiseScorer:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        clean = train.na.fill(0.0, features)
        spread = clean.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
        unit = {f: spread[f] or 1.0 for f in features}
        positive = clean.where("label = 1").select(group, *[F.col(f).alias(f"p_{f}") for f in features])
        pairs = clean.where("label = 0").join(positive, group)
        # Either order of a pair, by a hash, so that both classes are there.
        sign = F.when(F.pmod(F.xxhash64(group, "template_id"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        pairs = pairs.select((sign > 0).cast("double").alias("y"), *[(sign * (F.col(f"p_{f}") - F.col(f)) / unit[f]).alias(f) for f in features])
        x = VectorAssembler(inputCols=features, outputCol="x").transform(pairs).select("x", "y")
        best, waited = None, 0
        for n in steps:
            m = LogisticRegression(featuresCol="x", labelCol="y", fitIntercept=False, maxIter=n, regParam=1e-4).fit(x)
            made = cls({f: float(w) / unit[f] for f, w in zip(features, m.coefficients)}, n, 0.0)
            made.ndcg = ranking_metrics(made.score(val)).first()["ndcg_at_k"]
            best, waited = (made, 0) if best is None or made.ndcg > best.ndcg + 1e-9 else (best, waited + 1)
            if waited >= patience:
                break
        return best

    def score(self, matrix: DataFrame) -> DataFrame:
        total: Column = F.lit(0.0)
        for f, w in self.weights.items():
            total = total + F.lit(w) * F.coalesce(F.col(f), F.lit(0.0))
        return matrix.withColumn("score", F.round(total, 9))

    def importances(self) -> list[tuple[str, float]]:
        return sorted(((f, abs(w)) for f, w in self.weights.items()), key=lambda x: (-x[1], x[0]))


def train_two(std: tuple[DataFrame, DataFrame], hard: tuple[DataFrame, DataFrame], features: list[str], fit=PairwiseScorer.fit) -> dict[str, Scorer]:
    """The models of standard and of complex names, each from (train, val)."""
    return {"standard": fit(*std, features), "complex": fit(*hard, features)}


def search_parameters(train: DataFrame, val: DataFrame, fit, grid: list[dict]) -> list[tuple[dict, float]]:
    """(parameters, NDCG on val) of every entry of the grid, the best first; fit(train, **parameters) gives a Scorer."""
    runs = [(p, ranking_metrics(fit(train, **p).score(val)).first()["ndcg_at_k"]) for p in grid]
    return sorted(runs, key=lambda x: -x[1])


def importances(scorer: ModelScorer) -> list[tuple[str, float]]:
    """Features of a fitted model by importance, or by the size of their coefficient."""
    m = scorer.model
    values = m.featureImportances if hasattr(m, "featureImportances") else m.coefficients
    return sorted(((f, abs(float(v))) for f, v in zip(scorer.features, values.toArray())), key=lambda x: (-x[1], x[0]))


def failure_regression(rows: DataFrame, flags: list[str], failed: str = "failed") -> list[tuple[str, float]]:
    """(flag, coefficient) of a logistic regression of failure on boolean columns; the intercept comes first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = rows.select(F.col(failed).cast("double").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in flags])
    m = LogisticRegression(featuresCol="x", labelCol="y").fit(VectorAssembler(inputCols=flags, outputCol="x").transform(x))
    return [("intercept", float(m.intercept)), *((f, float(c)) for f, c in zip(flags, m.coefficients))]
