"""Profiling aggregates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"))
    return row.select("n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def describe_text(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top (ties: the smallest) and its frequency, from one count by value."""
    by = value_counts(df, column)
    return by.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("top"), F.max("n").alias("freq"))


def missing_pct(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    return row.unpivot([], columns, "column_name", "missing_pct")


def indicator_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of whether columns are null, one pass for all pairs."""
    flag = {c: F.col(c).isNull().cast("double") for c in columns}
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(flag[a], flag[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def cooccurrence(df: DataFrame, flags: dict) -> DataFrame:
    """How many rows have both of two flags, in one pass."""
    pairs = [(a, b) for a in flags for b in flags]
    row = df.agg(*[F.count_if(flags[a] & flags[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "n")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "n")


def shares(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, n, total, share): a crosstab normalised by row, in long form."""
    n = value_counts(df, group, item)
    w = Window.partitionBy(group)
    return n.withColumn("total", F.sum("n").over(w)).withColumn("share", F.col("n") / F.col("total"))


def entropy(df: DataFrame, group: str, item: str, base2: bool = False) -> DataFrame:
    log = F.log2 if base2 else F.log
    return shares(df, group, item).groupBy(group).agg((-F.sum(F.col("share") * log("share"))).alias("entropy"))


def dominant(df: DataFrame, group: str, item: str) -> DataFrame:
    """The most frequent item of each group, ties to the smallest."""
    s = shares(df, group, item)
    return s.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))).where("rn = 1").drop("rn")


def population_means(df: DataFrame, split, columns: dict) -> DataFrame:
    """For each column its mean in the split and in the rest, their difference and ratio."""
    parts = []
    for name, c in columns.items():
        parts += [F.avg(F.when(split, c.cast("double"))).alias(f"{name}|inside"), F.avg(F.when(~split, c.cast("double"))).alias(f"{name}|outside")]
    row = df.agg(*parts)
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}|inside`").alias("inside"), F.col(f"`{n}|outside`").alias("outside")) for n in columns]))
    return row.select(rows).withColumn("difference", F.col("inside") - F.col("outside")).withColumn("lift", F.try_divide("inside", "outside"))
