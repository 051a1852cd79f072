"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, PII, mixing.

Each stage is written as Parquet to the shared folder and reread as the next one's input. All but the last return the
columns of documents; the last adds mix_slot and mix_position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namewright.llm.common import drop_staged, stage_table, table
from namewright.llm.decontaminate import drop_contaminated
from namewright.llm.mixing import mix
from namewright.llm.near_copies import keep_one_of_each
from namewright.llm.pii import replace_pii
from namewright.llm.quality import keep_good, trusted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, trusted(table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return replace_pii(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("mixing sources", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = None
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(old)
        old = docs
    return docs


#: SQL can't express the classifier, the near copies' shingle sets or the surrogates; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
