"""Readers and writers over Parquet and CSV folders, in the catalogue's schemas."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..schemas import SCHEMAS, TableName, check_schema, require_columns, with_missing_columns

#: Sheet headings and the columns they become.
LP_COLUMNS = {
    "INVESTOR": "firm", "FIRM TYPE": "firm_type", "TITLE": "title", "NAME": "investor", "ALTERNATIVE NAME": "alternative_name", "ROLE": "role",
    "JOB TITLE": "job_title", "ASSET CLASS": "asset_class", "EMAIL": "email", "TEL": "tel", "CITY": "city", "STATE": "state", "COUNTRY": "country",
    "ZIP CODE": "zip_code", "LINKEDIN": "linkedin", "REGION": "region", "ADDRESS": "address", "WEBSITE": "website", "GENERAL EMAIL": "general_email",
}
GP_COLUMNS = {"FUND MANAGER" if k == "INVESTOR" else "COUNTRY/TERRITORY" if k == "COUNTRY" else k: v for k, v in LP_COLUMNS.items() if k not in ("ALTERNATIVE NAME", "ROLE")}
REPEATED_COLUMNS = ("CITY.1", "TEL.1", "STATE/COUNTY", "ZIP CODE.1")


class Store:
    """Tables of the catalogue as Parquet folders under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, table: TableName) -> str:
        return f"{self.path}/{table.value}"

    def _pointer(self, table: TableName):
        """Hadoop's file system and the file that names the folder of the table's present rows."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(table)}/_current")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self, table: TableName) -> str | None:
        fs, p = self._pointer(table)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_all(self) -> list[str]:
        """Makes every table of the catalogue that isn't there, empty; returns their names."""
        made = [t for t in TableName if self._current(t) is None]
        for t in made:
            self.replace(t, self.spark.createDataFrame([], SCHEMAS[t]))
        return [t.value for t in made]

    def read(self, table: TableName, columns: list[str] | None = None, filters: list[Column] | None = None, limit: int | None = None) -> DataFrame:
        """Newest rows first where the table has a time stamp; projection and filters reach the scan."""
        at = self._current(table)
        df = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self._at(table)}/{at}") if at else self.spark.createDataFrame([], SCHEMAS[table])
        return scan(df, columns, filters, limit)

    def replace(self, table: TableName, df: DataFrame) -> None:
        """Writes the rows to a folder of their own, then swaps the pointer to it: a reader sees the old table or the new one, and
        a crash between leaves the old one. The folder before stays until the next replacement, as df may read it."""
        df = with_missing_columns(check_schema(df, SCHEMAS[table]), SCHEMAS[table]).select(*SCHEMAS[table].names)
        old, new = self._current(table), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._at(table)}/{new}")
        fs, p = self._pointer(table)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        out = fs.create(path(f"{self._at(table)}/_next"), True)
        out.writeBytes(new)
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(path(f"{self._at(table)}/_next"), p)
        for f in fs.listStatus(path(self._at(table))):
            if f.getPath().getName().startswith("v-") and f.getPath().getName() not in (old, new):
                fs.delete(f.getPath(), True)

    def write(self, table: TableName, df: DataFrame, key: list[str], last: str = "time_stamp") -> None:
        """Rows whose key is there replace the old row, the last of several with one key (by `last`, where the table has it, then by
        the other columns); rows without a full key are added with new ids; the others are added as they are."""
        new = with_missing_columns(check_schema(df, SCHEMAS[table]), SCHEMAS[table])
        old = self.read(table)
        order = [c for c in (last, *SCHEMAS[table].names) if c in new.columns and not isinstance(SCHEMAS[table][c].dataType, ArrayType)]
        self.replace(table, upsert(old, with_ids(new, old, key), key, order))

    def count(self, table: TableName) -> int:
        return self.read(table).count()

    def check_count(self, table: TableName, expected: int, strict: bool = False) -> None:
        n = self.count(table)
        if n > expected or strict and n != expected:
            raise ValueError(f"{table.value} has {n} rows, expected {expected}")


def scan(df: DataFrame, columns: list[str] | None = None, filters: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    if filters:
        df = df.where(reduce(lambda a, b: a & b, filters))
    if "time_stamp" in df.columns and limit is not None:
        df = df.orderBy(F.desc("time_stamp"), F.desc("id"))
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """old with the rows of new, which win; of several new rows with one key the last by `order`, if given."""
    new = new.select(*old.columns)
    if order:
        rest = [c for c in old.columns if c not in key]
        won = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("won"))
        new = won.select(*[F.col(c) if c in key else F.col(f"won.`{c}`").alias(c) for c in old.columns])
    return old.join(new, key, "left_anti").unionByName(new)


def numbered_rows(df: DataFrame, order: list[str], name: str = "id", start: int = 1) -> DataFrame:
    """df with numbers from start in the given order: ranges of the order are counted, and each row is numbered within its range,
    so that no task has more than a range. Equal rows come in any order. The ranges are kept by the executors, as drawing them
    twice might give others."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    w = Window.partitionBy("__part").orderBy(*order)
    # A row a range.
    shift = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__shift", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n"))
    ranked = parts.withColumn("__rank", F.row_number().over(w)).join(F.broadcast(shift.drop("__n")), "__part")
    return ranked.withColumn(name, (F.col("__rank") + F.col("__shift") + start - 1).cast("long")).drop("__part", "__rank", "__shift")


def with_ids(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """new with ids after the largest one known for rows that have none, where the key is the id."""
    if key != ["id"]:
        return new
    largest = max(x.agg(F.max("id")).first()[0] or 0 for x in (old, new))
    keyless = new.where("id IS NULL").drop("id")
    order = [f.name for f in keyless.schema.fields if not isinstance(f.dataType, ArrayType)]
    return new.where("id IS NOT NULL").unionByName(numbered_rows(keyless, order, start=largest + 1))


def load_sheet(sheet: DataFrame, columns: dict[str, str], source_file: str) -> DataFrame:
    """A raw sheet in catalogue columns, stamped; raises if it is empty. Ids follow the order of the rows' contents."""
    if not sheet.head(1):
        raise ValueError("the sheet is empty")
    require_columns(sheet, columns)
    df = sheet.select(*[F.col(f"`{k}`").cast("string").alias(v) for k, v in columns.items()])
    return numbered_rows(df, df.columns).withColumns({"source_file": F.lit(source_file), "time_stamp": F.current_timestamp()})


def read_sheet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A sheet exported as CSV; other headings than the known ones are left out."""
    df = spark.read.csv(path, header=True, multiLine=True)
    return df.select(*[f"`{c}`" for c in df.columns if c in columns and c not in REPEATED_COLUMNS])


def read_workbook(spark: SparkSession, path: str, sheet: str, columns: dict[str, str]) -> DataFrame:
    """A sheet of a workbook, read on the driver as workbooks are bounded; raises if the file is missing or no reader for them is
    installed."""
    import os

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    import pandas as pd

    try:
        rows = pd.read_excel(path, sheet_name=sheet, dtype=str)
    except ImportError as e:
        raise RuntimeError("no reader for workbooks is installed; export the sheet as CSV and use read_sheet") from e
    return spark.createDataFrame(rows[[c for c in rows.columns if c in columns and c not in REPEATED_COLUMNS]].astype(object).where(rows.notna(), None))


def read_test_rows(spark: SparkSession, path: str) -> DataFrame:
    """(investor, firm, domain, email) from lines cut at commas, whatever their quotes; lines with other than four pieces, and the
    heading, are left out."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(parts) == 4).select(*[F.trim(parts[i]).alias(c) for i, c in enumerate(("investor", "firm", "domain", "email"))])
    return rows.where("investor <> 'investor'")


def load_clean(df: DataFrame, source: str, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A source's clean rows, and the same as rows of the combined table (source, record_id): renamed, stamped where they have no
    time; raises if id, investor, firm or email is missing."""
    df = require_columns(df.withColumnsRenamed(names or {}), ("id", "investor", "firm", "email"))
    stamp = F.coalesce(F.col("time_stamp"), F.current_timestamp()) if "time_stamp" in df.columns else F.current_timestamp()
    df = df.withColumn("time_stamp", stamp)
    return df, df.withColumns({"source": F.lit(source), "record_id": F.col("id")})


def combine_clean(lp: DataFrame, gp: DataFrame) -> DataFrame:
    """Both clean tables with source and record_id."""
    tagged = [df.withColumns({"source": F.lit(s), "record_id": F.col("id")}) for s, df in (("lp", lp), ("gp", gp))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


def write_ids(ids: DataFrame, column: str, path: str) -> None:
    ids.select(F.col(ids.columns[0]).alias(column)).write.mode("overwrite").csv(path, header=True)


def read_ids(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=f"{column} string").select(F.expr(f"try_cast({column} AS bigint)").alias(column)).dropna()


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id", inside: bool = True) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi" if inside else "left_anti")


def snapshot(store: Store, std_ids: DataFrame, complex_ids: DataFrame, path: str) -> None:
    """The serving tables: candidate templates cut by id lists, firm map, canonical firms, match cache."""
    c = store.read(TableName.CANDIDATE_TEMPLATES)
    parts = {"std_candidates": by_ids(c, std_ids, "template_id"), "complex_candidates": by_ids(c, complex_ids, "template_id")}
    parts |= {t.value: store.read(t) for t in (TableName.FIRM_TEMPLATE_MAP, TableName.CANONICAL_FIRMS, TableName.FIRM_MATCH_CACHE)}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{path}/{n}") for n in ("std_candidates", "complex_candidates", "firm_template_map", "canonical_firms", "firm_match_cache")}
    for name in ("std_candidates", "firm_template_map", "canonical_firms"):
        if not out[name].head(1):
            raise ValueError(f"the snapshot has no rows in {name}")
    return {n: df.orderBy("template_id") if n.endswith("candidates") else df for n, df in out.items()}


def canonical_from_sheet(df: DataFrame) -> DataFrame:
    """(firm, domain) of a sheet whose firm column is the first that names a firm or company, and whose domain column the first that
    names a domain or website; raises if either is missing."""
    pick = lambda *words: next((c for c in df.columns if any(w in c.lower() for w in words)), None)
    firm, domain = pick("firm", "company"), pick("domain", "website")
    if not firm or not domain:
        raise ValueError("no column names a firm or a domain")
    return bootstrap_canonical(df.select(F.col(f"`{firm}`").cast("string").alias("firm"), F.col(f"`{domain}`").cast("string").alias("domain"), F.lit(None).cast("array<string>").alias("domains")))


def bootstrap_canonical(rows: DataFrame) -> DataFrame:
    """(firm, domain) pairs from rows with firm and any of domain, domains (array); the first is taken, each pair kept once."""
    domain = F.coalesce(F.col("domain"), F.get("domains", F.lit(0)))
    return rows.select(F.trim("firm").alias("firm"), F.lower(domain).alias("domain")).dropna().dropDuplicates(["firm", "domain"])
