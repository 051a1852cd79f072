"""Row filters, validation rules, shared-domain flags and duplicate masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import require_columns


def drop_missing_email(df: DataFrame) -> DataFrame:
    return df.where(F.col("email").isNotNull())


def drop_invalid_local(df: DataFrame) -> DataFrame:
    return df.where(F.contains("email", F.lit("@")) & text.local_of(F.col("email")).rlike(text.LOCAL_PART))


def drop_bad_names(df: DataFrame) -> DataFrame:
    name = F.col("investor")
    return df.where(name.isNotNull() & (F.trim(name) != "") & ~F.contains(name, F.lit("?")))


def standardise(df: DataFrame) -> DataFrame:
    """Text columns cleaned, urls and telephones by their own rules, bad names dropped."""
    require_columns(df, ("linkedin", "website", "tel", "investor"))
    own = {"linkedin": text.clean_url, "website": text.clean_url, "tel": text.clean_tel}
    texts = [c for c, t in df.dtypes if t == "string"]
    return drop_bad_names(df.withColumns({c: own.get(c, text.clean_generic)(F.col(c)) for c in texts}))


def _outside(c: Column, low: int, high: int) -> Column:
    return F.coalesce(~F.length(c).between(low, high), F.lit(True))


def rules() -> dict[str, Column]:
    """rule -> whether a row breaks it."""
    return {
        "invalid_email": _outside(F.col("email"), 10, 45) | ~F.coalesce(F.col("email").rlike(text.EMAIL), F.lit(False)),
        "invalid_linkedin": ~F.coalesce(F.contains("linkedin", F.lit(text.LINKEDIN)), F.lit(False)),
        "invalid_firm": _outside(F.col("firm"), 4, 60),
        "invalid_investor": _outside(F.col("investor"), 8, 18),
        "missing_email_and_linkedin": F.col("email").isNull() & F.col("linkedin").isNull(),
    }


def invalid_ids(df: DataFrame, rule: str) -> DataFrame:
    return df.where(rules()[rule]).select("id")


def validation_report(df: DataFrame) -> DataFrame:
    """(rule, id) of all broken rules in one pass."""
    require_columns(df, ("id", "email", "linkedin", "firm", "investor"))
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules().items()]))).alias("rule")).select("rule", "id")


def _spread(df: DataFrame, key: Column, of: str, flag: str) -> DataFrame:
    """flag: whether the rows with this key have more than one value of `of`; min and max tell, without a distinct count.
    The join is one that adaptive execution may split where a key is very common."""
    keyed = df.withColumn("__key", key)
    spread = keyed.where("__key is not null").groupBy("__key").agg((F.min(of) != F.max(of)).alias(flag))
    return keyed.join(spread, "__key", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).select(*[c for c in df.columns if c != flag], flag)


def flag_shared_domain(df: DataFrame) -> DataFrame:
    """is_shared_infra: more than one firm uses the e-mail domain."""
    return _spread(df, text.domain_of(F.col("email")), "firm", "is_shared_infra")


def flag_multi_domain(df: DataFrame) -> DataFrame:
    """firm_is_multi_domain: the firm uses more than one e-mail domain."""
    d = df.withColumn("__domain", text.domain_of(F.col("email")))
    return _spread(d, F.col("firm"), "__domain", "firm_is_multi_domain").drop("__domain")


def duplicates(df: DataFrame, subset: list[str], order: list[str], keep_first: bool = True) -> DataFrame:
    """All but the first row of each key by the given order, or all rows of repeated keys."""
    if keep_first:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).where("__n > 1").drop("__n")
    repeated = df.groupBy(*subset).count().where("count > 1").drop("count")
    return df.join(repeated, subset, "left_semi")


def group_nunique(df: DataFrame, key: str, of: str) -> DataFrame:
    """The number of distinct values of `of` by key, on every row."""
    return df.join(df.groupBy(key).agg(F.countDistinct(of).alias("n_unique")), key)


def career_moves(df: DataFrame, person: str = "investor", firm: str = "firm") -> DataFrame:
    """Rows of persons with several rows, each at another firm."""
    once = df.groupBy(person).agg(F.count("*").alias("n"), F.countDistinct(firm).alias("firms")).where("n > 1 and n = firms")
    return df.join(once.select(person), person, "left_semi")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by one aggregation."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*[F.col(c) if c == key else F.col(f"first.`{c}`").alias(c) for c in df.columns])


def shared_keys(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys that both have: none if the two are disjoint."""
    return a.select(key).intersect(b.select(key))
