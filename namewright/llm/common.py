"""What the corpus operators share: the shared scratch folder, literal tables, ASCII lower-casing, table paths."""

from __future__ import annotations

import json
import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset, a folder of our own if everything runs
    in this process, as in tests; on a cluster that would be another folder on every machine, so it raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="namewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Files of a written table: so many a core, or one for so many bytes if that is more.
FILES_PER_CORE, FILE_BYTES = 4, 32 << 20


def few_files(df: DataFrame, like: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """df in no more partitions than are useful to write: `files` where the caller knows the table to be small, else by the
    size that the optimizer knows of df, or of `like`, a table at least as large. It only merges partitions, without a
    shuffle, and leaves large tables as they are, since a size that is overestimated means more files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if files is None:
        size = int(str((like if like is not None else df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = max(FILES_PER_CORE * cores, math.ceil(size / FILE_BYTES))
    return df.coalesce(files) if files < 1 << 20 else df


def stage_table(df: DataFrame, name: str, like: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder, in few_files, and reads it back: the lineage ends there, and a lost
    executor costs only the tasks it ran."""
    return stage_parts([df], name, like, files)


def stage_parts(parts: Iterable[DataFrame], name: str, like: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Stages tables of one schema, at least one, as a single table, one after the other, so that parts from the driver needn't
    be held together."""
    path = None
    for df in parts:
        path = path or f"{scratch_dir(df.sparkSession).rstrip('/')}/namewright/{name}-{uuid.uuid4().hex}"
        few_files(df, like, files).write.mode("append").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    give_back(out.sparkSession)
    return out


def give_back(spark: SparkSession) -> str | None:
    """Has the driver's JVM return the native memory that it has freed, and returns what the JVM says to it. The C library keeps
    what compilers and short-lived threads free, and a run of many staged tables has many of both. JVMs without this command are
    left as they are, and the result is None."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    # By the interface's method, as the server's class isn't open to reflection.
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return invoke.invoke(server, given)
    except Py4JJavaError:
        return None


def drop_staged(df: DataFrame | None) -> None:
    """Deletes a staged table that no later result reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def literal_table(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A few constant rows as a plan, one value whatever their number, so that the optimiser knows their size. A column's type
    follows its first value that isn't null."""
    rows = [list(r) for r in rows]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    types = [kinds[type(next((r[i] for r in rows if r[i] is not None), ""))] for i in range(len(names))]
    schema = f"array<struct<{','.join(f'{n}:{t}' for n, t in zip(names, types, strict=True))}>>"
    made = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(made), schema)))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row even where body uses it again or in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused_mark(text: Column) -> Column:
    """A string that the text doesn't hold, as it would hold a digest of itself."""
    return F.concat(F.lit("\x01"), F.md5(text), F.lit("\x01"))


def cut_text(text: Column, pattern: Column | str, mark: Column) -> Column:
    """The text's pieces, the odd ones (from 0) what the pattern finds, in one pass of the pattern. mark is a string that the
    text doesn't hold."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"), mark)), mark, -1)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z. lower() is used as its ASCII path is fast; it maps two other characters to something with an ASCII
    letter: the Kelvin sign, which is exchanged for a letter that lower() leaves alone, and the capital I with a dot, whose
    i is followed by a combining dot, so that it stays a word character among others. Other letters may change case too."""
    return F.lower(F.replace(c, F.lit("\u212a"), F.lit("\u0138")))


def frugal(f):
    """f, a function of Arrow batches or tables, that leaves no freed memory with its worker: workers serve many tasks, and
    those of later stages would be held on top of it."""
    import functools
    import inspect

    def release() -> None:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            release()

    elif len(inspect.signature(f).parameters) == 3:

        @functools.wraps(f)
        def run(key, left, right):
            out = f(key, left, right)
            release()
            return out

    else:

        @functools.wraps(f)
        def run(group):
            out = f(group)
            release()
            return out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of 8 bytes: a broadcast of at most some 32 MB as a hash table.
MAX_BROADCAST_IDS = 1_000_000


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Joins docs to a staged table of distinct ids. The ids are broadcast if they are counted to be few enough, so that
    texts needn't move; otherwise both sides are shuffled."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return few_files(docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", how).select(*[F.col(f"`{c}`") for c in docs.columns]), docs)


def drop_without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone; rows without an id stay."""
    return _by_id(docs, gone, "left_anti")


def keep_within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids."""
    return _by_id(docs, ids, "left_semi")


#: A key with more than one in so many of all rows is hot; there can't be more hot keys than that.
HOT_SHARE = 1000


def join_by_counts(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined to keyed (staged, one row a key, n: how many of rows have it; n is left out). Hot keys, HOT_SHARE at most
    whatever the data, are broadcast, so that none of them lands in one task; the others are joined by a shuffle, in which no
    key has more than one in HOT_SHARE of all rows."""
    least = (keyed.agg(F.sum(n)).first()[0] or 0) / HOT_SHARE
    hot, rest = keyed.where(F.col(n) > least).drop(n), keyed.where(F.col(n) <= least).drop(n)
    common = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return common.unionByName(others)


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): each row of docs as a struct, with a number of its own that stays the same at each reading: the id where ids
    are distinct and never null, else a count that is stored with the rows."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    ids = docs.select(F.col("doc_id").cast("long").alias("row"))
    if not ids.groupBy("row").count().where("count > 1 OR row IS NULL").limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("row"), doc)
    return stage_table(docs.select(F.monotonically_increasing_id().alias("row"), doc), "numbered", like=docs)
