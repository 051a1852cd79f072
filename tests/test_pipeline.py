"""The batch pipeline from raw sheets to feature matrices, twice."""

from pyspark.sql import functions as F

from namewright.plans import contacts, pipeline
from namewright.schemas import SCHEMAS, TableName, with_missing_columns
from namewright.sources.tables import Store


def test_pipeline_runs_twice_alike(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = contacts.contacts(spark, "/root/testdata/sf0.001").withColumns({"time_stamp": F.current_timestamp(), "title": F.col("title").cast("string")})
    c = c.withColumn("firm", F.regexp_replace("firm", "_.*", "")).drop("brand_no", "first", "last", "k")
    for table, part in ((TableName.LP_RAW, 0), (TableName.GP_RAW, 1)):
        rows = with_missing_columns(c.where(F.col("id") % 2 == part), SCHEMAS[table])
        store.replace(table, rows.select(*SCHEMAS[table].names))
    settings = pipeline.Settings(std_padding=400, complex_padding=5)
    counts = []
    for _ in range(2):
        splits = pipeline.run(store, settings)
        counts.append([store.count(t) for t in TableName if t is not TableName.FIRM_MATCH_CACHE])
    assert counts[0] == counts[1] and all(counts[0][:8])
    m = store.read(TableName.FEATURE_MATRIX)
    n = store.count(TableName.CANDIDATE_TEMPLATES)
    assert m.groupBy("clean_row_id").agg(F.sum("label").alias("s"), F.count("*").alias("n")).where(f"s <> 1 or n <> {n}").count() == 0
    assert m.where("investor LIKE 'synthetic%'").count() > 0
    assert {r.split for r in splits["feature_matrix"].select("split").distinct().collect()} == {"train", "val", "test"}
