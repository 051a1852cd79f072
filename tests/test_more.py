"""Resolution, ranking models, stores and readers, against plain Python or fixtures."""

import pytest
from pyspark.sql import functions as F

from namewright.functions import similarity
from namewright.operators import predict, rank, resolve
from namewright.plans import catalog, contacts
from namewright.schemas import SCHEMAS, TableName
from namewright.sources import tables
from namewright.sources.tables import Store

from .test_whole import ratio

DATA = "/root/testdata/sf0.001"


def test_masked_ratio_is_the_ratio(spark):
    texts = ["", "a", "blackstone", "black stone", "noblackst", "aaaa", "éàé", "x" * 62, "xy" * 31, "x" * 63, "long name " * 9]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    m = F.when(F.length("a") <= similarity.MASK_BITS, similarity.masks(F.col("a")))
    for r in df.select("a", "b", similarity.masked_ratio(F.col("a"), m, F.col("b")).alias("s")).collect():
        assert abs(r.s - ratio(r.a, r.b)) < 1e-9, (r.a, r.b)


def test_serving_resolver(spark):
    canonical = resolve.canonical_firms(contacts.clean(spark, DATA)).collect()
    firms = {r.firm: r.domain for r in canonical}
    for r in catalog.QUERIES["resolve_domains"](spark, DATA).collect():
        low = r.raw_firm.strip().lower()
        want = (100.0, low) if low in firms else min(((ratio(low, f), f) for f in firms), key=lambda x: (-x[0], x[1]))
        assert (r.firm, r.domain) == (want[1], firms[want[1]]) and abs(r.score - want[0]) < 1e-5
    names = spark.createDataFrame([("  Blackstone ",), ("bs group",), ("blakstone",), (None,)], "raw_firm string")
    known = spark.createDataFrame([("blackstone", "bs.com"), ("kkr", "kkr.com")], "firm string, domain string")
    cache = spark.createDataFrame([("BS Group", "blackstone", "bs.com", 88.0)], "raw_firm string, canonical_firm string, domain string, match_score double")
    got = {r.raw_firm.strip(): (r.firm, r.domain, round(r.score, 1)) for r in resolve.resolve_domains(names, known, cache).collect()}
    assert got == {"Blackstone": ("blackstone", "bs.com", 100.0), "bs group": ("blackstone", "bs.com", 88.0), "blakstone": ("blackstone", "bs.com", 94.7)}


def test_write_through(spark):
    known = spark.createDataFrame([("blackstone", "bs.com")], "firm string, domain string")
    names = spark.createDataFrame([("blakstone",), ("nothing like it",)], "raw_firm string")
    first = resolve.resolve(names, known)
    cache = resolve.cache_rows(first)
    assert [r.raw_firm for r in cache.collect()] == ["blakstone"]
    again = resolve.resolve(names, known.limit(0), cache)
    assert {r.raw_firm: r.domain for r in again.collect()} == {"blakstone": "bs.com", "nothing like it": None}


def test_no_query_without_sql_is_empty(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"website_similarity", "model_metrics"}):
        rows = catalog.QUERIES[name](spark, DATA).limit(5).collect()
        assert rows and all(any(v is not None for v in r) for r in rows), name


def groups(spark, n=60):
    """Groups of four rows, of which the one with the largest a + 2b is the right one; c means nothing."""
    rows = []
    for g in range(n):
        made = [((g * 7 + i * 13) % 11 / 11, (g * 5 + i * 3) % 7 / 7, (g + i) % 3 / 3) for i in range(4)]
        best = max(range(4), key=lambda i: made[i][0] + 2 * made[i][1])
        rows += [(g, i, *made[i], int(i == best)) for i in range(4)]
    return spark.createDataFrame(rows, "clean_row_id long, template_id long, a double, b double, c double, label long")


def test_pairwise_ranking_of_two_models(spark):
    m = groups(spark)
    train, val = m.where("clean_row_id % 3 <> 0"), m.where("clean_row_id % 3 = 0")
    models = rank.train_two((train, val), (val, train), ["a", "b", "c"])
    for model in models.values():
        assert rank.ranking_metrics(model.score(val)).first()["acc_at_1"] >= 0.9 and model.importances()[-1][0] == "c" and model.rounds <= 40
    runs = rank.search_parameters(train, val, lambda t, **p: rank.PairwiseScorer.fit(t, val, p["features"]), [{"features": ["c"]}, {"features": ["a", "b"]}])
    assert runs[0][0]["features"] == ["a", "b"] and runs[0][1] > runs[1][1]
    fitted = rank.ModelScorer.fit(train, ["a", "b", "c"], "logistic", maxIter=20)
    assert rank.importances(fitted)[0][0] == "b"


def test_failure_regression_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2 == 0 and i % 5 > 0, i % 2 == 0, i % 3 == 0) for i in range(300)], "failed boolean, has_x boolean, has_y boolean")
    found = dict(rank.failure_regression(rows, ["has_x", "has_y"]))
    assert found["has_x"] > 2 > abs(found["has_y"])
    scored = rank.WeightedScorer().score(groups(spark, 5).withColumns({f: F.lit(0.0) for f in rank.WeightedScorer.WEIGHTS}))
    rank.write_failures(scored, str(tmp_path / "out"), 1)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == rank.failed_groups(scored, 1).count() > 0


def test_store_swaps_and_numbers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert len(store.create_all()) == len(TableName) and store.create_all() == []
    t = TableName.FIRM_MATCH_CACHE
    row = lambda *x: spark.createDataFrame([x], SCHEMAS[t])
    store.write(t, row("a", "b", "c", 90.0), ["raw_firm"])
    before = store.read(t)
    store.write(t, row("a", "b", "d", 91.0).unionAll(row("a", "b", "e", 95.0)).unionAll(row("z", None, None, None)), ["raw_firm"])
    assert {r.raw_firm: r.domain for r in store.read(t).collect()} == {"a": "e", "z": None}
    assert before.count() == 1  # the folder before is there until the next swap
    raw = spark.createDataFrame([(7, "x", "f"), (None, "y", "f"), (None, "z", "f")], "id long, investor string, firm string")
    store.write(TableName.LP_RAW, raw, ["id"])
    assert {r.investor: r.id for r in store.read(TableName.LP_RAW).collect()} == {"x": 7, "y": 8, "z": 9}


def test_readers(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("investor,firm,domain,email\nJohn Smith,KKR,kkr.com,j.smith@kkr.com\nbroken line\nA, B ,c.com,d@c.com\n")
    assert [tuple(r) for r in tables.read_test_rows(spark, str(tmp_path / "rows.csv")).orderBy("investor").collect()] == [("A", "B", "c.com", "d@c.com"), ("John Smith", "KKR", "kkr.com", "j.smith@kkr.com")]
    with pytest.raises(FileNotFoundError):
        tables.read_workbook(spark, str(tmp_path / "none.xlsx"), "LP", tables.LP_COLUMNS)
    sheet = spark.createDataFrame([(" KKR ", "KKR.com", 1), ("KKR", "kkr.com", 2), (None, "x.com", 3)], "`Company Name` string, `Web Domain` string, n int")
    assert [tuple(r) for r in tables.canonical_from_sheet(sheet).collect()] == [("KKR", "kkr.com")]
    with pytest.raises(ValueError):
        tables.canonical_from_sheet(sheet.select("n"))
    with pytest.raises(ValueError):
        tables.load_clean(sheet, "lp")
    rows = spark.createDataFrame([(f"f{i % 3}", f"n{i}") for i in range(50)], "firm string, investor string")
    got = tables.numbered_rows(rows, ["firm", "investor"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 51)) and [(r.firm, r.investor) for r in got] == sorted((f"f{i % 3}", f"n{i}") for i in range(50))
    assert tables.numbered_rows(rows.limit(0), ["firm"]).count() == 0


def test_serving_surface(spark):
    t = {"candidates": contacts.candidates(spark, DATA), "firm_map": contacts.firm_map(spark, DATA)}
    from namewright.operators.templates import firm_template_usage

    canonical = resolve.canonical_firms(contacts.clean(spark, DATA))
    p = predict.Predictor(spark, usage=firm_template_usage(t["firm_map"]), canonical=canonical, **t)
    firm, domain = canonical.orderBy("firm").first()
    given, found = p.predict("Jane Roe", firm, domain), p.predict("Jane Roe", firm)
    assert given == found and len(given) == 3 and all(x["email"].endswith(f"@{domain}") for x in given)
    batch = spark.createDataFrame([(1, "Jane Roe", firm, None), (2, "John Doe", "unknown firm", "x.org")], "id long, investor string, firm string, domain string")
    rows = p.predict_batch(batch).collect()
    assert {r.id for r in rows} == {1, 2} and all(r.email.endswith("@x.org") for r in rows if r.id == 2)
