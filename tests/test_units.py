"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from namewright.functions import names, similarity, text, tokens
from namewright.operators import features, predict, profile, quality, rank, resolve, rules, split, templates
from namewright.schemas import NAME_FLAGS, TableName, require_columns
from namewright.sources import tables
from namewright.streaming import events


def one(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_cleaning(spark):
    df = one(spark, "email string, tel string, linkedin string, website string, investor string, n int", [("joe.bloggs@firm.com>", "(123) 456-7890", "https://linkedin.com/in/jane-smith/?ref=abc", "https://example.com?session=123", " messy. ", 1), (None, None, None, None, "??", 2)])
    r = quality.standardise(df).collect()
    assert len(r) == 1 and tuple(r[0])[:5] == ("joe.bloggs@firm.com", "1234567890", "linkedin.com/in/jane-smith/", "example.com", "messy")
    bad = one(spark, "investor string", [(x,) for x in ("Alice Smith", "??", None, "   ", "Bob Jones", "???", "Charlie")])
    assert quality.drop_bad_names(bad).count() == 3
    mails = one(spark, "email string", [("æweig@x.io",), ("v.guyotsionnest?@x.io",), ("j-smith@x.io",), ("nothing",), (None,)])
    assert [r.email for r in quality.drop_invalid_local(mails).collect()] == ["j-smith@x.io"]


def test_validation(spark):
    df = one(spark, "id long, email string, linkedin string, firm string, investor string", [(1, "valid@mail.com", "linkedin.com/in/x", "Good Firm", "John Smith"), (2, "invalid@", None, "abc", "Al"), (3, "a@x.com", "x.com", None, None), (4, None, None, "x" * 61, "y" * 19)])
    got = {}
    for r in quality.validation_report(df).collect():
        got.setdefault(r.rule, set()).add(r.id)
    assert got == {"invalid_email": {2, 3, 4}, "invalid_linkedin": {2, 3, 4}, "invalid_firm": {2, 3, 4}, "invalid_investor": {2, 3, 4}, "missing_email_and_linkedin": {4}}


def test_domains(spark):
    df = one(spark, "id long, firm string, email string", [(1, "a", "x@shared.com"), (2, "b", "y@shared.com"), (3, "b", "z@own.com"), (4, "c", None), (5, None, "q@p@r.com")])
    assert {r.id: r.is_shared_infra for r in quality.flag_shared_domain(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r.id: r.firm_is_multi_domain for r in quality.flag_multi_domain(df).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    modes = df.where("id = 5").select(*[text.domain_of(F.col("email"), m) for m in ("first", "part", "last")]).first()
    assert tuple(modes) == ("p@r.com", "p", "r.com")


def test_names(spark):
    df = one(spark, "n string", [("müller jäger",), ("große straße",), ("kåre østergård",), ("café",), ("łukasz ½",), ("Ｆｕｌｌ",)])
    assert [r[0] for r in df.select(text.german_ascii(F.col("n"))).collect()][:3] == ["mueller jaeger", "grosse strasse", "kaare ostergaard"]
    assert [r[0] for r in df.select(text.nfkd_ascii(F.col("n"))).collect()][3:] == ["cafe", "ukasz 12", "full"]
    d = one(spark, "n string", [("Dr. Jean-Luc van der Berg PhD",), ("Ali Bin Ahmad",), ("Mary-Anne O'Neill-Jones",), ("",), (None,)])
    got = [tuple(map(list, r[0])) if r[0].first else None for r in d.select(names.decompose_train(F.col("n"))).collect()]
    assert got[:3] == [(["jean", "luc"], [], ["van", "der", "berg"]), (["ali"], [], ["bin", "ahmad"]), (["mary", "anne"], [], ["oneill", "jones"])]
    served = d.select(names.decompose_serve(F.col("n")).alias("p")).collect()
    assert served[2].p.first == ["mary", "anne"] and served[2].p.last == ["oneill-jones"]
    modes = one(spark, "n string", [("Trevor Johnson",)]).select(names.has_nickname(F.col("n")), names.has_nickname(F.col("n"), "substring")).first()
    assert tuple(modes) == (False, True)


def test_templates(spark):
    df = one(spark, "lp string, n string", [("john.m.smith", "John Michael Smith"), ("abcxyz", "John Smith"), ("john_smith", "John Smith"), ("", "John Smith"), ("jsmith", None)])
    got = df.withColumn("p", names.decompose_train(F.col("n"))).withColumn("t", tokens.tokenize_local(F.col("lp"), F.col("p")))
    rows = got.withColumn("back", tokens.render(F.col("t"), F.col("p"))).collect()
    assert rows[0].t == ["first_original_0", ".", "m_0", ".", "last_original_0"] and rows[0].back == "john.m.smith"
    assert rows[1].t is None and rows[3].t is None and rows[4].t is None and rows[2].back == "john_smith"
    missing = one(spark, "n string", [("Jane Doe",)]).select(tokens.render(F.array(F.lit("middle_original_1")), names.decompose_train(F.col("n")))).first()[0]
    assert missing is None
    sub = [(["a"], ["a", "b"], True), (["b", "a"], ["a", "b"], False), ([], ["a"], True), (["a", "c"], ["a", "b", "c"], True), (["a", "a"], ["a"], False), (["a"], [], False)]
    assert [r[0] for r in one(spark, "s array<string>, q array<string>", [x[:2] for x in sub]).select(tokens.is_subsequence(F.col("s"), F.col("q"))).collect()] == [x[2] for x in sub]
    with pytest.raises(Exception, match="no template token"):
        spark.range(1).select(tokens.parse_tokens(F.array(F.lit("odd_token")))).collect()


def test_similarity(spark):
    df = one(spark, "a string, b string", [("blacstone", "blackstone"), ("goldmann sacs", "goldman sachs"), ("sachs goldman", "goldman sachs"), ("", ""), ("a", "")])
    got = [round(r[0], 3) for r in df.select(similarity.token_sort_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [94.737, 92.308, 100.0, 100.0, 0.0]


def test_resolver(spark):
    firms = one(spark, "firm string, domain string", [("blackstone", "blackstone.com"), ("goldman sachs", "gs.com")])
    raw = one(spark, "raw_firm string", [("Blacstone",), ("GOLDMAN SACHS",), ("nobody here",), ("cached one",), (None,)])
    cache = one(spark, "raw_firm string, canonical_firm string, domain string, match_score int", [("cached one", "blackstone", "blackstone.com", 90)])
    got = {r.raw_firm: (r.firm, r.domain, round(r.score, 1) if r.score else None) for r in resolve.resolve(raw, firms, cache).collect()}
    assert got == {"Blacstone": ("blackstone", "blackstone.com", 94.7), "GOLDMAN SACHS": ("goldman sachs", "gs.com", 100.0), "nobody here": (None, None, 19.0), "cached one": ("blackstone", "blackstone.com", 90.0)}
    assert resolve.resolve(raw, firms.limit(0)).where("firm is not null").count() == 0
    contacts = one(spark, "firm string, email string", [("b", "x@b.com"), ("b", "x@a.com"), ("c", "y@c.com"), ("c", "z@c.com"), ("c", "z@d.com")])
    assert {tuple(r) for r in resolve.canonical_firms(contacts).collect()} == {("b", "a.com"), ("c", "c.com")}
    variants = [r.variant for r in resolve.noisy_variants(one(spark, "firm string", [("Goldman Sachs",)])).collect()]
    assert 6 <= len(variants) == len(set(variants)) <= 11 and "Goldman Sachs" not in variants


def test_rules_against_enumeration(spark):
    seqs = [["a", "b", "c"], ["a", "c"], ["b", "a", "c", "b"], ["c"], ["a", "b", "c"]]
    want = {}
    for s in seqs:
        found = set()
        for i in range(len(s)):
            w = s[i : i + 3]
            for j in range(1, len(w)):
                found.add((frozenset(w[:1]), frozenset(w[j : j + 1])))
            if len(w) == 3:
                found |= {(frozenset(w[:2]), frozenset(w[2:])), (frozenset(w[:1]), frozenset(w[1:]))}
        for left, right in found:
            if not left & right and all(k in s for k in left):
                want[(left, right)] = want.get((left, right), 0) + 1
    got = {(frozenset(r.lhs), frozenset(r.rhs)): (r.support, r.confidence) for r in rules.mine_rules(one(spark, "token_seq array<string>", [(s,) for s in seqs])).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[(frozenset("a"), frozenset("c"))] == (4, 1.0)


def test_firm_map_and_usage(spark):
    schema = "firm string, investor string, token_seq array<string>, template_id long, is_shared_infra boolean, firm_is_multi_domain boolean"
    rows = [("a", "i1", ["f"], 1, False, True), ("a", "i2", ["f"], 1, False, False), ("a", "i3", ["l"], 2, False, False), ("b", "i4", ["f"], 1, True, False), ("b", "i5", ["x"], None, False, False), (None, "i6", ["f"], 1, False, False)]
    m = templates.firm_template_map(one(spark, schema, rows))
    got = {r.firm: r for r in m.collect()}
    assert set(got) == {"a", "b"} and got["a"].template_ids == [1, 1, 2] and got["a"].num_templates == 2 and got["a"].num_investors == 3 and got["a"].firm_is_multi_domain
    assert got["b"].diversity_ratio == 0.5 and got["b"].is_single_template and got["b"].is_shared_infra
    use = {(r.firm, r.template_id): (r.support_count, round(r.coverage_pct, 3), r.is_top_template) for r in templates.firm_template_usage(m).collect()}
    assert use == {("a", 1): (2, 0.667, True), ("a", 2): (1, 0.333, False), ("b", 1): (1, 1.0, True)}


def test_ranking(spark):
    df = one(spark, "clean_row_id long, template_id long, score double, label long", [(1, 1, 0.9, 1), (1, 2, 0.5, 0), (2, 1, 0.9, 0), (2, 2, 0.9, 1), (3, 1, 0.1, 0), (3, 2, 0.1, 0)])
    m = rank.ranking_metrics(df, 2).first()
    assert (m.n_groups, round(m.acc_at_1, 4), round(m.recall_at_k, 4), round(m.mrr, 4), round(m.ndcg_at_k, 4)) == (3, 0.3333, 0.6667, 0.5, 0.5436)
    assert [r[0] for r in rank.failed_groups(df, 2).collect()] == [3]
    with pytest.raises(ValueError, match="labels"):
        features.assert_labels(df.where("clean_row_id = 3"))


def test_padding_and_drift(spark):
    p = one(spark, "firm string, template_id long, uses long, weight double, " + ", ".join(f"p_{f} double" for f in NAME_FLAGS), [("a", 1, 6, 0.6, *[0.75] * 7), ("a", 2, 4, 0.4, *[0.0] * 7)])
    rows = profile.synthetic_contacts(p, one(spark, "firm string, num_investors long", [("a", 10), ("b", 99)]), 20).collect()
    assert sorted(r.id for r in rows) == list(range(1_000_001, 1_000_011)) and sum(r.template_id == 1 for r in rows) == 6
    assert all(r.investor == f"synthetic_investor_a_{r.id}" for r in rows)
    many = profile.synthetic_contacts(p, one(spark, "firm string, num_investors long", [("a", 0)]), 2000).where("template_id = 1").agg(F.avg(F.col("has_middle_name").cast("double"))).first()[0]
    assert 0.7 <= many <= 0.8
    after = p.withColumn("weight", F.lit(0.5))
    s = profile.drift_summary(p, after).first()
    assert round(s.max_weight_drift, 6) == 0.1 and s.max_flag_drift == 0 and s.template_mismatches == 0
    assert profile.drift_summary(p, after.where("template_id = 1")).first().template_mismatches == 1


def test_split_properties(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("x@d"), (F.col("id") % 3).cast("string"), F.lit(".com")).alias("email")).unionAll(one(spark, "id long, email string", [(9999, "a@lone.com")]))
    cut = split.stratified_split(df, text.domain_of(F.col("email")))
    n = {r.split: r["count"] for r in cut.groupBy("split").count().collect()}
    assert n == {"test": 900, "val": 600, "train": 1501} and cut.select("id").distinct().count() == 3001
    assert cut.where("id = 9999").first().split == "train" and sorted(cut.collect()) == sorted(split.stratified_split(df, text.domain_of(F.col("email"))).collect())


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    firms = one(spark, "id long, firm string, domain string", [(1, "a", "a.com"), (2, "b", "b.com")])
    store.replace(TableName.CANONICAL_FIRMS, firms)
    store.write(TableName.CANONICAL_FIRMS, one(spark, "id long, firm string, domain string", [(2, "b", "new.com"), (3, "c", "c.com")]), ["id"])
    assert {tuple(r) for r in store.read(TableName.CANONICAL_FIRMS).collect()} == {(1, "a", "a.com"), (2, "b", "new.com"), (3, "c", "c.com")}
    assert store.read(TableName.CANONICAL_FIRMS, ["firm"], [F.col("id") > 1]).count() == 2
    store.check_count(TableName.CANONICAL_FIRMS, 3, strict=True)
    with pytest.raises(ValueError, match="unknown"):
        store.replace(TableName.CANONICAL_FIRMS, firms.withColumn("odd", F.lit(1)))
    with pytest.raises(ValueError, match="rows"):
        store.check_count(TableName.CANONICAL_FIRMS, 2)
    with pytest.raises(ValueError, match="missing"):
        require_columns(firms, ["nothing"])
    with pytest.raises(ValueError, match="empty"):
        tables.load_sheet(one(spark, "`INVESTOR` string", []), {"INVESTOR": "firm"}, "x")
    sheet = one(spark, ", ".join(f"`{c}` string" for c in tables.LP_COLUMNS), [tuple(c.lower() for c in tables.LP_COLUMNS)])
    row = tables.load_sheet(sheet, tables.LP_COLUMNS, "lp.csv").first()
    assert row.firm == "investor" and row.investor == "name" and row.source_file == "lp.csv" and row.id == 1
    tables.write_ids(spark.range(3), "train_ids", f"{tmp_path}/ids")
    assert tables.read_ids(spark, f"{tmp_path}/ids", "train_ids").count() == 3


def test_predict(spark):
    cand = one(spark, "template_id long, template array<string>, support_count long, coverage_pct double, in_mined_rules boolean, max_rule_confidence double, avg_rule_confidence double, uses_middle_name boolean, uses_multiple_firsts boolean, uses_multiple_middles boolean, uses_multiple_lasts boolean",
               [(1, ["first_original_0", ".", "last_original_0"], 9, 0.9, True, 0.5, 0.5, False, False, False, False), (2, ["first_original_0", ".", "m_0", ".", "last_original_0"], 1, 0.1, False, 0.0, 0.0, False, False, False, False)])
    m = one(spark, "firm string, template_ids array<long>, num_templates long, num_investors long, is_shared_infra boolean, firm_is_multi_domain boolean, diversity_ratio double, is_single_template boolean", [("acme", [1, 1], 1, 2, False, False, 0.5, True)])
    canonical = one(spark, "firm string, domain string", [("acme", "acme.com")])
    args = {"candidates": cand, "firm_map": m, "usage": templates.firm_template_usage(m), "canonical": canonical}
    assert [x["email"] for x in predict.predict_one(spark, "John Smith", "ACME", None, **args)] == ["john.smith@acme.com"]
    assert [x["email"] for x in predict.predict_one(spark, "John Q Smith", "acme", "z.org", **args)] == ["john.smith@z.org", "john.q.smith@z.org"]


def test_stream_counts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").drop("total").collect()) == sorted(events.windowed_counts(e).drop("total").collect())
