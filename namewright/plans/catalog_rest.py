"""Further registered queries: serving, resolution, loading, reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, tokens
from ..operators import features, predict, profile, quality, rank, resolve, rules, split, templates
from ..schemas import FEATURES
from ..sources import tables
from . import contacts as carrier
from .catalog import _CANONICAL_SQL, _PROFILE_SQL, _SEEDS_SQL, _profiles, query, r6, table, values, words
from .contacts import CANDIDATES_SQL, CLEAN_SQL, CONTACTS_SQL, ENCODED_SQL

_DRESSED = "CASE id % 4 WHEN 0 THEN 'Dr. ' || investor || ', PhD' WHEN 1 THEN '  MR ' || upper(investor) || ' Jr.' WHEN 2 THEN investor || '!!' ELSE '\"' || investor || '\"' END"


@query("SELECT id, investor AS cleaned FROM contacts", CONTACTS_SQL)
def clean_names(spark, sf):
    """Names with honorifics, suffixes, quotes and marks put on come back without them."""
    return carrier.contacts(spark, sf).select("id", names.clean_name(F.expr(_DRESSED)).alias("cleaned"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents")
def ascii_lower_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.ascii_lower(F.col("text")).alias("lowered"))


@query("SELECT id, '[\"' || replace(template, ' ', '\",\"') || '\"]' AS written, template AS back FROM encoded", ENCODED_SQL)
def json_lists(spark, sf):
    d = carrier.encoded(spark, sf).select("id", text.to_json_list(F.col("token_seq")).alias("written"))
    return d.withColumn("back", words(text.from_json_list(F.col("written"))))


@query("""SELECT id, lower(CASE WHEN id % 2 = 0 THEN 'Last.COM' ELSE split_part(email, '@', 2) END) AS last, nullif(regexp_extract(e, '@(.+)$', 1), '') AS every,
 nullif(regexp_extract(e, '@([a-zA-Z0-9.\\-]+)', 1), '') AS plain FROM (SELECT id, email, CASE WHEN id % 2 = 0 THEN email || '@Last.COM' ELSE email END AS e FROM contacts WHERE email IS NOT NULL)""", CONTACTS_SQL)  # fmt: skip
def domain_variants(spark, sf):
    c = carrier.contacts(spark, sf).where("email IS NOT NULL").withColumn("e", F.expr("CASE WHEN id % 2 = 0 THEN email || '@Last.COM' ELSE email END"))
    return c.select("id", text.domain_of(F.col("e"), "last").alias("last"), text.domain_by(F.col("e")).alias("every"), text.domain_by(F.col("e"), "plain").alias("plain"))


@query(f"SELECT DISTINCT last, p || last AS joined FROM contacts, (VALUES {', '.join(f'({p!r})' for p in names.TRAIN_PARTICLES)}) t(p)", CONTACTS_SQL)
def particle_surnames(spark, sf):
    return carrier.contacts(spark, sf).select("last").distinct().select("last", F.explode(names.particle_variants(F.col("last"))).alias("joined"))


# Resolution -----------------------------------------------------------------------------------------------------------


@query("SELECT replace(firm, ' ', '') AS raw_firm, domain FROM canonical", _CANONICAL_SQL)
def resolver_test_set(spark, sf):
    return resolve.resolver_test_set(resolve.canonical_firms(carrier.clean(spark, sf)))


@query(None)
def resolve_domains(spark, sf):
    """The serving resolver over its test set, with every third name in the cache under its first firm."""
    canonical = resolve.canonical_firms(carrier.clean(spark, sf))
    asked = resolve.resolver_test_set(canonical).select("raw_firm").unionByName(canonical.select(F.upper("firm").alias("raw_firm")))
    return resolve.resolve_domains(asked, canonical).withColumn("score", r6("score"))


@query("""SELECT (firm_id - 1) // 40 AS batch, 'INSERT INTO firm_domains (firm_id, firm, domain) VALUES' || chr(10) || string_agg('(' || firm_id || ', ''' || firm || ''', ''' || domain || ''')', ',' || chr(10) ORDER BY firm_id, domain) || ';' AS sql
FROM seeds GROUP BY 1""", _SEEDS_SQL)  # fmt: skip
def seed_statements(spark, sf):
    return resolve.seed_sql(resolve.seed_firm_domains(carrier.clean(spark, sf)), 40)


# Loading --------------------------------------------------------------------------------------------------------------


@query("SELECT id, 'new' || (id % 5 + 10) AS state FROM contacts WHERE id % 3 = 0 UNION ALL SELECT id, 'old' FROM contacts WHERE id % 3 <> 0 AND id % 2 = 0", CONTACTS_SQL)
def upsert_last_wins(spark, sf):
    """Each new id comes twice; the later row stays."""
    c = carrier.contacts(spark, sf).select("id")
    new = c.where("id % 3 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    new = new.select("id", F.concat(F.lit("new"), (F.col("id") % 5 + F.when(F.col("at") == 2, 10).otherwise(0)).cast("string")).alias("state"), "at")
    old = c.where("id % 2 = 0").select("id", F.lit("old").alias("state"), F.lit(0).alias("at"))
    return tables.upsert(old, new, ["id"], ["at"]).select("id", "state")


@query("SELECT row_number() OVER (ORDER BY firm, investor, role, id) + (SELECT max(id) FROM contacts) AS id, id AS was FROM contacts WHERE id % 4 = 3 UNION ALL SELECT id, id FROM contacts WHERE id % 4 <> 3", CONTACTS_SQL)
def keyless_ids(spark, sf):
    """Rows without an id get ones after the largest."""
    c = carrier.contacts(spark, sf).select(F.when(F.col("id") % 4 != 3, F.col("id")).alias("id"), "firm", "investor", "role", F.col("id").alias("was"))
    return tables.with_ids(c, carrier.contacts(spark, sf).select("id"), ["id"]).select("id", "was")


@query("SELECT row_number() OVER (ORDER BY investor, firm, id) AS number, id FROM contacts", CONTACTS_SQL)
def sheet_numbers(spark, sf):
    return tables.numbered_rows(carrier.contacts(spark, sf).select("investor", "firm", "id"), ["investor", "firm", "id"], "number").select("number", "id")


@query("SELECT id, investor AS investor, 'lp' AS source, id AS record_id, true AS stamped FROM contacts", CONTACTS_SQL)
def load_clean_rows(spark, sf):
    c = carrier.contacts(spark, sf).withColumnRenamed("investor", "NAME")
    both = tables.load_clean(c, "lp", {"NAME": "investor"})[1]
    return both.select("id", "investor", "source", "record_id", F.col("time_stamp").isNotNull().alias("stamped"))


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY firm ORDER BY title DESC, id) AS n FROM contacts) WHERE n = 1", CONTACTS_SQL)
def first_of_each_firm(spark, sf):
    c = carrier.contacts(spark, sf).withColumn("least", -F.col("title"))
    return quality.first_per_key(c, "firm", ["least", "id"]).select("id")


@query("SELECT id FROM contacts WHERE id % 2 = 0 INTERSECT SELECT id FROM contacts WHERE id % 3 = 0", CONTACTS_SQL)
def shared_ids(spark, sf):
    c = carrier.contacts(spark, sf)
    return quality.shared_keys(c.where("id % 2 = 0"), c.where("id % 3 = 0"))


# Templates and rules --------------------------------------------------------------------------------------------------


@query("SELECT template_id, template FROM candidates ORDER BY template_id", CANDIDATES_SQL)
def templates_by_id(spark, sf):
    return templates.in_id_order(carrier.candidates(spark, sf)).select("template_id", words("template").alias("template"))


@query("SELECT m.firm, string_agg(c.template, '|' ORDER BY c.template_id) AS templates FROM (SELECT DISTINCT firm, template_id FROM identified WHERE template_id IS NOT NULL) m JOIN candidates c ON m.template_id = c.template_id GROUP BY m.firm", CANDIDATES_SQL)
def firm_template_strings(spark, sf):
    return templates.firm_template_strings(carrier.firm_map(spark, sf), carrier.candidates(spark, sf)).select("firm", F.array_join("templates", "|").alias("templates"))


_VOCAB_SQL = ENCODED_SQL + """,
toks AS (SELECT id, unnest(string_split(template, ' ')) AS token, generate_subscripts(string_split(template, ' '), 1) AS pos FROM encoded),
vocab AS (SELECT token, row_number() OVER (ORDER BY first) AS token_id FROM (SELECT token, min(id * 100 + pos) AS first FROM toks GROUP BY token))"""


@query("SELECT string_agg(token_id || ' -1 ', '' ORDER BY pos) || '-2' AS value FROM toks JOIN vocab USING (token) GROUP BY id", _VOCAB_SQL)
def interchange_lines(spark, sf):
    d = carrier.encoded(spark, sf).select("id", "token_seq")
    return rules.interchange_lines(tokens.encode(d, tokens.vocabulary(d)))


@query("SELECT (SELECT token FROM vocab WHERE token_id = a) AS lhs, (SELECT token FROM vocab WHERE token_id = b) AS rhs, 5 AS support, 0.5::DOUBLE AS confidence FROM (VALUES (1, 2), (2, 3), (3, 1), (4, 2)) t(a, b)", _VOCAB_SQL)
def decoded_rules(spark, sf):
    v = tokens.vocabulary(carrier.encoded(spark, sf).select("id", "token_seq"))
    r = values(spark, ("a", "b"), [(1, 2), (2, 3), (3, 1), (4, 2)])
    r = r.select(F.array(F.col("a").cast("long")).alias("lhs"), F.array(F.col("b").cast("long")).alias("rhs"), F.lit(5).alias("support"), F.lit(0.5).alias("confidence"))
    return rules.decode_rules(r, v).select(words("lhs").alias("lhs"), words("rhs").alias("rhs"), "support", "confidence")


# Serving, ranking, reports --------------------------------------------------------------------------------------------

_USES = {"uses_middle_name": 2, "uses_multiple_firsts": 3, "uses_multiple_middles": 4, "uses_multiple_lasts": 5}
_PAIRS = (("uses_middle_name", "has_middle_name"), ("uses_multiple_firsts", "has_multiple_first_names"), ("uses_multiple_middles", "has_multiple_middle_names"), ("uses_multiple_lasts", "has_multiple_last_names"))


@query("SELECT id, " + " OR ".join(f"(id % {_USES[u]} = 1 AND {h})" for u, h in _PAIRS) + " AS clash FROM encoded", ENCODED_SQL)
def serve_clash(spark, sf):
    d = carrier.encoded(spark, sf).withColumns({u: F.col("id") % m == 1 for u, m in _USES.items()})
    return d.select("id", features.clash_serve().alias("clash"))


_SERVED = {
    "template_in_firm_templates": "(u.template_id IS NOT NULL)::DOUBLE", "firm_is_shared_infra": "e.is_shared_infra::DOUBLE", "firm_is_multi_domain": "e.firm_is_multi_domain::DOUBLE",
    "template_support_count": "c.support_count::DOUBLE", "template_coverage_pct": "c.coverage_pct", "template_in_mined_rules": "c.in_mined_rules::DOUBLE",
    "template_max_rule_confidence": "c.max_rule_confidence::DOUBLE", "template_avg_rule_confidence": "c.avg_rule_confidence::DOUBLE", "template_firm_support_count": "coalesce(u.support_count, 0)::DOUBLE",
    "template_firm_coverage_pct": "coalesce(u.coverage_pct, 0)::DOUBLE", "template_is_top_template": "coalesce(u.is_top_template, false)::DOUBLE", "firm_num_templates": "m.num_templates::DOUBLE",
    "firm_num_investors": "m.num_investors::DOUBLE", "firm_diversity_ratio": "m.diversity_ratio", "firm_is_single_template": "m.is_single_template::DOUBLE",
}


@query("SELECT e.id AS clean_row_id, c.template_id, " + ", ".join(f"round({_SERVED.get(f, '0.0::DOUBLE')}, 6) AS {f}" for f in FEATURES) + """
FROM clean e CROSS JOIN candidates c LEFT JOIN firm_map m ON e.firm = m.firm LEFT JOIN usage u ON u.firm = e.firm AND u.template_id = c.template_id""", CANDIDATES_SQL)  # fmt: skip
def serve_rows(spark, sf):
    """The feature rows that serving makes, with the flags that its name decomposition gives."""
    m = carrier.firm_map(spark, sf)
    flagged = names.add_name_flags(carrier.clean(spark, sf), profile="serve")
    out = features.feature_rows(flagged, carrier.candidates(spark, sf), m, templates.firm_template_usage(m), "serve", with_label=False)
    return out.select("clean_row_id", "template_id", *[r6(f).alias(f) for f in FEATURES])


@query("""SELECT f.id AS clean_row_id, f.template_id AS expected_id, a.template AS expected_template, f.template_id % 8 + 1 AS predicted_id, b.template AS predicted_template
FROM (SELECT id, template_id FROM identified WHERE template_id IS NOT NULL AND id % 3 = 0) f LEFT JOIN candidates a ON f.template_id = a.template_id LEFT JOIN candidates b ON f.template_id % 8 + 1 = b.template_id""", CANDIDATES_SQL)  # fmt: skip
def named_failures(spark, sf):
    f = carrier.identified(spark, sf).where("template_id IS NOT NULL AND id % 3 = 0")
    return rank.named_failures(f.select(F.col("id").alias("clean_row_id"), F.col("template_id").alias("expected_id"), (F.col("template_id") % 8 + 1).alias("predicted_id")), carrier.candidates(spark, sf))


@query("SELECT count(*) AS requests, round(avg(value), 6) AS mean_latency_ms, round(avg(coalesce((r <= 1)::INT, 0)), 6) AS acc_at_1, round(avg(coalesce((r <= 3)::INT, 0)), 6) AS recall_at_k FROM (SELECT value, CASE WHEN event_id % 6 > 0 THEN event_id % 6 END AS r FROM events)")
def run_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("value").alias("latency_ms"), F.when(F.col("event_id") % 6 > 0, F.col("event_id") % 6).alias("rank"))
    return rank.run_summary(e).select("requests", *[r6(c).alias(c) for c in ("mean_latency_ms", "acc_at_1", "recall_at_k")])


@query("SELECT event_id, round(1 - 0.1 * (event_id % 3), 6) AS score FROM events")
def decayed_scores(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 3).alias("place"))
    return rank.rank_decay(e).select("event_id", r6("score").alias("score"))


@query("SELECT id, email, title AS score, CASE WHEN id % 2 = 0 THEN k END AS verification FROM contacts WHERE email IS NOT NULL", CONTACTS_SQL)
def verified_order(spark, sf):
    c = carrier.contacts(spark, sf).where("email IS NOT NULL").withColumn("email", F.concat_ws(" ", "email", "id"))
    out = predict.by_verification(c.select("id", "email", F.col("title").alias("score")), c.where("id % 2 = 0").select("email", F.col("k").alias("verification")))
    return out.select("id", F.split("email", " ")[0].alias("email"), "score", "verification")


# Profiles, splits -----------------------------------------------------------------------------------------------------


@query("SELECT p.firm, p.template_id, round(p.weight, 6) AS weight, round(p.p_has_nickname, 6) AS p_has_nickname, m.num_investors FROM profiles p JOIN firm_map m ON p.firm = m.firm", _PROFILE_SQL)
def nested_profiles(spark, sf):
    n = profile.nested_profiles(_profiles(spark, sf), carrier.firm_map(spark, sf))
    d = n.select("firm", "num_investors", F.inline(F.arrays_zip("templates", "probabilities")))
    return d.select("firm", "templates.template_id", r6("templates.weight").alias("weight"), r6(F.element_at("probabilities.flag_probs", "has_nickname")).alias("p_has_nickname"), "num_investors")


@query("SELECT firm, sum(n)::BIGINT AS n FROM (SELECT firm, count(*) AS n FROM encoded GROUP BY firm UNION ALL SELECT firm, n FROM dealt) GROUP BY firm", _PROFILE_SQL)
def padded_firms(spark, sf):
    padded = profile.pad(carrier.encoded(spark, sf), _profiles(spark, sf), carrier.firm_map(spark, sf), 60)
    return padded.groupBy("firm").agg(F.count("*").alias("n"))


_SPLIT_SQL = """(SELECT id, CASE WHEN n = 1 THEN 'train' WHEN rn <= floor(n * 0.3 + 0.5) THEN 'test' WHEN rn <= floor(n * 0.3 + 0.5) + floor(n * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS split
FROM (SELECT id, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) AS rn FROM kept))"""


@query(f"SELECT id FROM kept WHERE id NOT IN (SELECT id FROM {_SPLIT_SQL} WHERE split <> 'train') UNION ALL SELECT 1000000 + id FROM kept WHERE id % 10 = 0", CLEAN_SQL)
def train_ids(spark, sf):
    """Everything that isn't held out trains, rows that were added to the split ones too."""
    c = carrier.clean(spark, sf)
    added = c.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"))
    return split.train_ids(c, split.stratified_split(c, text.domain_of(F.col("email"))), added)


_ANY = " OR ".join(split.COMPLEX_FLAGS)


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY ({_ANY}) ORDER BY md5('42:' || id), id) AS n FROM encoded) WHERE n <= 50", ENCODED_SQL)
def balanced_sample(spark, sf):
    return split.balanced_sample(carrier.encoded(spark, sf), 50).select("id")


@query("SELECT id, CASE WHEN x < (0.7 * 16**7)::BIGINT THEN 'train' WHEN x < (0.85 * 16**7)::BIGINT THEN 'val' ELSE 'test' END AS split FROM (SELECT id, ('0x' || substr(md5('42:' || id), 1, 7))::BIGINT AS x FROM contacts)", CONTACTS_SQL)
def share_split(spark, sf):
    return split.share_split(carrier.contacts(spark, sf))
