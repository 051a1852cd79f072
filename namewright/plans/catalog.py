"""Registered queries of the contact operators, each with its SQL over the same tables.

Queries return scalar columns; arrays are rendered as strings and doubles rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, similarity, text, tokens
from ..operators import eda, features, predict, profile, quality, rank, resolve, rules, split, templates
from ..schemas import FEATURES, NAME_FLAGS, TEMPLATE_FLAGS
from ..sources import tables
from ..streaming import events
from . import contacts as carrier
from .contacts import CANDIDATES_SQL, CLEAN_SQL, CONTACTS_SQL, ENCODED_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = f"WITH {base} {sql}" if base else sql
        return f

    return register


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def words(c: str):
    return F.array_join(c, " ")


def values(spark: SparkSession, columns: tuple[str, ...], rows) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(columns, r)]) for r in rows])))


def sql_values(rows) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


# Scans, projections, filters, validation ------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name AS investor FROM part WHERE p_size > 10 AND p_brand = 'Brand#3'")
def scan_filtered(spark, sf):
    return tables.scan(table(spark, sf, "part"), ["p_partkey", "p_name"], [F.col("p_size") > 10, F.col("p_brand") == "Brand#3"]).toDF("id", "investor")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def scan_newest(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"ts": "time_stamp", "event_id": "id"})
    return tables.scan(e, ["id", "user_id"], limit=50).withColumnRenamed("id", "event_id")


@query("SELECT count(*) AS n FROM orders")
def row_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 10 = 0)")
def ids_in_list(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey % 10 = 0").select("c_custkey")
    return tables.by_ids(table(spark, sf, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT id, email FROM contacts WHERE email IS NOT NULL", CONTACTS_SQL)
def drop_missing_email(spark, sf):
    return quality.drop_missing_email(carrier.contacts(spark, sf)).select("id", "email")


@query("SELECT id, email FROM contacts WHERE contains(email, '@') AND regexp_matches(split_part(email, '@', 1), '^[A-Za-z0-9._-]+$')", CONTACTS_SQL)
def drop_invalid_local(spark, sf):
    return quality.drop_invalid_local(carrier.contacts(spark, sf)).select("id", "email")


_ODD = "CASE WHEN id % 7 = 0 THEN '??' WHEN id % 10 = 0 THEN '   ' WHEN id % 12 = 0 THEN NULL ELSE investor END"


@query(f"SELECT id, investor FROM (SELECT id, {_ODD} AS investor FROM contacts) WHERE investor IS NOT NULL AND trim(investor) <> '' AND NOT contains(investor, '?')", CONTACTS_SQL)
def drop_bad_names(spark, sf):
    return quality.drop_bad_names(carrier.contacts(spark, sf).withColumn("investor", F.expr(_ODD))).select("id", "investor")


_RULES_SQL = {
    "invalid_email": "email IS NULL OR length(email) < 10 OR length(email) > 45 OR NOT regexp_matches(email, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}$')",
    "invalid_linkedin": "linkedin IS NULL OR NOT contains(linkedin, 'linkedin.com/in/')",
    "invalid_firm": "firm IS NULL OR length(firm) NOT BETWEEN 4 AND 60",
    "invalid_investor": "investor IS NULL OR length(investor) NOT BETWEEN 8 AND 18",
    "missing_email_and_linkedin": "email IS NULL AND linkedin IS NULL",
}
for _name, _where in _RULES_SQL.items():
    query(f"SELECT id FROM contacts WHERE {_where}", CONTACTS_SQL, f"validate_{_name}")(lambda spark, sf, r=_name: quality.invalid_ids(carrier.contacts(spark, sf), r))


@query(" UNION ALL ".join(f"SELECT '{r}' AS rule, id FROM contacts WHERE {w}" for r, w in _RULES_SQL.items()), CONTACTS_SQL)
def validation_report(spark, sf):
    return quality.validation_report(carrier.contacts(spark, sf))


@query("""SELECT email IS NULL AS no_email, general_email IS NULL AS no_general, linkedin IS NULL AS no_linkedin, count(*) AS n FROM contacts GROUP BY ALL""", CONTACTS_SQL)
def null_patterns(spark, sf):
    c = carrier.contacts(spark, sf)
    return c.groupBy(F.col("email").isNull().alias("no_email"), F.col("general_email").isNull().alias("no_general"), F.col("linkedin").isNull().alias("no_linkedin")).agg(F.count("*").alias("n"))


# Text -----------------------------------------------------------------------------------------------------------------

_GENERIC = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '[.,;:!?)}}\\]]+$', ''), '\\s{{2,}}', ' ', 'g'), '[\"''<>]', '', 'g')"
_URL = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '^https?://', ''), '[\"''<>]', '', 'g'), '(?s)[?#].*$', '')"


@query(f"SELECT conv_id, turn, {_GENERIC.format('text')} AS cleaned FROM conversations")
def clean_generic(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.clean_generic(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {_URL.format('url')} AS cleaned FROM pages")
def clean_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_url(F.col("url")).alias("cleaned"))


@query("SELECT id, regexp_replace(tel, '[^0-9]', '', 'g') AS cleaned FROM contacts", CONTACTS_SQL)
def clean_tel(spark, sf):
    return carrier.contacts(spark, sf).select("id", text.clean_tel(F.col("tel")).alias("cleaned"))


@query(
    f"SELECT id, {_GENERIC.format('investor')} AS investor, {_GENERIC.format('email')} AS email, {_URL.format('linkedin')} AS linkedin, {_URL.format('website')} AS website, "
    "regexp_replace(tel, '[^0-9]', '', 'g') AS tel FROM contacts WHERE trim(investor) <> '' AND NOT contains(investor, '?')",
    CONTACTS_SQL,
)
def standardise(spark, sf):
    return quality.standardise(carrier.contacts(spark, sf)).select("id", "investor", "email", "linkedin", "website", "tel")


@query("SELECT id, trim(regexp_extract(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\\.', ''), '^([^/]+)', 1)) AS root FROM contacts", CONTACTS_SQL)
def website_root(spark, sf):
    return carrier.contacts(spark, sf).select("id", text.website_root(F.col("website")).alias("root"))


@query("SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[\\w.-]+@[\\w.-]+\\.\\w+'), 1, 3), ' ') AS emails FROM documents WHERE contains(text, '@') AND regexp_matches(text, '[\\w.-]+@[\\w.-]+\\.\\w+')")
def email_extract(spark, sf):
    d = table(spark, sf, "documents").where(F.contains("text", F.lit("@"))).withColumn("found", text.emails_in(F.col("text")))
    return d.where("size(found) > 0").select("doc_id", words("found").alias("emails"))


@query("SELECT id, lower(nullif(regexp_extract(email, '@(.*)$', 1), '')) AS domain, split_part(email, '@', 1) AS local_part FROM contacts WHERE email IS NOT NULL", CONTACTS_SQL)
def email_parts(spark, sf):
    c = carrier.contacts(spark, sf).where("email is not null")
    return c.select("id", text.domain_of(F.col("email")).alias("domain"), text.local_of(F.col("email")).alias("local_part"))


_SPELLINGS = (("müller jäger",), ("große straße",), ("kåre østergård",), ("café",), ("größe",), ("łukasz",), ("josé núñez",), ("o'neill",), ("anna",))
_GERMAN_SQL = "w"
for _a, _b in text.GERMAN.items():
    _GERMAN_SQL = f"replace({_GERMAN_SQL}, '{_a}', '{_b}')"
_NFKD_SQL = "lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'))"


@query(f"SELECT w AS original, {_GERMAN_SQL} AS german, {_NFKD_SQL.format('w')} AS nfkd, {_NFKD_SQL.format(_GERMAN_SQL)} AS both FROM (VALUES {sql_values(_SPELLINGS)}) t(w)")
def ascii_variants(spark, sf):
    v = values(spark, ("w",), _SPELLINGS).select(text.ascii_variants(F.col("w")).alias("v"))
    return v.select(*[F.col("v")[i].alias(n) for i, n in enumerate(("original", "german", "nfkd", "both"))])


@query(f"SELECT doc_id, {_NFKD_SQL.format('text')} AS plain FROM documents")
def nfkd_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.nfkd_ascii(F.col("text")).alias("plain"))


@query("SELECT id, array_to_string(string_split(replace(firm, '_', ''), ' '), ' ') AS words FROM (SELECT id, replace(firm, '_', '-') AS f, firm FROM contacts)", CONTACTS_SQL)
def firm_words(spark, sf):
    return carrier.contacts(spark, sf).select("id", words(text.firm_words(F.replace("firm", F.lit("_"), F.lit("'")))).alias("words"))


# Shared domains, canonical firms, resolution --------------------------------------------------------------------------


@query("SELECT id, is_shared_infra FROM clean", CLEAN_SQL)
def shared_domain(spark, sf):
    return quality.flag_shared_domain(quality.drop_invalid_local(carrier.contacts(spark, sf))).select("id", "is_shared_infra")


@query("SELECT id, firm_is_multi_domain FROM clean", CLEAN_SQL)
def multi_domain(spark, sf):
    return quality.flag_multi_domain(quality.drop_invalid_local(carrier.contacts(spark, sf))).select("id", "firm_is_multi_domain")


@query("SELECT firm, domain, count(*) AS n FROM kept GROUP BY firm, domain", CLEAN_SQL)
def firm_domain_counts(spark, sf):
    return resolve.firm_domain_counts(carrier.clean(spark, sf))


_CANONICAL_SQL = CLEAN_SQL + """,
canonical AS (
  SELECT firm, domain FROM (SELECT firm, domain, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, domain) AS rn FROM kept GROUP BY firm, domain) WHERE rn = 1)"""


@query("SELECT firm, domain FROM canonical", _CANONICAL_SQL)
def canonical_firms(spark, sf):
    return resolve.canonical_firms(carrier.clean(spark, sf))


_TYPO = "CASE h % 3 WHEN 0 THEN substr(firm, 1, 3) || substr(firm, 5) WHEN 1 THEN substr(firm, 1, 4) || 'x' || substr(firm, 5) ELSE firm END"
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_LCS = """list_reduce(list_transform(string_split(a, ''), lambda c: [ord(c)]),
    lambda old, c: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]),
      lambda made, j: list_append(made, CASE WHEN ord(substr(b, j[1], 1)) = c[1] THEN old[j[1]] + 1 ELSE greatest(old[j[1] + 1], made[j[1]]) END), [0]),
    list_transform(range(0, length(b) + 1), lambda j: 0))[length(b) + 1]"""


def _typos(spark, sf):
    c = resolve.canonical_firms(carrier.clean(spark, sf))
    return c.withColumn("h", F.expr("length(firm)")).select("firm", F.expr(_TYPO).alias("raw_firm"))


@query(None)
def fuzzy_resolve(spark, sf):
    found = resolve.resolve(_typos(spark, sf), resolve.canonical_firms(carrier.clean(spark, sf)))
    return found.withColumn("score", r6("score"))


_FIRM_NAMES = (("blacstone", "blackstone"), ("goldmann sacs", "goldman sachs"), ("sachs goldman", "goldman sachs"), ("sequoia", "sequoia capital"), ("abc", "xyz"), ("kkr", "kkr"))


@query(f"SELECT a0 AS a, b0 AS b, round(200.0 * {_LCS} / (length(a) + length(b)), 6) AS score FROM (SELECT a0, b0, {_SORTED.format('a0')} AS a, {_SORTED.format('b0')} AS b FROM (VALUES {sql_values(_FIRM_NAMES)}) t(a0, b0))")
def token_sort_ratio(spark, sf):
    return values(spark, ("a", "b"), _FIRM_NAMES).withColumn("score", r6(similarity.token_sort_ratio(F.col("a"), F.col("b"))))


@query(
    f"SELECT id, score FROM parts_l JOIN (SELECT a, b, round(200.0 * {_LCS} / (length(a) + length(b)), 6) AS score FROM (SELECT DISTINCT firm AS a, site AS b FROM parts_l)) ON firm = a AND site = b",
    CONTACTS_SQL,
)
def firm_site_ratio(spark, sf):
    c = carrier.contacts(spark, sf).withColumn("site", F.regexp_extract("website", "//WWW\\.([^/]+)", 1))
    pairs = c.select("firm", "site").distinct().withColumn("score", r6(similarity.ratio(F.col("firm"), F.col("site"))))
    return c.join(pairs, ["firm", "site"]).select("id", "score")


@query(None)
def website_similarity(spark, sf):
    c = carrier.contacts(spark, sf).where("email is not null").withColumns({"domain": text.domain_of(F.col("email")), "root": text.website_root(F.col("website"))})
    pairs = c.select("domain", "root").distinct().withColumn("similarity", similarity.ratcliff_ratio("domain", "root"))
    return pairs.where("similarity < 50").orderBy("similarity", "domain", "root").limit(15)


@query(None)
def noisy_variants(spark, sf):
    return resolve.noisy_variants(resolve.canonical_firms(carrier.clean(spark, sf)))


@query(None)
def match_cache(spark, sf):
    return resolve.populate_cache(resolve.canonical_firms(carrier.clean(spark, sf)))


_SEEDS_SQL = CLEAN_SQL + ", seeds AS (SELECT dense_rank() OVER (ORDER BY firm) AS firm_id, firm, domain FROM (SELECT DISTINCT firm, domain FROM kept))"


@query("SELECT firm_id, firm, domain FROM seeds", _SEEDS_SQL)
def seed_firm_domains(spark, sf):
    return resolve.seed_firm_domains(carrier.clean(spark, sf))


@query("SELECT DISTINCT firm FROM contacts WHERE contains(lower(firm), 'nd_1') ORDER BY firm LIMIT 20", CONTACTS_SQL)
def firm_search(spark, sf):
    return resolve.search_firms(carrier.contacts(spark, sf).select("firm").distinct(), "Nd_1")


@query("SELECT domain FROM seeds WHERE firm_id = 7", _SEEDS_SQL)
def firm_domains(spark, sf):
    return resolve.domains_of_firm(resolve.seed_firm_domains(carrier.clean(spark, sf)), 7)


@query("SELECT DISTINCT firm, lower(site) AS domain FROM parts_l", CONTACTS_SQL)
def bootstrap_firms(spark, sf):
    c = carrier.contacts(spark, sf).withColumn("site", F.regexp_extract("website", "//WWW\\.([^/]+)", 1))
    rows = c.select("firm", F.when(F.col("id") % 2 == 0, F.col("site")).alias("domain"), F.array("site").alias("domains"))
    return tables.bootstrap_canonical(rows)


# Names and templates --------------------------------------------------------------------------------------------------

_NAMES = (
    ("John Michael Smith", "john", "michael", "smith"), ("Mary-Anne O'Neill-Jones", "mary anne", "", "oneill jones"), ("Ali Bin Ahmad", "ali", "", "bin ahmad"),
    ("Jean-Luc Picard", "jean luc", "", "picard"), ("Dr. Mary Anne Elizabeth O'Hara", "mary", "anne elizabeth", "ohara"), ("Madonna", "madonna", "", ""),
    ("Ludwig van der Berg", "ludwig", "", "van der berg"), ("Harry Potter Jr", "harry", "", "potter"),
)


@query(f"SELECT name, f AS first, m AS middle, l AS last FROM (VALUES {sql_values(_NAMES)}) t(name, f, m, l)")
def name_parts(spark, sf):
    v = values(spark, ("name",), [(n[0],) for n in _NAMES]).withColumn("p", names.decompose_train(F.col("name")))
    return v.select("name", *[words(f"p.{g}").alias(g) for g in ("first", "middle", "last")])


@query("SELECT id, first, '' AS middle, last FROM contacts", CONTACTS_SQL)
def name_parts_serve(spark, sf):
    c = carrier.contacts(spark, sf).select("id", names.decompose_serve(F.col("investor")).alias("p"))
    return c.select("id", *[words(f"p.{g}").alias(g) for g in ("first", "middle", "last")])


_FLAGGED = (
    ("Jürgen Große", True, True, False, False, False, False, False), ("José García", False, True, False, False, False, False, False), ("William Smith", False, False, True, False, False, False, False),
    ("Mary-Anne Lee", False, False, False, True, False, False, False), ("John A. Smith", False, False, True, False, True, False, False), ("Ann B C O'Neill-Jones", False, False, False, False, True, True, True),
)


@query(f"SELECT * FROM (VALUES {sql_values(_FLAGGED)}) t(investor, {', '.join(NAME_FLAGS)})")
def name_flags(spark, sf):
    return names.add_name_flags(values(spark, ("investor",), [(n[0],) for n in _FLAGGED]))


@query("SELECT id, local_part, domain, template FROM encoded", ENCODED_SQL)
def tokenize_local(spark, sf):
    return carrier.encoded(spark, sf).select("id", "local_part", "domain", words("token_seq").alias("template"))


_LOCALS = (
    ("john.m.smith", "John Michael Smith", "first_original_0 . m_0 . last_original_0"), ("john.oneilljones", "John O'Neill Jones", "first_original_0 . middle_original_0 last_original_0"),
    ("jms", "John Michael Smith", "f_0 m_0 l_0"), ("abcxyz", "John Smith", None), ("juergen.grosse", "Jürgen Große", "first_original_0 . last_original_0"), ("", "John Smith", None),
)


@query(f"SELECT * FROM (VALUES {sql_values(_LOCALS)}) t(local, name, template)")
def tokenize_cases(spark, sf):
    v = values(spark, ("local", "name"), [x[:2] for x in _LOCALS])
    return v.withColumn("template", words(tokens.tokenize_local(F.col("local"), names.decompose_train(F.col("name")))))


_FIRMS = (("Bain Capital", "baincap.com", "0 1_sub_3"), ("General Investments", "gi.com", "0_sub_1 1_sub_1"), ("Blackstone Group", "blackstone-group.com", "0 - 1"), ("Bridgewater Associates", "xyz123.com", None))


@query(f"SELECT * FROM (VALUES {sql_values(_FIRMS)}) t(firm, domain, template)")
def tokenize_domain(spark, sf):
    v = values(spark, ("firm", "domain"), [x[:2] for x in _FIRMS])
    return v.withColumn("template", words(tokens.tokenize_domain(F.col("firm"), F.col("domain"))))


@query("SELECT id, local_part AS rendered FROM encoded", ENCODED_SQL)
def render_roundtrip(spark, sf):
    return carrier.encoded(spark, sf).select("id", tokens.render(F.col("token_seq"), names.decompose_train(F.col("investor"))).alias("rendered"))


@query("""SELECT id, pos, CASE WHEN contains(t, '_0') THEN split_part(t, '_', 1) END AS grp, CASE WHEN contains(t, 'original') THEN 'original' ELSE '' END AS flags,
  CASE WHEN contains(t, '_0') THEN 0 END AS idx, CASE WHEN NOT contains(t, '_0') THEN t END AS sep
FROM (SELECT id, unnest(string_split(template, ' ')) AS t, generate_subscripts(string_split(template, ' '), 1) - 1 AS pos FROM encoded)""", ENCODED_SQL)  # fmt: skip
def parse_tokens(spark, sf):
    d = carrier.encoded(spark, sf).select("id", F.posexplode(tokens.parse_tokens(F.col("token_seq"))).alias("pos", "t"))
    return d.select("id", F.col("pos").cast("long").alias("pos"), "t.grp", words("t.flags").alias("flags"), F.col("t.idx").alias("idx"), "t.sep")


@query("SELECT token, row_number() OVER (ORDER BY first) AS token_id FROM (SELECT t AS token, min(id * 100 + pos) AS first FROM (SELECT id, unnest(string_split(template, ' ')) AS t, generate_subscripts(string_split(template, ' '), 1) AS pos FROM encoded) GROUP BY t)", ENCODED_SQL)
def vocabulary(spark, sf):
    return tokens.vocabulary(carrier.encoded(spark, sf))


@query("SELECT id, template FROM encoded", ENCODED_SQL)
def encode_decode(spark, sf):
    d = carrier.encoded(spark, sf).select("id", "token_seq")
    v = tokens.vocabulary(d)
    return tokens.decode(tokens.encode(d, v), v).select("id", words("token_seq").alias("template"))


@query("SELECT template, support_count, round(coverage_pct, 6) AS coverage_pct FROM counts", CANDIDATES_SQL)
def template_counts(spark, sf):
    return templates.template_counts(carrier.encoded(spark, sf)).select(words("template").alias("template"), "support_count", r6("coverage_pct").alias("coverage_pct"))


_SEQS = ((("f_0", "last_original_0"), False, False, False, False), (("first_original_0", "first_original_1"), False, True, False, False), (("middle_original_0", ".", "m_1"), True, False, True, False), (("f_0", "l_1"), False, False, False, True), (("m_0",), False, False, False, False))


@query(f"SELECT * FROM (VALUES {sql_values([(' '.join(s[0]), *s[1:]) for s in _SEQS])}) t(template, {', '.join(TEMPLATE_FLAGS)})")
def template_structure(spark, sf):
    v = values(spark, ("template",), [(" ".join(s[0]),) for s in _SEQS])
    return v.select("template", *[c.alias(n) for n, c in tokens.structure_flags(F.split("template", " ")).items()])


@query("SELECT template_id, template, support_count, round(coverage_pct, 6) AS coverage_pct, in_mined_rules, round(max_rule_confidence, 6) AS max_rule_confidence, round(avg_rule_confidence, 6) AS avg_rule_confidence FROM candidates", CANDIDATES_SQL)
def candidate_templates(spark, sf):
    c = carrier.candidates(spark, sf)
    return c.select("template_id", words("template").alias("template"), "support_count", *[r6(x).alias(x) for x in ("coverage_pct",)], "in_mined_rules", *[r6(x).alias(x) for x in ("max_rule_confidence", "avg_rule_confidence")])


@query("SELECT firm, array_to_string(template_ids, ' ') AS template_ids, num_templates, num_investors, round(diversity_ratio, 6) AS diversity_ratio, is_single_template, is_shared_infra, firm_is_multi_domain FROM firm_map", CANDIDATES_SQL)
def firm_template_map(spark, sf):
    m = carrier.firm_map(spark, sf)
    ids = F.array_join(F.transform("template_ids", lambda x: x.cast("string")), " ")
    return m.select("firm", ids.alias("template_ids"), "num_templates", "num_investors", r6("diversity_ratio").alias("diversity_ratio"), "is_single_template", "is_shared_infra", "firm_is_multi_domain")


@query("SELECT firm, template_id, support_count, round(coverage_pct, 6) AS coverage_pct, is_top_template FROM usage", CANDIDATES_SQL)
def firm_template_usage(spark, sf):
    u = templates.firm_template_usage(carrier.firm_map(spark, sf))
    return u.withColumn("coverage_pct", r6("coverage_pct"))


# Rules ----------------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id),
p AS (SELECT user_id, seq, unnest(range(1, len(seq) + 1)) AS i FROM s),
tri AS (SELECT user_id, seq[i] AS a, seq[i + 1] AS b, seq[i + 2] AS c FROM p),
r AS (
  SELECT user_id, [a] AS lhs, [b] AS rhs FROM tri WHERE b IS NOT NULL AND a <> b
  UNION SELECT user_id, [a], [c] FROM tri WHERE c IS NOT NULL AND a <> c
  UNION SELECT user_id, list_sort([a, b]), [c] FROM tri WHERE c IS NOT NULL AND a <> b AND a <> c AND b <> c
  UNION SELECT user_id, [a], list_sort([b, c]) FROM tri WHERE c IS NOT NULL AND a <> b AND a <> c AND b <> c),
sup AS (SELECT lhs, rhs, count(*) AS support FROM r GROUP BY lhs, rhs HAVING count(*) >= ceil(0.6 * (SELECT count(*) FROM s)))
SELECT array_to_string(lhs, ' ') AS lhs, array_to_string(rhs, ' ') AS rhs, support, round(support / (SELECT count(*) FROM s WHERE list_has_all(s.seq, sup.lhs)), 6) AS confidence
FROM sup WHERE support / (SELECT count(*) FROM s WHERE list_has_all(s.seq, sup.lhs)) >= 0.7""")  # fmt: skip
def sequence_rules(spark, sf):
    e = table(spark, sf, "events")
    # One user's events.
    s = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("token_seq"))
    found = rules.mine_rules(s, 0.6, 0.7, 3)
    return found.select(words("lhs").alias("lhs"), words("rhs").alias("rhs"), "support", r6("confidence").alias("confidence"))


@query(None)
def template_rules(spark, sf):
    found = rules.mine_rules(carrier.encoded(spark, sf))
    return found.select(words("lhs").alias("lhs"), words("rhs").alias("rhs"), "support", r6("confidence").alias("confidence"))


_RULE_LINES = (("1,3 ==> 2 #SUP: 50 #CONF: 0.6",), ("4 ==> 5,6 #SUP: 7 #CONF: 1.0",), ("no rule",), ("1 ==> #SUP: 3 #CONF: 0.1",))


@query("SELECT * FROM (VALUES ('1 3', '2', 50, 0.6::DOUBLE), ('4', '5 6', 7, 1.0::DOUBLE)) t(lhs, rhs, support, confidence)")
def parse_rule_lines(spark, sf):
    found = rules.parse_rules(values(spark, ("value",), _RULE_LINES))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return found.select(ids("lhs"), ids("rhs"), "support", "confidence")


@query("SELECT c.template, r.lhs || ' ' || r.rhs AS rule FROM counts c JOIN rules r ON list_position(string_split(c.template, ' '), r.lhs) < list_position(string_split(c.template, ' '), r.rhs)", CANDIDATES_SQL)
def rules_in_templates(spark, sf):
    t = templates.template_counts(carrier.encoded(spark, sf))
    return templates.matching_rules(t, carrier.rules(spark)).select(words("template").alias("template"), words("both").alias("rule"))


# Features, ranking, prediction ----------------------------------------------------------------------------------------


def _matrix(spark, sf):
    d = carrier.encoded(spark, sf)
    known = templates.with_template_id(d, carrier.candidates(spark, sf)).where("template_id is not null")
    m = carrier.firm_map(spark, sf)
    return features.feature_rows(known.select(*features.CONTACT_COLUMNS, "token_seq"), carrier.candidates(spark, sf), m, templates.firm_template_usage(m))


_CLASH = """(has_middle_name AND list_bool_or([starts_with(t, 'm_') OR contains(t, 'middle') FOR t IN toks]))
 OR (has_multiple_last_names AND list_bool_or([starts_with(t, 'l_') OR contains(t, 'last') FOR t IN toks]))
 OR (has_multiple_first_names AND list_bool_or([starts_with(t, 'f_') OR contains(t, 'first_original_1') FOR t IN toks]))"""
_MATRIX_SQL = CANDIDATES_SQL + f""",
matrix AS (
  SELECT e.id AS clean_row_id, e.investor, e.firm, c.template_id, (u.template_id IS NOT NULL)::DOUBLE AS template_in_firm_templates,
    e.is_shared_infra::DOUBLE AS firm_is_shared_infra, e.firm_is_multi_domain::DOUBLE AS firm_is_multi_domain, {", ".join(f"e.{f}::DOUBLE AS investor_{f}" for f in NAME_FLAGS)},
    c.support_count::DOUBLE AS template_support_count, c.coverage_pct AS template_coverage_pct, c.in_mined_rules::DOUBLE AS template_in_mined_rules,
    c.max_rule_confidence::DOUBLE AS template_max_rule_confidence, c.avg_rule_confidence::DOUBLE AS template_avg_rule_confidence, {", ".join(f"0.0::DOUBLE AS template_{f}" for f in TEMPLATE_FLAGS)},
    coalesce(u.support_count, 0)::DOUBLE AS template_firm_support_count, coalesce(u.coverage_pct, 0)::DOUBLE AS template_firm_coverage_pct, coalesce(u.is_top_template, false)::DOUBLE AS template_is_top_template,
    ({_CLASH})::DOUBLE AS template_name_characteristic_clash, m.num_templates::DOUBLE AS firm_num_templates, m.num_investors::DOUBLE AS firm_num_investors, m.diversity_ratio AS firm_diversity_ratio,
    m.is_single_template::DOUBLE AS firm_is_single_template, (c.template = e.template)::BIGINT AS label
  FROM (SELECT * FROM identified WHERE template_id IS NOT NULL) e CROSS JOIN (SELECT *, string_split(template, ' ') AS toks FROM candidates) c
  LEFT JOIN firm_map m ON e.firm = m.firm LEFT JOIN usage u ON u.firm = e.firm AND u.template_id = c.template_id),
scored AS (
  SELECT *, round(1.0 * template_firm_coverage_pct + 0.5 * template_coverage_pct + 0.05 * template_max_rule_confidence + 0.2 * template_is_top_template - 0.1 * template_name_characteristic_clash, 9) AS score FROM matrix),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clean_row_id ORDER BY score DESC, template_id) AS rank FROM scored),
hits AS (SELECT clean_row_id, min(CASE WHEN label = 1 THEN rank END) AS hit FROM ranked GROUP BY clean_row_id)"""
_MATRIX_SQL = _MATRIX_SQL.replace("list_bool_or", "list_any_true")
for _t, _old in (("middle", "[starts_with(t, 'm_') OR contains(t, 'middle') FOR t IN toks]"), ("last", "[starts_with(t, 'l_') OR contains(t, 'last') FOR t IN toks]"), ("first", "[starts_with(t, 'f_') OR contains(t, 'first_original_1') FOR t IN toks]")):
    _MATRIX_SQL = _MATRIX_SQL.replace(f"list_any_true({_old})", f"list_contains({_old}, true)")


@query("SELECT clean_row_id, investor, firm, template_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + ", label FROM matrix", _MATRIX_SQL)
def feature_matrix(spark, sf):
    return _matrix(spark, sf).select("clean_row_id", "investor", "firm", "template_id", *[r6(f).alias(f) for f in FEATURES], "label")


@query("SELECT clean_row_id, sum(label)::BIGINT AS labels, sum(label) = 1 AS ok FROM matrix GROUP BY clean_row_id", _MATRIX_SQL)
def label_check(spark, sf):
    return features.check_labels(_matrix(spark, sf))


@query("SELECT clean_row_id, template_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3", _MATRIX_SQL)
def rank_topk(spark, sf):
    return rank.top_k(rank.WeightedScorer().score(_matrix(spark, sf)), 3).select("clean_row_id", "template_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT count(*) AS n_groups, round(avg(coalesce((hit <= 1)::INT, 0)), 6) AS acc_at_1, round(avg(coalesce((hit <= 3)::INT, 0)), 6) AS recall_at_k, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr,
  round(avg(CASE WHEN hit <= 3 THEN 1 / log2(hit + 1) ELSE 0 END), 6) AS ndcg_at_k FROM hits""", _MATRIX_SQL)  # fmt: skip
def ranking_metrics(spark, sf):
    m = rank.ranking_metrics(rank.WeightedScorer().score(_matrix(spark, sf)))
    return m.select("n_groups", *[r6(c).alias(c) for c in ("acc_at_1", "recall_at_k", "mrr", "ndcg_at_k")])


@query("SELECT clean_row_id FROM hits WHERE hit IS NULL OR hit > 1", _MATRIX_SQL)
def failed_groups(spark, sf):
    return rank.failed_groups(rank.WeightedScorer().score(_matrix(spark, sf)), 1)


@query("SELECT clean_row_id, count(*) AS n FROM matrix GROUP BY clean_row_id", _MATRIX_SQL)
def group_sizes(spark, sf):
    return rank.group_sizes(_matrix(spark, sf))


_LOCAL_SQL = "CASE c.template WHEN 'f_0 last_original_0' THEN substr(first, 1, 1) || last WHEN 'first_original_0' THEN first WHEN 'f_0 . last_original_0' THEN substr(first, 1, 1) || '.' || last WHEN 'first_original_0 _ last_original_0' THEN first || '_' || last WHEN 'last_original_0 . f_0' THEN last || '.' || substr(first, 1, 1) ELSE first || '.' || last END"


@query(f"""SELECT id, rank, email, round(score, 6) AS score, template_id FROM (
  SELECT e.id, e.domain, c.template_id, {_LOCAL_SQL} || '@' || e.domain AS email, s.score, row_number() OVER (PARTITION BY e.id ORDER BY s.score DESC, c.template_id) AS rank
  FROM clean e CROSS JOIN candidates c LEFT JOIN usage u ON u.firm = e.firm AND u.template_id = c.template_id,
  LATERAL (SELECT round(coalesce(u.coverage_pct, 0) + 0.5 * c.coverage_pct + 0.05 * c.max_rule_confidence + 0.2 * coalesce(u.is_top_template, false)::INT, 9) AS score) s)
WHERE rank <= 3""", CANDIDATES_SQL)  # fmt: skip
def predict_topk(spark, sf):
    m = carrier.firm_map(spark, sf)
    requests = carrier.clean(spark, sf).select("id", "investor", "firm", text.domain_of(F.col("email")).alias("domain"))
    out = predict.predict(requests, carrier.candidates(spark, sf), m, templates.firm_template_usage(m))
    return out.select("id", "rank", "email", r6("score").alias("score"), "template_id")


@query(None)
def model_metrics(spark, sf):
    m = _matrix(spark, sf)
    cols = ["template_firm_coverage_pct", "template_coverage_pct", "template_is_top_template", "template_max_rule_confidence", "template_name_characteristic_clash", "firm_diversity_ratio"]
    fitted = rank.ModelScorer.fit(m.where("clean_row_id % 10 < 6"), cols, "logistic", maxIter=20)
    return rank.ranking_metrics(fitted.score(m.where("clean_row_id % 10 >= 6")))


# Profiles, padding, splits --------------------------------------------------------------------------------------------

_PROFILE_SQL = CANDIDATES_SQL + f""",
profile_uses AS (SELECT firm, template_id, count(*) AS uses, {", ".join(f"avg({f}::INT) AS p_{f}" for f in NAME_FLAGS)} FROM identified WHERE template_id IS NOT NULL GROUP BY firm, template_id),
profiles AS (SELECT *, uses / sum(uses) OVER (PARTITION BY firm) AS weight FROM profile_uses),
totals AS (SELECT firm, 60 - num_investors AS total FROM firm_map WHERE num_investors < 60),
floors AS (SELECT p.firm, template_id, total, round(weight * total, 9) AS exact, floor(round(weight * total, 9)) AS base FROM profiles p JOIN totals t ON p.firm = t.firm),
dealt AS (
  SELECT firm, template_id, (base + CASE WHEN row_number() OVER (PARTITION BY firm ORDER BY exact - base DESC, template_id) <= total - sum(base) OVER (PARTITION BY firm) THEN 1 ELSE 0 END)::BIGINT AS n FROM floors)"""


def _profiles(spark, sf):
    return profile.firm_profile(carrier.identified(spark, sf), carrier.firm_map(spark, sf))


@query("SELECT firm, template_id, uses, round(weight, 6) AS weight, " + ", ".join(f"round(p_{f}, 6) AS p_{f}" for f in NAME_FLAGS) + " FROM profiles", _PROFILE_SQL)
def firm_profile(spark, sf):
    return _profiles(spark, sf).select("firm", "template_id", "uses", *[r6(c).alias(c) for c in ("weight", *[f"p_{f}" for f in NAME_FLAGS])])


_HALF = [f"avg({f}::INT) AS p_{f}" for f in NAME_FLAGS]
_DRIFT_SQL = CANDIDATES_SQL + "".join(
    f""",
{s}_uses AS (SELECT firm, template_id, count(*) AS uses, {", ".join(_HALF)} FROM identified WHERE template_id IS NOT NULL AND id % 2 = {k} GROUP BY firm, template_id),
{s} AS (SELECT *, uses / sum(uses) OVER (PARTITION BY firm) AS weight FROM {s}_uses)"""
    for k, s in enumerate(("b", "a"))
)


@query("SELECT firm, round(max(abs(coalesce(b.weight, 0) - coalesce(a.weight, 0))), 6) AS weight_drift, round(max(CASE WHEN a.uses IS NOT NULL AND b.uses IS NOT NULL THEN greatest(" + ", ".join(f"abs(b.p_{f} - a.p_{f})" for f in NAME_FLAGS) + ") END), 6) AS flag_drift, count(*) FILTER (a.uses IS NULL OR b.uses IS NULL) AS mismatched FROM b FULL JOIN a USING (firm, template_id) GROUP BY firm", _DRIFT_SQL)
def profile_drift(spark, sf):
    d = carrier.identified(spark, sf)
    halves = []
    for k in (0, 1):
        half = d.where(F.col("id") % 2 == k)
        halves.append(profile.firm_profile(half, templates.firm_template_map(half).withColumn("template_ids", F.array_compact("template_ids"))))
    return profile.drift(*halves).select("firm", r6("weight_drift").alias("weight_drift"), r6("flag_drift").alias("flag_drift"), "mismatched")


@query("SELECT firm, template_id, n FROM dealt", _PROFILE_SQL)
def padding_counts(spark, sf):
    totals = carrier.firm_map(spark, sf).where("num_investors < 60").select("firm", (60 - F.col("num_investors")).alias("total"))
    return profile.apportion(_profiles(spark, sf), totals)


@query("SELECT 1000000 + row_number() OVER (ORDER BY firm, template_id, k) AS id, firm, template_id FROM (SELECT firm, template_id, unnest(range(1, n + 1)) AS k FROM dealt WHERE n > 0)", _PROFILE_SQL)
def synthetic_ids(spark, sf):
    return profile.synthetic_contacts(_profiles(spark, sf), carrier.firm_map(spark, sf), 60).select("id", "firm", "template_id")


@query(None)
def synthetic_contacts(spark, sf):
    return profile.synthetic_contacts(_profiles(spark, sf), carrier.firm_map(spark, sf), 60)


@query("""SELECT id, CASE WHEN n = 1 THEN 'train' WHEN rn <= floor(n * 0.3 + 0.5) THEN 'test' WHEN rn <= floor(n * 0.3 + 0.5) + floor(n * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS split
FROM (SELECT id, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42:' || id), id) AS rn FROM kept)""", CLEAN_SQL)  # fmt: skip
def stratified_split(spark, sf):
    return split.stratified_split(carrier.clean(spark, sf), text.domain_of(F.col("email")))


_ANY = " OR ".join(split.COMPLEX_FLAGS)


@query(f"SELECT id, ({_ANY}) AS is_complex FROM encoded", ENCODED_SQL)
def complexity_split(spark, sf):
    std, hard = split.complexity_split(carrier.encoded(spark, sf))
    return std.select("id", F.lit(False).alias("is_complex")).unionByName(hard.select("id", F.lit(True).alias("is_complex")))


@query("SELECT firm, num_investors FROM firm_map WHERE num_investors < 12", CANDIDATES_SQL)
def low_investor_firms(spark, sf):
    return split.low_investor_firms(carrier.firm_map(spark, sf), 12)


@query("SELECT firm, n FROM (SELECT firm, n, sum(n) OVER (ORDER BY md5('42:' || firm), firm) - n AS before FROM (SELECT firm, count(*) AS n FROM contacts GROUP BY firm)) WHERE before < 500", CONTACTS_SQL)
def firm_holdout(spark, sf):
    return split.firm_holdout(carrier.contacts(spark, sf), 500)


@query("SELECT id FROM contacts ORDER BY md5('42:' || id), id LIMIT 100", CONTACTS_SQL)
def sample_rows(spark, sf):
    return split.sample_rows(carrier.contacts(spark, sf).select("id"), 100)


@query("SELECT id FROM contacts WHERE ('0x' || substr(md5('42:' || id), 1, 7))::BIGINT < (0.25 * 16**7)::BIGINT", CONTACTS_SQL)
def sample_share(spark, sf):
    return split.sample_share(carrier.contacts(spark, sf), 0.25).select("id")


@query("""SELECT id, copy, f.firm FROM (SELECT id, unnest([1, 2]) AS copy FROM contacts) c,
 (SELECT firm, row_number() OVER (ORDER BY firm) - 1 AS number, count(*) OVER () AS k FROM (SELECT DISTINCT firm FROM contacts)) f
WHERE ('0x' || substr(md5('42:' || id || ':' || copy), 1, 7))::BIGINT % f.k = f.number""", CONTACTS_SQL)  # fmt: skip
def placebo_rows(spark, sf):
    c = carrier.contacts(spark, sf)
    firms = resolve.seed_firm_domains(c.withColumn("email", F.concat(F.lit("a@"), "firm"))).select("firm", (F.col("firm_id") - 1).alias("number"))
    return split.bootstrap(c.select("id", "firm"), 2, firms).select("id", "copy", "firm")


# Profiling ------------------------------------------------------------------------------------------------------------


@query("SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS max FROM lineitem")
def describe_numeric(spark, sf):
    d = eda.describe_numeric(table(spark, sf, "lineitem"), "l_extendedprice")
    return d.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT sum(n)::BIGINT AS n, count(*) AS n_unique, first(p_type ORDER BY n DESC, p_type) AS top, max(n) AS freq FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def describe_text(spark, sf):
    return eda.describe_text(table(spark, sf, "part"), "p_type")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")
def value_counts(spark, sf):
    return eda.top_values(table(spark, sf, "part"), "p_type", 5)


_NULLABLE = ["email", "linkedin", "general_email"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INT) * 100, 6) AS missing_pct FROM contacts" for c in _NULLABLE), CONTACTS_SQL)
def missing_pct(spark, sf):
    return eda.missing_pct(carrier.contacts(spark, sf), _NULLABLE).withColumn("missing_pct", r6("missing_pct"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 6) AS corr FROM contacts" for a, b in (("email", "linkedin"), ("email", "general_email"), ("linkedin", "general_email"))), CONTACTS_SQL)
def missing_correlation(spark, sf):
    return eda.indicator_correlation(carrier.contacts(spark, sf), _NULLABLE).withColumn("corr", r6("corr"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} AND {b}) AS n FROM encoded" for a in NAME_FLAGS for b in NAME_FLAGS), ENCODED_SQL)
def flag_cooccurrence(spark, sf):
    return eda.cooccurrence(carrier.encoded(spark, sf), {f: F.col(f) for f in NAME_FLAGS})


@query(" UNION ALL ".join(f"SELECT '{f}' AS name, round(avg({f}::INT) FILTER (k = 2), 6) AS inside, round(avg({f}::INT) FILTER (k <> 2), 6) AS outside, round(avg({f}::INT) FILTER (k = 2) - avg({f}::INT) FILTER (k <> 2), 6) AS difference, round(avg({f}::INT) FILTER (k = 2) / avg({f}::INT) FILTER (k <> 2), 6) AS lift FROM encoded" for f in NAME_FLAGS), ENCODED_SQL)
def population_lift(spark, sf):
    d = eda.population_means(carrier.encoded(spark, sf), F.col("k") == 2, {f: F.col(f) for f in NAME_FLAGS})
    return d.select("name", *[r6(c).alias(c) for c in ("inside", "outside", "difference", "lift")])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, (sum(count(*)) OVER (PARTITION BY l_returnflag))::BIGINT AS total, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY l_returnflag, l_linestatus")
def crosstab_share(spark, sf):
    return eda.shares(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("share", r6("share"))


for _n, _f, _b2 in (("group_entropy", "ln", False), ("group_entropy_base2", "log2", True)):
    query(f"SELECT user_id, round(-sum(p * {_f}(p)), 6) AS entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id", None, _n)(
        lambda spark, sf, b2=_b2: eda.entropy(table(spark, sf, "events"), "user_id", "event_type", b2).withColumn("entropy", r6("entropy"))
    )


@query("SELECT user_id FROM (SELECT user_id, e, quantile_cont(e, 0.9) OVER () AS q FROM (SELECT user_id, round(-sum(p * log2(p)), 6) AS e FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id)) WHERE e > q")
def high_entropy_users(spark, sf):
    e = eda.entropy(table(spark, sf, "events"), "user_id", "event_type", True).withColumn("entropy", r6("entropy"))
    q = e.agg(F.percentile("entropy", F.lit(0.9)).alias("q"))
    return e.join(F.broadcast(q), F.col("entropy") > F.col("q")).select("user_id")


@query("SELECT firm, template, n, total, round(n / total, 6) AS share FROM (SELECT firm, template, count(*) AS n, (sum(count(*)) OVER (PARTITION BY firm))::BIGINT AS total, row_number() OVER (PARTITION BY firm ORDER BY count(*) DESC, template) AS rn FROM encoded GROUP BY firm, template) WHERE rn = 1", ENCODED_SQL)
def dominant_template(spark, sf):
    return eda.dominant(carrier.encoded(spark, sf).withColumn("template", words("token_seq")), "firm", "template").withColumn("share", r6("share"))


@query("SELECT firm, count(DISTINCT template) AS n FROM encoded GROUP BY firm", ENCODED_SQL)
def templates_per_firm(spark, sf):
    return carrier.encoded(spark, sf).groupBy("firm").agg(F.countDistinct("token_seq").alias("n"))


@query("SELECT firm, count(*) FILTER (email IS NULL) AS missing, count(email) AS present, count(*) AS total, round(100.0 * count(*) FILTER (email IS NULL) / count(*), 6) AS missing_pct FROM contacts GROUP BY firm HAVING count(*) >= 5 AND count(*) FILTER (email IS NULL) > 0 AND 100.0 * count(*) FILTER (email IS NULL) / count(*) <= 40", CONTACTS_SQL)
def imputation_eligible(spark, sf):
    c = carrier.contacts(spark, sf).groupBy("firm").agg(F.count_if(F.col("email").isNull()).alias("missing"), F.count("email").alias("present"), F.count("*").alias("total"))
    return c.withColumn("missing_pct", r6(100.0 * F.col("missing") / F.col("total"))).where("total >= 5 AND missing > 0 AND missing_pct <= 40")


@query("""SELECT m.firm, c.template FROM (SELECT firm, min(template_id) AS template_id FROM identified WHERE firm IN
 (SELECT firm FROM contacts GROUP BY firm HAVING count(*) >= 5 AND count(*) FILTER (email IS NULL) > 0 AND 100.0 * count(*) FILTER (email IS NULL) / count(*) <= 40) GROUP BY firm HAVING count(DISTINCT template_id) = 1) m JOIN candidates c ON m.template_id = c.template_id""", CANDIDATES_SQL)  # fmt: skip
def imputation_templates(spark, sf):
    single = carrier.firm_map(spark, sf).where("is_single_template").join(imputation_eligible(spark, sf), "firm", "left_semi")
    return single.select("firm", F.col("template_ids")[0].alias("template_id")).join(carrier.candidates(spark, sf), "template_id").select("firm", words("template").alias("template"))


@query("SELECT has_nickname AS flag, round(avg(is_shared_infra::INT) * 100, 6) AS shared_pct, round(avg(firm_is_multi_domain::INT) * 100, 6) AS multi_pct, count(*) AS n FROM encoded GROUP BY has_nickname", ENCODED_SQL)
def flag_breakdown(spark, sf):
    pct = lambda c: r6(F.avg(F.col(c).cast("double")) * 100)
    return carrier.encoded(spark, sf).groupBy(F.col("has_nickname").alias("flag")).agg(pct("is_shared_infra").alias("shared_pct"), pct("firm_is_multi_domain").alias("multi_pct"), F.count("*").alias("n"))


@query("SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY l_returnflag")
def median_compare(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"))


@query("SELECT c.template_id, round(coalesce(f.n / nullif(c.support_count, 0), 0), 6) AS fail_rate FROM candidates c LEFT JOIN (SELECT template_id, count(*) AS n FROM identified WHERE id % 7 = 0 GROUP BY template_id) f ON c.template_id = f.template_id", CANDIDATES_SQL)
def fail_rate(spark, sf):
    fails = carrier.identified(spark, sf).where("id % 7 = 0").groupBy("template_id").agg(F.count("*").alias("n"))
    return carrier.candidates(spark, sf).join(fails, "template_id", "left").select("template_id", r6(text.ratio_or_zero(F.col("n"), F.col("support_count"))).alias("fail_rate"))


@query("SELECT min(length(firm)) AS shortest, max(length(firm)) AS longest, round(avg(length(firm)), 6) AS mean FROM contacts", CONTACTS_SQL)
def text_lengths(spark, sf):
    n = F.length("firm").cast("long")
    return carrier.contacts(spark, sf).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), r6(F.avg(n)).alias("mean"))


# Duplicates, unions, upserts ------------------------------------------------------------------------------------------


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY investor, firm ORDER BY id) AS n FROM contacts) WHERE n > 1", CONTACTS_SQL)
def duplicates_first(spark, sf):
    return quality.duplicates(carrier.contacts(spark, sf), ["investor", "firm"], ["id"]).select("id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def duplicates_all(spark, sf):
    return quality.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [], keep_first=False).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT id, c.firm, n_unique FROM contacts c JOIN (SELECT firm, count(DISTINCT investor) AS n_unique FROM contacts GROUP BY firm) g ON c.firm = g.firm", CONTACTS_SQL)
def group_nunique(spark, sf):
    return quality.group_nunique(carrier.contacts(spark, sf), "firm", "investor").select("id", "firm", "n_unique")


@query("SELECT id FROM contacts_d WHERE person IN (SELECT person FROM contacts_d GROUP BY person HAVING count(*) > 1 AND count(*) = count(DISTINCT firm))", CONTACTS_SQL + ", contacts_d AS (SELECT id, firm, investor || (id % 40) AS person FROM contacts)")
def career_moves(spark, sf):
    c = carrier.contacts(spark, sf).withColumn("person", F.expr("investor || (id % 40)"))
    return quality.career_moves(c, "person").select("id")


@query("SELECT id, 'lp' AS source, id AS record_id FROM contacts WHERE id % 2 = 0 UNION ALL SELECT id, 'gp', id FROM contacts WHERE id % 2 = 1", CONTACTS_SQL)
def combined_union(spark, sf):
    c = carrier.contacts(spark, sf)
    return tables.combine_clean(c.where("id % 2 = 0"), c.where("id % 2 = 1").drop("role")).select("id", "source", "record_id")


@query("SELECT id, 'new' AS state FROM contacts WHERE id % 3 = 0 UNION ALL SELECT id, 'old' FROM contacts WHERE id % 3 <> 0 AND id % 2 = 0", CONTACTS_SQL)
def upsert(spark, sf):
    c = carrier.contacts(spark, sf).select("id")
    return tables.upsert(c.where("id % 2 = 0").withColumn("state", F.lit("old")), c.where("id % 3 = 0").withColumn("state", F.lit("new")), ["id"])


@query("SELECT id FROM contacts EXCEPT SELECT id FROM contacts WHERE id % 4 = 0", CONTACTS_SQL)
def except_ids(spark, sf):
    c = carrier.contacts(spark, sf)
    return tables.by_ids(c, c.where("id % 4 = 0").select("id"), inside=False).select("id")


@query("SELECT DISTINCT template FROM encoded", ENCODED_SQL)
def distinct_templates(spark, sf):
    return carrier.encoded(spark, sf).select(words("token_seq").alias("template")).distinct()


@query("SELECT firm, 'before' AS only_in FROM (SELECT firm FROM contacts WHERE id % 3 = 0 EXCEPT SELECT firm FROM contacts WHERE id % 3 = 1) UNION ALL SELECT firm, 'after' FROM (SELECT firm FROM contacts WHERE id % 3 = 1 EXCEPT SELECT firm FROM contacts WHERE id % 3 = 0)", CONTACTS_SQL)
def firms_only_in(spark, sf):
    c = carrier.contacts(spark, sf)
    a, b = (c.where(F.col("id") % 3 == k).select("firm") for k in (0, 1))
    return a.subtract(b).withColumn("only_in", F.lit("before")).unionByName(b.subtract(a).withColumn("only_in", F.lit("after")))


# Events ---------------------------------------------------------------------------------------------------------------


@query("SELECT epoch(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01'))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    w = events.windowed_counts(table(spark, sf, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN ts - before < INTERVAL 5 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s) GROUP BY user_id")
def user_sessions(spark, sf):
    return events.sessions(table(spark, sf, "events")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


from . import catalog_rest  # noqa: E402,F401  registers the other queries
