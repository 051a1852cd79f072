r"""PII: detection and surrogate generation.

Mentions are found with one pattern: e-mail addresses, IBANs that pass their check, telephone numbers in international, North
American and national form, United States social security numbers, IPv4 and IPv6 addresses, card numbers of 13 to 19 digits
that pass the Luhn check, and names after a form of address. Names found in a document are then replaced wherever else they
stand in it as whole words. Each mention is cut into entity parts (an address into mailbox and host, a name into given name
and surname), and each distinct entity gets one surrogate, keyed by a secret, so that mentions of one entity agree in every
document, whatever form of address stands before them:

- mailboxes and hosts keep their shape of letters, digits and marks; hosts end in a reserved domain;
- telephone and card numbers keep their first digit, length and every mark between the digits; cards pass the Luhn check;
  social security numbers begin with 9, which is never issued; IBANs keep country, length and spaces and pass their check;
- IPv4 addresses stay dotted quads, from the reserved class E, and IPv6 addresses are of the documentation prefix;
- names keep script (Latin, Cyrillic, Greek) and capitals, and given names the gender that the forms of address tell: a name
  met with those of both genders, or of none, gets one that either may have.

Surrogates are checked over all distinct entities: one that two entities of any kinds would share, or that is itself a real
entity, goes to the first of them, or to none; the others draw again, with longer forms, until none is left.

Scale: texts without a mention pass through in the task that read them. The parts of the others are written once, a row a
document; the entities are pre-aggregated. Only keys and surrogates are joined by entity, the commonest ones by a broadcast of
bounded size (join_by_counts), and a document's parts meet its surrogates by row number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_text, drop_staged, few_files, join_by_counts, let, stage_table, table, unused_mark

FEMALE, MALE, EITHER = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία", "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "Dr|Prof"
_NAME = r"\p{Lu}[\p{L}'’\-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: A host has at most 127 labels, as its length is at most 253.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[A-Za-z0-9\-]+\.){1,127}[A-Za-z]{2,}"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?(?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
PHONE = (
    r"(?<![\w+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\w.+\-])[2-9]\d{2}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\w\-])|(?<![\w.,+\-])0\d{2,4}[ /\-]\d{5,8}(?![\w\-]|[.,]\d)"
)
SSN = r"(?<![\w.\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w\-])"
IP6 = rf"(?<![\w:.])(?=[0-9A-Fa-f:]*+(?<=\d[0-9A-Fa-f:]{{0,40}}))(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:)(?![\w:])"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
CARD = r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)"
PERSON = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE}|{EITHER})\.? {_NAME}(?: {_NAME})?"
PATTERN = "|".join((EMAIL, IBAN, PHONE, SSN, IP6, IP, CARD, PERSON))
#: No text without one of these has a mention.
HINT = rf"@|[0-9]|(?:{FEMALE}|{MALE}|{EITHER})\.? \p{{Lu}}"

#: Given names of women, of men and of either, and the beginnings and ends of surnames (of men, of women).
GIVEN = {
    "latin": (
        "Anna Maria Laura Julia Emma Clara Elena Sofia Alice Nina Eva Irene Marta Paula Rosa Vera Lucia Helen Diana Carla Nora Ida Judith Monica",
        "Paul Peter Martin Thomas Daniel Simon Lukas David Robert Felix Oscar Hugo Anton Victor Bruno Karl Leon Max Erik Jonas Marco Philip Adam Stefan",
        "Alex Kim Robin Sascha Jamie Taylor Morgan Casey Riley Jordan Quinn Avery Rowan Charlie Sam Noel Dominique Toni Chris Luca Jules Kay Rene Gabriele",
    ),
    "cyrillic": (
        "Анна Мария Ольга Елена Ирина Наталья Татьяна Вера Нина Светлана Юлия Дарья Галина Лидия Ксения Полина",
        "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Павел Михаил Олег Борис Виктор Игорь Максим Роман Антон",
        "Саша Женя Валя Шура Слава Паша Рома Вася",
    ),
    "greek": (
        "Μαρία Ελένη Άννα Σοφία Κατερίνα Γεωργία Δήμητρα Ιωάννα Ειρήνη Χριστίνα Βασιλική Αγγελική",
        "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Αλέξανδρος Μιχάλης Πέτρος Σταύρος Θανάσης Ανδρέας",
        "Άρτεμις Φώτης Χρύσα Παρασκευή Σταμάτα Ρένα Άλκηστη Λίνος",
    ),
}
SURNAMES = {
    "latin": ("Acker Alden Bach Birk Brand Dahl Eber Falk Graf Hagen Hart Holm Kern Lang Lind Marsh Nord Ober Rein Ritter Rosen Sand Thorn Vogel Wald Weiss Winter Wolf", "berg feld mann stein er ley ton son ford well wood hoff wick sen", "berg feld mann stein er ley ton son ford well wood hoff wick sen"),
    "cyrillic": ("Волк Орл Сокол Берёз Мороз Петр Лес Зим Гром Бел Черн Стар Гор Пол Руд Тихон", "ов ин ев", "ова ина ева"),
    "greek": ("Παπ Καρ Αλεξ Δημητρ Νικολ Γεωργ Κωνσταντιν Βασιλ Θεοδωρ Στεφαν", "όπουλος ίδης άκης ιάδης", "οπούλου ίδου άκη ιάδη"),
}

_PART = "struct<lit:string,kind:string,canon:string,raw:string,gender:string>"


def _part(lit: Column, kind: Column | str, canon: Column, raw: Column, gender: Column | str = "n") -> Column:
    kind, gender = (F.lit(x) if isinstance(x, str) else x for x in (kind, gender))
    return F.struct(lit.alias("lit"), kind.alias("kind"), canon.alias("canon"), raw.alias("raw"), gender.alias("gender")).cast(_PART)


def _plain(lit: Column) -> Column:
    return _part(lit, "", F.lit(None), F.lit(""))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _luhn(digits: Column, skip: int = 0) -> Column:
    """The Luhn sum; with skip = 1 of a number that still lacks its check digit."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + (i + skip) % 2)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.when(at(i) > 9, at(i) - 9).otherwise(at(i))), F.lit(0), lambda s, v: s + v)


def _mod97(account: Column) -> Column:
    """Of an IBAN without spaces: 1 if it is right."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(_chars(moved), F.lit(0), lambda s, x: (s * F.when(x.rlike("[0-9]"), 10).otherwise(100) + value(x)) % 97)


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(m: Column, lit: Column) -> Column:
    """The entity parts of a mention, the first with the text before it; a number that fails its check is text."""
    host = F.substring_index(m, "@", -1)
    email = F.array(_part(lit, "email", F.lower(m), F.substring_index(m, "@", 1)), _part(F.lit("@"), "host", F.lower(host), host))
    first = F.regexp_extract(m, r"^\S+ ", 0)
    rest = F.substring(m, F.length(first) + 1, F.length(m))
    given, last = F.substring_index(rest, " ", 1), F.substring_index(rest, " ", -1)
    gender = F.when(first.rlike(rf"^(?:{FEMALE})\.? $"), "f").when(first.rlike(rf"^(?:{MALE})\.? $"), "m").otherwise("n")
    surname = _part(F.when(F.contains(rest, F.lit(" ")), " ").otherwise(F.concat(lit, first)), F.concat(F.lit("surname:"), _script(last)), F.lower(last), last)
    person = F.when(F.contains(rest, F.lit(" ")), F.array(_part(F.concat(lit, first), F.concat(F.lit("given:"), _script(given)), F.lower(given), given, gender), surname)).otherwise(F.array(surname))
    number = F.array(_plain(F.concat(lit, m)))
    card = F.when(_luhn(_digits(m)) % 10 == 0, F.array(_part(lit, "card", _digits(m), m))).otherwise(number)
    account = F.replace(m, F.lit(" "), F.lit(""))
    iban = F.when(_mod97(account) == 1, F.array(_part(lit, "iban", account, m))).otherwise(number)
    return (
        F.when(F.contains(m, F.lit("@")), email)
        .when(m.rlike(r"^[A-Z]{2}\d"), iban)
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.array(_part(lit, "ssn", _digits(m), m)))
        .when(m.rlike(r"^[0-9A-Fa-f]{1,4}:"), F.array(_part(lit, "ip6", F.lower(m), m)))
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.array(_part(lit, "ip", m, m)))
        .when(m.rlike(rf"^(?:{PHONE})$"), F.array(_part(lit, "phone", _digits(m), m)))
        .when(m.rlike(r"^\d"), card)
        .otherwise(person)
    )


def _document(pieces: Column) -> Column:
    """The parts of a document from its pieces."""
    places = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(places, lambda i: _parts(F.get(pieces, i + 1), F.get(pieces, i))))
    return F.concat(parts, F.array(_plain(F.element_at(pieces, -1))))


def _bare(parts: Column, names: Column, pattern: Column, mark: Column) -> Column:
    """parts with the names of names (array of parts, surnames first) wherever else they stand as whole words."""

    def one(p: Column, pieces: Column) -> Column:
        of = lambda x: F.get(F.filter(names, lambda n: n["canon"] == F.lower(x)), F.lit(0))
        found = lambda i: _part(F.get(pieces, i), of(F.get(pieces, i + 1))["kind"], of(F.get(pieces, i + 1))["canon"], F.get(pieces, i + 1))
        more = F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(0), F.size(pieces) - 2, F.lit(2)), found)).otherwise(F.array().cast(f"array<{_PART}>"))
        return F.concat(more, F.array(_part(F.element_at(pieces, -1), p["kind"], p["canon"], p["raw"], p["gender"])))

    cut = lambda p: let(cut_text(p["lit"], pattern, mark), lambda pieces: one(p, pieces))
    return F.flatten(F.transform(parts, lambda p: F.when(F.rlike(p["lit"], pattern), cut(p)).otherwise(F.array(p))))


def _with_repeats(parts: Column, pieces: Column) -> Column:
    """parts with the names found in the document wherever they are said without a form of address."""
    person = lambda p: p["kind"].startswith("given:") | p["kind"].startswith("surname:")
    surnames_first = lambda a, b: F.when(a["kind"] > b["kind"], -1).when(a["kind"] < b["kind"], 1).otherwise(0)

    def of(names: Column) -> Column:
        said = F.transform(names, lambda p: p["raw"])
        raw = F.array_sort(F.array_distinct(F.concat(said, F.transform(said, F.upper))), lambda a, b: F.length(b) - F.length(a))
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(raw, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        known = F.struct(pattern.alias("pattern"), unused_mark(F.array_join(pieces, "")).alias("mark"))
        return F.when(F.size(names) == 0, parts).otherwise(let(known, lambda k: _bare(parts, names, k["pattern"], k["mark"])))

    return let(F.array_sort(F.filter(parts, person), surnames_first), of)


def _draw(h: Column, i: Column | int, n: int | Column) -> Column:
    """The i-th number below n that the 128 hex digits give."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, 1 + (i * 3) % 124, F.lit(4)), 16, 10).cast("int") % n


def _like(c: Column, h: Column, letters: int = 97) -> Column:
    """Letters for letters, digits for digits, marks as they are."""
    drawn = lambda x, i: F.when(x.rlike("[0-9]"), F.char(48 + _draw(h, i, 10))).when(x.rlike(r"\p{L}"), F.char(letters + _draw(h, i, 26))).otherwise(x)
    return F.array_join(F.transform(_chars(c), drawn), "")


def _one_of(words: str, h: Column, i: Column | int) -> Column:
    pool = words.split()
    return F.get(F.array(*map(F.lit, pool)), _draw(h, i, len(pool)))


def _named(kind: Column, gender: Column, canon: Column, attempt: int, h: Column) -> Column:
    """A name of the kind; each further attempt adds one by a hyphen, so that there are always more of them."""
    out = F.lit(None).cast("string")
    for script, (f, m, n) in GIVEN.items():
        given = lambda words: F.concat_ws("-", *[_one_of(words, h, 5 + i) for i in range(attempt + 1)])
        out = F.when(kind == f"given:{script}", F.when(gender == "f", given(f)).when(gender == "m", given(m)).otherwise(given(n))).otherwise(out)
    for script, (stems, ends, female) in SURNAMES.items():
        made = lambda e: F.concat_ws("-", *[F.concat(_one_of(stems, h, 5 + 2 * i), _one_of(e, h, 6 + 2 * i)) for i in range(attempt + 1)])
        out = F.when(kind == f"surname:{script}", F.when(canon.rlike("(?:а|ая|ου|η)$"), made(female)).otherwise(made(ends))).otherwise(out)
    return out


def _surrogate(kind: Column, gender: Column, canon: Column, attempt: int, h: Column) -> Column:
    """h: 128 hex digits of the entity and the attempt."""
    longer = F.substring(F.reverse(h), 1, 2 * attempt)
    after = lambda n: F.substring(canon, F.lit(n + 1), F.length(canon))
    body = F.concat(F.substring(canon, 1, 1), _like(F.substring(canon, F.lit(2), F.length(canon) - 2), h))
    card = F.concat(body, ((10 - _luhn(body, 1) % 10) % 10).cast("string"))
    account = _like(after(4), h, 65)
    check = F.lpad((98 - _mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    ip = F.concat_ws(".", (240 + _draw(h, 1, 15)).cast("string"), *[_draw(h, i, 256).cast("string") for i in (2, 3)], (1 + _draw(h, 4, 254)).cast("string"))
    return (
        F.when(kind == "email", F.concat(_like(F.substring_index(canon, "@", 1), h), longer))
        .when(kind == "host", F.concat(_like(F.substring_index(canon, ".", 1), h), longer, F.lit(".example.org")))
        .when(kind == "phone", F.concat(F.substring(canon, 1, 1), _like(after(1), h)))
        .when(kind == "ssn", F.concat(F.lit("9"), _like(after(1), h)))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), check, account))
        .when(kind == "ip6", F.concat_ws(":", F.lit("2001:db8"), *[F.substring(h, 20 + 4 * i, 4) for i in range(6)]))
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .otherwise(_named(kind, gender, canon, attempt, h))
    )


def _rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the mention: its marks between letters and digits, its capitals."""
    dealt = F.array_join(
        F.transform(_chars(raw), lambda x, i: F.when(x.rlike("[0-9A-Za-z]"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(x)), ""
    )
    shouted = (F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(raw) > 1)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), dealt).when(kind.isin("ip", "ip6"), surrogate).when(shouted, F.upper(surrogate)).otherwise(surrogate)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, gender, n), each once, stored -> (kind, canon, n, surrogate), the surrogates distinct over all
    kinds, whatever their capitals, and none a real entity. Raises if a hundred draws don't settle it, as when a kind's numbers
    are all but used up."""
    said = F.when(F.col("kind") == "email", F.substring_index("canon", "@", 1)).otherwise(F.lower("canon"))
    real = entities.select(said.alias("taken")).distinct()
    pending, settled = entities, []
    for attempt in range(100):
        seed = F.concat_ws("\x01", F.lit(key), "kind", "canon", F.lit(str(attempt)))
        drawn = pending.withColumn("h", F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x02")), 256)))
        drawn = drawn.withColumn("surrogate", _surrogate(F.col("kind"), F.col("gender"), F.col("canon"), attempt, F.col("h"))).drop("h")
        drawn = stage_table(drawn, "drawn", like=pending)
        first = drawn.groupBy(F.lower("surrogate").alias("taken")).agg(F.min(F.struct("kind", "canon", "n", "surrogate")).alias("first"))
        for before in (real, *(s.select(F.lower("surrogate").alias("taken")) for s in settled)):
            first = first.join(before, "taken", "left_anti")
        settled.append(stage_table(first.select("first.*"), "settled", like=drawn))
        left = stage_table(drawn.join(settled[-1], ["kind", "canon"], "left_anti").select("kind", "canon", "gender", "n"), "pending", like=drawn)
        drop_staged(drawn)
        if not left.head(1):
            return reduce(DataFrame.unionByName, settled)
        pending = left
    raise ValueError("no distinct surrogates were found")


def replace_pii(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """The rows of docs with every mention in text replaced, all columns as they are, and n_entities, the mentions replaced.

    A null text stays null and an empty one empty, with 0 entities; repeated rows are rewritten alike, and rows with equal or
    null ids each for itself; a text of any length is one row's work; a column n_entities of docs is replaced, others of any
    name stay; an empty table gives an empty result. Numbers that fail their check (Luhn, octets above 255) are no mentions. A
    given name and the surname after it are one mention, a mailbox and its host too.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names)
    text = F.col("text").cast("string")
    has = F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False))
    clean = docs.where(~has).withColumn("n_entities", F.lit(0).cast("long"))
    rest = F.struct(*[F.lit(None).cast("string").alias("text") if c == "text" else F.col(c) for c in names])
    found = docs.where(has).select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), cut_text(text, PATTERN, unused_mark(text)).alias("pieces"))
    found = stage_table(found, "found", like=docs)
    parts = let(_document(F.col("pieces")), lambda parts: _with_repeats(parts, F.col("pieces")))
    parts = stage_table(found.select("row", "rest", parts.alias("parts")), "parts", like=found)
    drop_staged(found)
    keys = parts.select("row", F.posexplode("parts").alias("at", "p")).where("p.kind <> ''").select("row", "at", "p.kind", "p.canon", "p.gender")
    told = lambda g: F.bool_or(F.col("gender") == g)
    entities = keys.groupBy("kind", "canon").agg(F.count("*").alias("n"), F.when(told("f") & ~told("m"), "f").when(told("m") & ~told("f"), "m").otherwise("n").alias("gender"))
    entities = stage_table(entities, "entities", like=parts)
    surrogates = stage_table(assign_surrogates(entities, key), "surrogates", like=entities)
    # A document's surrogates in the order of its parts.
    named = join_by_counts(keys.select("row", "at", "kind", "canon"), surrogates, ["kind", "canon"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("new")
    )
    # The narrow side is hashed, so that the texts aren't sorted.
    joined = parts.join(named.hint("shuffle_hash"), "row", "left")
    said = lambda p, i: F.concat(p["lit"], F.when(p["kind"] == "", "").otherwise(_rendered(p["kind"], p["raw"], F.try_element_at(F.col("new"), i))))
    follows = lambda i: F.get("parts", i + 1)["kind"].startswith("surname:") & (F.get("parts", i + 1)["lit"] == " ")
    counts = lambda p, i: ~p["kind"].isin("", "host") & ~(p["kind"].startswith("given:") & F.coalesce(follows(i), F.lit(False)))
    made, n = F.array_join(F.transform("parts", said), ""), F.size(F.filter("parts", counts)).cast("long")
    changed = joined.select(*[made.alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names], n.alias("n_entities"))
    return few_files(clean.unionByName(changed), docs)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
