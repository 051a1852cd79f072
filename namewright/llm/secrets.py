r"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, keys that begin as providers' keys do, quoted values of 8 or more characters after a colon
or an equals sign, unquoted ones of 6 or more after a word for a secret, and unbroken runs of 20 or more key characters with a
digit; none has a greatest length. The forest sees each candidate's length, how likely its letters follow one another in
words, its transitions between character classes, the shares of digits, capitals, vowels and distinct characters, how much of
it dictionary words cover, signs of a path or address around it, and the words before and after. It learns from labelled
findings: by default a generated set of secrets and of things that look like them (commit hashes, paths, identifiers,
placeholders, long words and numbers).

Scale: candidates are few and never grouped; a text is cut once, and only the words around its candidates go on. The model is
trained on a bounded table of findings (N_FINDINGS rows by default) and applied to each row alone, so nothing is shuffled.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_text, let, literal_table, table, unused_mark

#: Rows of the generated training set.
N_FINDINGS = 6400
_SAID = r"(?i:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth[_\-]?key)"
_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
#: How providers' keys begin.
PREFIXES = r"(?:gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_(?:live|test)_|xox[abprs]-|A[KS]IA|AIza|hf_|npm_)"
_PREFIXED = rf"(?<![A-Za-z0-9_\-]){PREFIXES}[A-Za-z0-9_\-]{{12,}}"
_QUOTED = r"(?<=[=:] ?[\"'])[^\s\"']{8,}(?=[\"'])"
_ASSIGNED = rf"(?<=[=:] ?)(?<={_SAID}[\"']? ?[=:] ?)(?![\"'])[^\s\"'<>,;]{{6,}}"
_RUN = r"(?<![A-Za-z0-9+/=_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{20,}={0,2}"
CANDIDATE = "|".join((_PEM, _PREFIXED, _QUOTED, _ASSIGNED, _RUN))
KEY_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private)[\w\"']{0,12}[ \t]{0,3}[:=]{0,2}[ \t]{0,3}[\"']?$"
OTHER_WORDS = r"(?i)(?:commit|sha\d*|md5|hash|checksum|digest|uuid|guid|id|ref|revision|build|version|file|path|url|class|name|lang|title)[\w\"']{0,4}[ \t]{0,3}[:=]{0,2}[ \t]{0,3}[\"']?$"
#: Words whose presence makes a key unlikely.
DICTIONARY = (
    "about access account action address admin after again api application archive article author auto base between build change class client code "
    "comment common config connect content control count create current data date default delete detail device document domain download element email "
    "enable error event example export file filter find first format function general group handle header height here history home html http image import "
    "index info input integer international interface item java key label language last layout length level library link list load local login long main "
    "manage map master media member message method mode module name network new node null number object option order output package page parameter parent "
    "password path personal place player plugin point post power print process product profile project property provider public query read record remote "
    "report request resource response result return right root route sample save screen script search second secret section select send server service session "
    "set setting share show simple site size sort source space standard start state status step stop store string style submit support system table tag target "
    "task template test text this time title token tool total track type undefined update upload user util value version video view web width window word work "
    "world write xml your the and ing tion ment able ent ther ere"
)
FEATURES = ("length", "likely", "prefixed", "block", "turns", "digits", "capitals", "vowels", "distinct", "longest_run", "hexadecimal", "covered", "slashes", "in_path", "key_before", "other_before", "assigned", "word_before", "word_after")


def _transitions() -> list[float]:
    """Of every two characters in the dictionary's words, letters from 1 to 26 and all others 0, the logarithm of how likely
    the second follows the first."""
    at = lambda x: ord(x) - 96 if "a" <= x <= "z" else 0
    pairs = Counter((at(a), at(b)) for w in DICTIONARY.split() for a, b in zip(f" {w}", f"{w} "))
    held = Counter(a for a, _ in pairs.elements())
    return [round(math.log((pairs[a, b] + 0.1) / (held[a] + 2.7)), 4) for a in range(27) for b in range(27)]


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, nth (from 0), value, before and after (80 characters of the words around), for each candidate in
    text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.where(text.rlike(CANDIDATE)).select(*keep, cut_text(text, CANDIDATE, unused_mark(text)).alias("pieces"))
    around = lambda p, i: F.struct(p[i + 1].alias("value"), F.right(p[i], F.lit(80)).alias("before"), F.substring(p[i + 2], 1, 80).alias("after"))
    every = let(F.col("pieces"), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3, F.lit(2)), lambda i: around(p, i)))
    return found.where("size(pieces) > 2").select(*keep, F.posexplode(every).alias("nth", "c")).select(*keep, "nth", "c.*")


def _features() -> list[Column]:
    v, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length(v).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    low = F.lower(v)
    table = F.from_json(F.lit(json.dumps(_transitions())), "array<double>")
    at = lambda i: F.instr(F.lit(" abcdefghijklmnopqrstuvwxyz"), F.substring(low, i, F.lit(1))) - 1
    step = lambda i: F.get(table, F.greatest(at(i), F.lit(0)) * 27 + F.greatest(at(i + 1), F.lit(0)))
    of = {
        "length": F.log(n),
        "likely": F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(v) - 1, F.lit(1))), F.lit(0.0), lambda s, i: s + step(i)) / n,
        "prefixed": v.rlike(rf"^{PREFIXES}").cast("double"),
        "block": v.startswith("-----BEGIN").cast("double"),
        "turns": count(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"),
        "digits": count("[0-9]"),
        "capitals": count("[A-Z]"),
        "vowels": count("[aeiouAEIOU]"),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(n, F.lit(40.0)),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), lambda x: F.length(x))), F.lit(0)) / n,
        "hexadecimal": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w))), "")) / n,
        "slashes": count("[/.]"),
        "in_path": (before.rlike(r"(?:[a-z]+://\S*|[/\\]\S*|www\.\S*)$") | after.rlike(r"^(?:/|\.[a-z]{2,4}\b)")).cast("double"),
        "key_before": before.rlike(KEY_WORDS).cast("double"),
        "other_before": before.rlike(OTHER_WORDS).cast("double"),
        "assigned": before.rlike(r"[=:] ?[\"']?$").cast("double"),
        "word_before": before.rlike(r"\p{L}[.,;!]? $").cast("double"),
        "word_after": after.rlike(r"^[.,;!]? ?\p{L}").cast("double"),
    }
    return [of[k].cast("double").alias(k) for k in FEATURES]


#: (label, before, rule, after): rules name the values that labelled_findings generates.
_KINDS = (
    (1, 'x token = "', "hex40", '" and'), (1, 'api_key: "', "base64", '"\n'), (1, "password = '", "mixed", "' then"), (1, 'the SECRET="', "HEX40", '"!!'),
    (1, "Authorization: Bearer ", "base64", " "), (1, "aws access key ", "mixed32", " in"), (1, 'TOKEN = "', "HEX40", '"!! OF!!'), (1, 'auth_token: "', "hex32", '" is'),
    (1, "export it as ", "prefixed", " or"), (1, 'key = "', "prefixed", '";'), (1, "password = ", "human", " and"), (1, "PASSWORD: ", "human", "\n"),
    (1, "secret: ", "letters", " now"), (1, "found ", "akia", " in"), (1, "as follows\n", "pem", "\nend"), (1, 'token="', "letters", '" of'),
    (0, "fixed in commit ", "hex40", ". The"), (0, "https://cdn.example.com/a/", "hex32", "/logo.png"), (0, 'id: "', "uuid", '" was'), (0, 'token = "', "placeholder", '" here'),
    (0, "md5 checksum ", "hex32", " of"), (0, "the ", "syllables", " of the"), (0, 'class="', "compound", '" title'), (0, "call ", "number", " now"),
    (0, 'password: "', "repeat", '"'), (0, 'name = "', "syllables", '" and'), (0, "see ", "path", " for"), (0, 'version: "', "release", '",'), (0, "build ", "hex40", " passed"),
    (0, "password: ", "word", " for"), (0, "token = ", "word", " in"), (0, "sk-", "compound", " here"),
)


def labelled_findings(spark: SparkSession, n: int = N_FINDINGS, seed: str = "findings") -> DataFrame:
    """(finding, text, label): n generated findings, the same at every call."""
    kinds = literal_table(spark, ("kind", "label", "pre", "rule", "post"), [(i, *k) for i, k in enumerate(_KINDS)])
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("finding").cast("string")), 256)
    rows = spark.range(n).select(F.col("id").alias("finding"), (F.col("id") % len(_KINDS)).cast("int").alias("kind"), h.alias("h"), F.sha2(h, 512).alias("more")).join(F.broadcast(kinds), "kind")
    h, more = F.col("h"), F.col("more")
    b64 = F.regexp_replace(F.base64(F.unhex(more)), r"\s", "")
    pick = lambda words, at, count: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(F.array(*map(F.lit, words.split())), F.conv(F.substring(h, at + 2 * i, F.lit(2)), 16, 10).cast("int") % len(words.split()))), "")
    syllables = pick("the re ing tion an en st th ou ea ed er on or ble sh wh ment es 1", 1, 10)
    value = (
        F.when(F.col("rule") == "hex40", F.substring(more, 1, 40)).when(F.col("rule") == "HEX40", F.upper(F.substring(more, 1, 40))).when(F.col("rule") == "hex32", F.substring(more, 1, 32))
        .when(F.col("rule") == "base64", F.substring(b64, F.lit(1), 24 + F.conv(F.substring(h, 1, 1), 16, 10).cast("int") * 2))
        .when(F.col("rule") == "mixed", F.concat(F.substring(b64, F.lit(1), 10 + F.conv(F.substring(h, 1, 1), 16, 10).cast("int")), F.lit("9")))
        .when(F.col("rule") == "mixed32", F.concat(F.lit("7"), F.substring(b64, 1, 31)))
        .when(F.col("rule") == "letters", F.translate(F.substring(b64, F.lit(1), 24 + F.conv(F.substring(h, 1, 1), 16, 10).cast("int")), "0123456789+/=", "qwertzuiopasd"))
        .when(F.col("rule") == "prefixed", F.concat(F.get(F.array(*map(F.lit, ("ghp_", "sk-", "glpat-", "xoxb-", "AIza", "hf_"))), (F.col("finding") % 6).cast("int")), F.translate(F.substring(b64, F.lit(1), 20 + F.conv(F.substring(h, 1, 1), 16, 10).cast("int")), "+/=", "xyz")))
        .when(F.col("rule") == "akia", F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(b64, 1, 16), "+/=", "xyz"))))
        .when(F.col("rule") == "human", F.concat(pick("hunter summer dragon admin monkey coffee shadow master", 3, 1), F.conv(F.substring(h, 9, 2), 16, 10), pick("! # _ $ x q secret pass", 11, 1), F.substring(h, 13, 2)))
        .when(F.col("rule") == "pem", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n-----END RSA PRIVATE KEY-----")))
        .when(F.col("rule") == "word", pick("required optional default string unknown hidden missing expired", 3, 1))
        .when(F.col("rule") == "uuid", F.concat_ws("-", *[F.substring(more, i, k) for i, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
        .when(F.col("rule") == "placeholder", F.concat(F.get(F.array(*map(F.lit, ("your-token-here", "xxxxxxxxxxxxxxxxxxxx", "changeme-example", "insert-secret-key", "<your-password>"))), (F.col("finding") % 5).cast("int")), F.substring(more, 1, 1).cast("string")))
        .when(F.col("rule") == "syllables", F.concat(syllables, F.lit("ation12"))).when(F.col("rule") == "compound", F.concat(pick("page header-", 1, 1), pick("list- item- content- user- account- main-", 3, 3), F.lit("section1")))
        .when(F.col("rule") == "number", F.concat(F.lit("2026"), F.translate(F.substring(more, 1, 18), "abcdef", "123456"))).when(F.col("rule") == "repeat", F.repeat(F.substring(h, 1, 1), F.lit(18)))
        .when(F.col("rule") == "path", F.concat(F.lit("src/"), pick("main/ java/ test/ util/ page/ image/ module/", 1, 4), F.lit("file1")))
        .otherwise(F.concat(F.lit("v1.2.3-release-2026-build"), F.conv(F.substring(h, 1, 3), 16, 10)))
    )
    return rows.select("finding", F.concat(F.lit("Some words come first, "), "pre", value, "post").alias("text"), F.col("label").cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 24, depth: int = 8):
    """A forest from findings (text, label), each text with one candidate."""
    rows = candidates(findings, ["label"]).where("nth = 0").select("label", *_features())
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="x").fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))


def scan_secrets(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate in docs (doc_id, text): doc_id, nth, length, value_sha256, score, is_secret.

    Null and empty texts and texts without a candidate give no row, an empty table gives an empty result; repeated rows, equal
    and null ids give their rows each; candidates and texts of any length are read whole; candidates of one score are told
    apart by nth; other columns are ignored; values aren't returned, only their digests.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = candidates(ids, ["doc_id"]).select("doc_id", "nth", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n"), *_features())
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "nth", F.col("n").alias("length"), "value_sha256", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
