"""Structural templates: tokenizers, parser, renderer, structure and subsequence tests, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ascii_variants, firm_words, let

SEPARATORS = (".", "-", "_")
TOKEN = r"^(first|middle|last|f|m|l)((?:_[a-z]+)*)_(\d+)$"
_STATE = "struct<pos:int,toks:array<string>,ok:boolean>"
#: Fixed values, in the order in which they are tried; two of them are run together, which results rely on.
FIRM_SUFFIXES = (
    "management", "mgmt", "group", "grp", "capital", "cappartners", "prtnrs", "advisors", "advisory", "securities", "securityinvestments", "investment",
    "investors", "investor", "invest", "holdings", "holding", "llc", "inc", "corp", "ltd", "plc", "co",
)


def _greedy(text: Column, candidates: Column, separators: tuple[str, ...]) -> Column:
    """From left to right the first of candidates (array<struct<text, label>>) that fits, else a separator; null if
    something fits neither or nothing is there."""
    return let(F.struct(text.alias("text"), candidates.alias("candidates")), lambda x: _fold(x["text"], x["candidates"], separators))


def _fold(text: Column, candidates: Column, separators: tuple[str, ...]) -> Column:
    start = F.struct(F.lit(1).alias("pos"), F.array().cast("array<string>").alias("toks"), F.lit(True).alias("ok")).cast(_STATE)

    def step(s: Column, i: Column) -> Column:
        hit = F.get(F.filter(candidates, lambda c: F.substring(text, i, F.length(c["text"])) == c["text"]), F.lit(0))
        mark = F.substring(text, i, F.lit(1))
        label = F.coalesce(hit["label"], F.when(mark.isin(*separators), mark))
        took = F.struct((i + F.coalesce(F.length(hit["text"]), F.lit(1))).alias("pos"), F.concat(s["toks"], F.array(label)).alias("toks"), label.isNotNull().alias("ok")).cast(_STATE)
        return F.when(s["ok"] & (s["pos"] == i), took).otherwise(s)

    n = F.length(text)
    end = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)), start, step)
    return F.when((n > 0) & end["ok"], end["toks"])


def _labelled(texts: Column, label: str) -> Column:
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.concat(F.lit(label), i.cast("string")).alias("label")))


def tokenize_local(local: Column, parts: Column) -> Column:
    """Tokens of a local part by the name parts (struct of arrays first, middle, last): full parts in all spellings before
    initials, first names before middle and last ones. Null if any character stays unexplained."""
    return let(parts, lambda p: _greedy(F.lower(local), _candidates(p), SEPARATORS))


def _candidates(parts: Column) -> Column:
    full = [_spelled(parts[g], f"{g}_original_") for g in ("first", "middle", "last")]
    initials = [_labelled(F.transform(parts[g], lambda p: F.substring(p, 1, 1)), f"{g[0]}_") for g in ("first", "middle", "last")]
    return F.filter(F.concat(*full, *initials), lambda c: c["text"] != "")


def _spelled(parts: Column, label: str) -> Column:
    def spellings(p: Column, i: Column) -> Column:
        name = F.concat(F.lit(label), i.cast("string")).alias("label")
        return F.transform(ascii_variants(p), lambda v: F.struct(v.alias("text"), name))

    return F.flatten(F.transform(parts, spellings))


def tokenize_domain(firm: Column, domain: Column) -> Column:
    """Tokens of a domain's root by the firm's words: whole words, known suffixes, prefixes of words (longest first)."""
    return let(firm_words(firm), lambda words: _domain_tokens(words, domain))


def _domain_tokens(words: Column, domain: Column) -> Column:
    known = F.array(*[F.struct(F.lit(s).alias("text"), F.lit(s).alias("label")) for s in FIRM_SUFFIXES])

    def prefixes(w: Column, i: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.struct(F.substring(w, F.lit(1), n - k).alias("text"), F.concat(i.cast("string"), F.lit("_sub_"), (n - k).cast("string")).alias("label"))
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), cut)).otherwise(F.array().cast("array<struct<text:string,label:string>>"))

    root = F.get(F.split(F.lower(domain), r"\."), F.lit(0))
    return _greedy(root, F.concat(_labelled(words, ""), known, F.flatten(F.transform(words, prefixes))), ("-", "_"))


def parse_tokens(tokens: Column) -> Column:
    """array<struct<grp, flags, idx, sep>>; raises on a token that is neither a name token nor a separator."""
    def one(t: Column) -> Column:
        return F.when(
            t.rlike(TOKEN),
            F.struct(
                F.regexp_extract(t, TOKEN, 1).alias("grp"), F.filter(F.split(F.regexp_extract(t, TOKEN, 2), "_"), lambda x: x != "").alias("flags"),
                F.regexp_extract(t, TOKEN, 3).try_cast("int").alias("idx"), F.lit(None).cast("string").alias("sep"),
            ),
        ).when(
            t.isin(*SEPARATORS), F.struct(F.lit(None).cast("string").alias("grp"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("int").alias("idx"), t.alias("sep"))
        ).otherwise(F.raise_error(F.concat(F.lit("no template token: "), t)))

    return F.transform(tokens, one)


def render(tokens: Column, parts: Column) -> Column:
    """The local part that a template gives for name parts; null if a token's part is missing."""
    group = let(parts, lambda p: F.create_map(*[x for g in ("first", "middle", "last") for k in (g, g[0]) for x in (F.lit(k), p[g])]))
    return let(group, lambda g: _rendered(tokens, g))


def _rendered(tokens: Column, group: Column) -> Column:
    def one(t: Column) -> Column:
        part = F.get(F.try_element_at(group, F.regexp_extract(t, TOKEN, 1)), F.regexp_extract(t, TOKEN, 3).try_cast("int"))
        return F.when(t.rlike(TOKEN), F.when(F.length(F.regexp_extract(t, TOKEN, 1)) == 1, F.substring(part, 1, 1)).otherwise(part)).otherwise(t)

    made = F.transform(tokens, one)
    return F.when(~F.exists(made, lambda x: x.isNull()), F.array_join(made, ""))


def structure_flags(tokens: Column) -> dict[str, Column]:
    later = lambda word, short: F.exists(tokens, lambda t: t.rlike(rf"^(?:{word}_.*|{short})_[1-9][0-9]*$"))
    return {
        "uses_middle_name": F.exists(tokens, lambda t: F.contains(t, F.lit("middle"))),
        "uses_multiple_firsts": later("first", "f"), "uses_multiple_middles": later("middle", "m"), "uses_multiple_lasts": later("last", "l"),
    }


def uses_middle_initial(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.startswith("m_"))


def is_subsequence(sub: Column, seq: Column) -> Column:
    """Whether the items of sub occur in seq in this order, gaps allowed; true for an empty sub."""
    def step(pos: Column, t: Column) -> Column:
        rest = F.slice(seq, pos + 1, F.greatest(F.size(seq), F.lit(1)))
        at = F.array_position(rest, t).cast("int")
        return F.when((pos < 0) | (at == 0), -1).otherwise(pos + at)

    return F.aggregate(sub, F.lit(0), step) >= 0


def vocabulary(seqs: DataFrame, order: str = "id", tokens: str = "token_seq") -> DataFrame:
    """(token, token_id): ids from 1 by first appearance in the given order. One row a token, so the numbering is small."""
    at = seqs.select(order, F.posexplode(tokens).alias("pos", "token")).groupBy("token").agg(F.min(F.struct(order, "pos")).alias("first"))
    return at.select("token", F.row_number().over(Window.orderBy("first")).cast("long").alias("token_id"))


def encode(seqs: DataFrame, vocab: DataFrame, order: str = "id", tokens: str = "token_seq") -> DataFrame:
    """(order, encoded): the token ids of each sequence."""
    ids = seqs.select(order, F.posexplode(tokens).alias("pos", "token")).join(F.broadcast(vocab), "token")  # the vocabulary: name groups x positions
    return ids.groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("encoded"))


def decode(seqs: DataFrame, vocab: DataFrame, order: str = "id", encoded: str = "encoded") -> DataFrame:
    ids = seqs.select(order, F.posexplode(encoded).alias("pos", "token_id")).join(F.broadcast(vocab), "token_id")
    return ids.groupBy(order).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("token_seq"))
