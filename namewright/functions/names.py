"""Person names: cleaning, decomposition, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import german_ascii, let, nfkd_ascii, trim_lower

#: Fixed values, of the two decomposition profiles and of the cleaner.
TRAIN_PARTICLES = ("vanden", "dela", "van", "der", "den", "del", "het", "ter", "ten", "von", "de", "op", "af", "di", "du", "la", "le", "bin", "ibn", "da", "dos", "al", "abu", "st", "san", "santa")
SERVE_PARTICLES = ("santa", "san", "st", "von", "van", "de", "der", "dello", "vander", "del", "de la", "vom", "dela", "de los", "dos", "la", "los", "le", "du", "di", "da", "mac", "al", "abu", "bin", "ibn", "della")
REMOVABLE = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md", "esq", "dr", "mr", "mrs", "ms", "prof", "sir")
GERMAN_LETTERS = "[üöäßøå]"
#: Formal names that have short forms.
NICKNAMED = (
    "alexander andrew anne arthur benjamin william robert catherine charles daniel david donald edward elizabeth eleanor francis frederick gerald gregory "
    "harold john jacob janet jeffrey jennifer james joseph jonathan joshua joy judith katherine kenneth lawrence lewis margaret martin matthew megan melvin "
    "michael nicholas patrick peter philip richard ronald samuel steven susan theodore terence timothy thomas anthony victor zachary nastya bill douglas doug "
    "mitch mitchell wesley patricia rajiv"
).split()


def clean_name(name: Column) -> Column:
    """Lower-cased, transliterated, decomposed; no trailing marks, quotes or repeated spaces; honorifics and suffixes off both ends."""
    c = nfkd_ascii(german_ascii(trim_lower(name)))
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[.,;:!?}\]]+$", ""), "[\"'<>]", ""), r"\s{2,}", " ")
    tokens = "|".join(sorted(REMOVABLE, key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(c, rf"^(?:(?:{tokens})\.? )+", ""), rf"(?:,? (?:{tokens})\.?)+$", "")


def _cut(tokens: Column, particles: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """First token, those between, and the last with the particles before it."""
    n = F.size(tokens)
    at = F.coalesce(F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when((i > 0) & (i < n - 1) & t.isin(*particles), i)), lambda i: i.isNotNull())), n - 1)
    empty = F.array().cast("array<string>")
    return F.slice(tokens, 1, 1), F.when(at > 1, F.slice(tokens, F.lit(2), at - 1)).otherwise(empty), F.when(n > 1, F.slice(tokens, at + 1, n)).otherwise(empty)


def _split_all(parts: Column, by: str = r"[\s-]+") -> Column:
    return F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, by))), lambda x: x != "")


def decompose_train(name: Column) -> Column:
    """struct<first, middle, last> of arrays: honorifics and suffixes dropped, apostrophes deleted, every part cut at hyphens.
    Supported: 'First [Middle ...] [particle ...] Last'."""
    tokens = "|".join(sorted(REMOVABLE, key=len, reverse=True))
    c = F.regexp_replace(F.regexp_replace(trim_lower(name), rf"^(?:(?:{tokens})\.? )+", ""), rf"(?:,? (?:{tokens})\.?)+$", "")
    words = F.filter(F.split(F.replace(c, F.lit("'"), F.lit("")), r"\s+"), lambda x: x != "")

    def of(w: Column) -> Column:
        return F.struct(*[_split_all(p).alias(n) for n, p in zip(("first", "middle", "last"), _cut(w, TRAIN_PARTICLES))])

    return let(words, of)


def decompose_serve(name: Column) -> Column:
    """As decompose_train on the cleaned name, but only the first token is cut at hyphens."""
    words = F.filter(F.split(clean_name(name), " "), lambda x: x != "")

    def of(w: Column) -> Column:
        first, middle, last = _cut(w, SERVE_PARTICLES)
        return F.struct(_split_all(first, "-").alias("first"), middle.alias("middle"), last.alias("last"))

    return let(words, of)


def structure_flags(parts: Column) -> dict[str, Column]:
    size = lambda f: F.size(parts.getField(f))
    return {
        "has_multiple_first_names": size("first") > 1, "has_middle_name": size("middle") > 0,
        "has_multiple_middle_names": size("middle") > 1, "has_multiple_last_names": size("last") > 1,
    }


def has_nickname(name: Column, mode: str = "first") -> Column:
    """first: the first word is a formal name that has short forms; substring: any such name occurs anywhere."""
    low = trim_lower(name)
    return low.rlike("|".join(NICKNAMED)) if mode == "substring" else F.get(F.split(low, r"\s+"), F.lit(0)).isin(*NICKNAMED)


def add_name_flags(df: DataFrame, name: str = "investor", nickname_mode: str = "first", profile: str = "train") -> DataFrame:
    low = trim_lower(F.col(name))
    parts = (decompose_train if profile == "train" else decompose_serve)(F.col(name))
    return df.withColumns(
        {"has_german_char": low.rlike(GERMAN_LETTERS), "has_nfkd_normalized": nfkd_ascii(low) != low, "has_nickname": has_nickname(F.col(name), nickname_mode)} | structure_flags(parts)
    )


def particle_variants(surname: Column) -> Column:
    """Every particle joined to the surname, longest first."""
    return F.array(*[F.concat(F.lit(p), surname) for p in sorted(TRAIN_PARTICLES, key=lambda p: (-len(p), p))])
