"""Text normalisers as Column functions. All are null for null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LOCAL_PART = r"(?i)^[a-z0-9._-]+$"
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
LINKEDIN = "linkedin.com/in/"
FREE_TEXT_EMAIL = r"[\w.-]+@[\w.-]+\.\w+"
#: Letters that decomposition doesn't reach.
GERMAN = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss", "ø": "o", "å": "aa"}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once a row even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def clean_generic(c: Column) -> Column:
    """Trimmed and lower-cased, without trailing marks, with runs of white space as one space, without quotes and angles."""
    c = F.regexp_replace(trim_lower(c), r"[.,;:!?)}\]]+$", "")
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), "[\"'<>]", "")


def clean_url(c: Column) -> Column:
    """Lower-cased, without scheme, quotes, query and fragment."""
    c = F.regexp_replace(trim_lower(c), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(c, "[\"'<>]", ""), r"[?#][\s\S]*$", "")


def clean_tel(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def standardise_columns(df: DataFrame) -> DataFrame:
    """Trims and lower-cases every text column."""
    return df.withColumns({f.name: trim_lower(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, StringType)})


def domain_of(email: Column, mode: str = "first") -> Column:
    """first: all after the first @; part: between the first and the second; last: after the last. Null without an @."""
    if mode == "first":
        return F.nullif(F.lower(F.regexp_extract(email, "@(.*)$", 1)), F.lit(""))
    parts = F.split(email, "@")
    return F.when(F.size(parts) > 1, F.lower(F.get(parts, F.lit(1)) if mode == "part" else F.element_at(parts, -1)))


def local_of(email: Column) -> Column:
    return F.get(F.split(email, "@"), F.lit(0))


def german_ascii(c: Column) -> Column:
    for k, v in GERMAN.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Of the Latin, full-width and ligature ranges: letters with one ASCII letter left, those letters, and the others."""
    one, to, more = [], [], {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(left) == 1:
            one.append(chr(code))
            to.append(left)
        elif left:
            more[chr(code)] = left
    return "".join(one), "".join(to), more


_ONE, _TO, _MORE = _decompositions()


def nfkd_ascii(c: Column) -> Column:
    """Compatibility decomposition, then only ASCII, lower-cased; exact for Latin letters, other scripts vanish."""

    def of(x: Column) -> Column:
        several = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _MORE.items())), F.lit("\x01"), F.lit("\x02"))
        rare = F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(several, ch), ch)), "")
        return F.lower(F.regexp_replace(F.when(x.rlike("[" + "".join(_MORE) + "]"), rare).otherwise(x), r"[^\x00-\x7F]", ""))

    return let(F.translate(c, _ONE, _TO), of)


def ascii_variants(part: Column) -> Column:
    """As it is, transliterated, decomposed, both."""
    return let(german_ascii(part), lambda g: F.array(part, g, nfkd_ascii(part), nfkd_ascii(g)))


def website_root(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(trim_lower(c), "^https?://", ""), r"^www\.", "")
    return F.trim(F.regexp_extract(c, "^([^/]+)", 1))


def clean_firm(c: Column) -> Column:
    c = F.regexp_replace(nfkd_ascii(F.trim(c)), "[-/]", " ")
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit("and")), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def pieces(c: Column, by: str) -> Column:
    """The non-empty pieces between single characters `by`."""
    return F.filter(F.split(c, f"[{by}]" if by != " " else " "), lambda x: x != "")


def firm_words(c: Column) -> Column:
    return F.filter(F.split(clean_firm(c), r"\s+"), lambda x: x != "")


def emails_in(text: Column, k: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(FREE_TEXT_EMAIL), F.lit(0)), 1, k)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ascii_lower(c: Column) -> Column:
    """Only A-Z are lower-cased; every other letter stays as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def to_json_list(c: Column) -> Column:
    """A list of tokens or ids as JSON text."""
    return F.to_json(c)


def from_json_list(c: Column, of: str = "string") -> Column:
    """The list that to_json_list wrote; null for what isn't a list of that type."""
    return F.from_json(c, f"array<{of}>")


def domain_by(email: Column, mode: str = "any") -> Column:
    """The two pattern forms of a domain, in their own case: all after the first @ (any), or its letters, digits, dots and hyphens
    only (plain). Null without a match."""
    return F.nullif(F.regexp_extract(email, "@(.+)$" if mode == "any" else r"@([a-zA-Z0-9.\-]+)", 1), F.lit(""))
