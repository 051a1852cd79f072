"""String similarities: indel ratio by a longest-common-subsequence fold, its token-sorted form, Ratcliff-Obershelp."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence, one row of the table at a time."""
    n = F.length(b)

    def row(old: Column, ch: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            best = F.when(F.substring(b, j, F.lit(1)) == ch, F.get(old, j - 1) + 1).otherwise(F.greatest(F.get(old, j), F.get(new, j - 1)))
            return F.concat(new, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (n == 0), 0).otherwise(F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), n + 1), row), -1))


def ratio(a: Column, b: Column) -> Column:
    """Normalised indel similarity from 0 to 100; 100 for two empty strings."""

    def of(x: Column) -> Column:
        both = F.length(x["a"]) + F.length(x["b"])
        return F.when(both == 0, 100.0).otherwise(200.0 * lcs_length(x["a"], x["b"]) / both)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


#: Characters of a text whose places fit into one number.
MASK_BITS = 62


def masks(a: Column) -> Column:
    """map<character, places>: a number with the bits of the places at which a, of at most MASK_BITS characters, has it."""

    def of(chars: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        places = lambda c: F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))
        return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, places(c))))

    return let(F.filter(F.split(a, ""), lambda x: x != ""), of)


def masked_ratio(a: Column, a_masks: Column, b: Column) -> Column:
    """ratio(a, b), with the masks of a made beforehand: one step a character of b, all of a at once, for an a of at most MASK_BITS
    characters; ratio itself for a longer one."""
    full = (1 << MASK_BITS) - 1

    def step(v: Column, ch: Column) -> Column:
        return let(v.bitwiseAND(F.coalesce(F.try_element_at(a_masks, ch), F.lit(0).cast("long"))), lambda met: (v + met).bitwiseOR(v - met).bitwiseAND(F.lit(full)))

    end = F.aggregate(F.filter(F.split(b, ""), lambda x: x != ""), F.lit(full), step)
    common = MASK_BITS - F.bit_count(end)
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).when(F.length(a) <= MASK_BITS, 200.0 * common / both).otherwise(ratio(a, b))


def sort_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sort_tokens(a), sort_tokens(b))


def _ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio() * 100, 1) for x, y in zip(a, b)])


def ratcliff_ratio(a, b) -> Column:
    """Ratcliff-Obershelp ratio times 100, to one decimal; there is no expression for its recursive matching blocks."""
    return F.pandas_udf(_ratcliff, "double")(a, b)
