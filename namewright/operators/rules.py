"""Sequential rules X => Y with a window, and their text form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RULE = r"^\s*(\d[\d,\s]*?)\s*==>\s*(\d[\d,\s]*?)\s*#SUP:\s*(\d+)\s*#CONF:\s*([0-9.]+)\s*$"


def _shapes(window: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Offsets of the left and right items, the first at 0, all left ones before all right ones, within the window."""
    out = []
    for n in range(2, window + 1):
        for rest in combinations(range(1, window), n - 1):
            at = (0, *rest)
            out += [(at[:k], at[k:]) for k in range(1, n)]
    return out


def mine_rules(seqs: DataFrame, min_support: float = 0.01, min_confidence: float = 0.01, window: int = 3, tokens: str = "token_seq") -> DataFrame:
    """(lhs, rhs, support, confidence): rules whose left items all come before the right ones within `window` positions.

    Support counts sequences; confidence divides by the sequences that hold all left items. Sides are sets, written sorted.
    A sequence's rules are enumerated in its own row and counted once, so only (rule, count) is shuffled.
    """
    # Equal sequences are counted together first.
    s = seqs.where(F.col(tokens).isNotNull()).groupBy(F.col(tokens).alias("seq")).agg(F.count("*").alias("times"))
    total = s.agg(F.sum("times").alias("total"))
    shapes = _shapes(window)
    pick = lambda i, at: F.array_sort(F.array_distinct(F.array(*[F.get(F.col("seq"), i + o) for o in at])))
    starts = F.sequence(F.lit(0), F.size("seq") - 1)
    fitting = [_rules_of(starts, left, right, pick) for left, right in shapes]
    rows = s.where("size(seq) > 1").select("times", F.explode(F.array_distinct(F.concat(*fitting))).alias("r")).select("times", "r.lhs", "r.rhs")
    rules = rows.groupBy("lhs", "rhs").agg(F.sum("times").alias("support"))
    rules = rules.join(F.broadcast(total), F.lit(True)).where(F.col("support") >= F.ceil(F.col("total") * min_support))
    # Distinct left sides are a few hundred; they go to the distinct sequences.
    sides = rules.select("lhs").distinct()
    held = s.join(F.broadcast(sides), F.size(F.array_except("lhs", "seq")) == 0).groupBy("lhs").agg(F.sum("times").alias("held"))
    out = rules.join(held, "lhs").select("lhs", "rhs", "support", (F.col("support") / F.col("held")).alias("confidence"))
    return out.where(F.col("confidence") >= min_confidence)


def _rules_of(starts, left, right, pick):
    made = F.transform(starts, lambda i: F.struct(pick(i, left).alias("lhs"), pick(i, right).alias("rhs")))
    whole = lambda r: (F.size(F.array_compact(r["lhs"])) == len(left)) & (F.size(F.array_compact(r["rhs"])) == len(right)) & ~F.arrays_overlap(r["lhs"], r["rhs"])
    return F.filter(made, lambda r: F.coalesce(whole(r), F.lit(False)))


def parse_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lhs, rhs as ids, support, confidence) of lines 'a,b ==> c #SUP: n #CONF: f'; others are skipped."""
    ids = lambda k: F.transform(F.split(F.regexp_extract(column, _RULE, k), r"\s*,\s*"), lambda x: F.trim(x).try_cast("long"))
    return lines.where(F.col(column).rlike(_RULE)).select(ids(1).alias("lhs"), ids(2).alias("rhs"), F.regexp_extract(column, _RULE, 3).cast("long").alias("support"), F.regexp_extract(column, _RULE, 4).cast("double").alias("confidence"))


def decode_rules(rules: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rules over ids as rules over tokens. The vocabulary is one map."""
    m = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token_id", "token"))).alias("m"))
    word = lambda c: F.transform(c, lambda x: F.try_element_at(F.col("m"), x))
    return rules.join(F.broadcast(m), F.lit(True)).select(word(F.col("lhs")).alias("lhs"), word(F.col("rhs")).alias("rhs"), "support", "confidence")


def interchange_lines(encoded: DataFrame, column: str = "encoded") -> DataFrame:
    """Sequences as 'a -1 b -1 -2' lines."""
    return encoded.select(F.concat(F.array_join(F.transform(column, lambda x: F.concat(x.cast("string"), F.lit(" -1 "))), ""), F.lit("-2")).alias("value"))
