r"""License scans: diagonal voting of rolling word k-grams against template positions.

The whole text is lower-cased (A-Z) and cut into words. Every rolling k-gram's hash is joined to the k-grams of the
templates; a hit votes for the diagonal (position in the document - position in the template). Votes are summed by
diagonal, neighbouring diagonals of a longer template (a word inserted or left out) merge into bands, and bands with enough
votes are verified: a span is a run of places at which the template's words come in their order, and it is kept if it has
enough of the template's k-grams and isn't too long. A base phrase needs all votes on one diagonal, which is the same as its
words standing consecutively.

Scale: the k-grams are exploded and joined within the task that read the document; only hits and one marker row a document
are shuffled, by row. The templates are broadcast only if Spark finds them under its own threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, few_files, literal_table, table

#: (label, words): every place counts.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Fixed values, (label, words): the method's own, sentences by which licenses are known, found in whole or in good part.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, MIN_SHARE, MAX_GAP = 2, 0.75, 3


def template_grams(base=BASE, templates=TEMPLATES, k: int = K) -> list[tuple]:
    """(tid, is_base, label, grams of the template, position, the k words)."""
    out = []
    for tid, (label, words) in enumerate([*base, *templates]):
        w = words.split()
        if len(w) < k:
            raise ValueError(f"{words!r} has fewer than {k} words")
        out += [(tid, tid < len(base), label, len(w) - k + 1, p, *w[p : p + k]) for p in range(len(w) - k + 1)]
    return out


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES, min_share: float = MIN_SHARE, max_gap: int = MAX_GAP, k: int = K) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and largest of their starts (null
    if none). labels has the base labels and those of the other templates; score is the largest share of a template's k-grams
    in a kept span, 0 without one. A null text counts as empty; a text without words gives zeros, empty label strings and
    nulls; a very long text is scanned whole. Repeated rows and equal or null ids are scanned row by row; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = [f"w{i}" for i in range(k)]
    rows = [(-1, False, "", 0, 0, *[""] * k), *template_grams(base, templates, k)]
    grams = literal_table(spark, ("tid", "is_base", "label", "n_grams", "tpos", *(f"t{w}" for w in ws)), rows).withColumn("h", F.xxhash64(*(f"t{w}" for w in ws)))
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    rolling = F.arrays_zip(*[(F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) if i else F.col("words")).alias(w) for i, w in enumerate(ws)])
    # The empty k-gram marks the document, so that one without a hit keeps its row.
    marked = F.concat(rolling, F.array(F.struct(*[F.lit("").alias(w) for w in ws])))
    g = d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(marked).alias("pos", "g"))
    g = g.select("row", "doc_id", "n_words", "pos", *[F.col(f"g.{w}").alias(w) for w in ws]).withColumn("h", F.xxhash64(*ws))
    hits = g.join(grams, "h").where(" AND ".join(f"{w} = t{w}" for w in ws))
    template = ["row", "doc_id", "n_words", "tid", "is_base", "label", "n_grams"]
    # A diagonal meets each of the template's positions once.
    votes = hits.groupBy(*template, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_list("pos").alias("places"))
    w = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("tid") < 0) | (F.col("diagonal") - F.lag("diagonal").over(w) > max_gap)
    merged = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("apart").over(w))
    merged = merged.withColumn("votes", F.sum(F.size("places")).over(Window.partitionBy("row", "tid", "band")))
    share = lambda c: F.when(F.col("tid") < 0, True).when(F.col("is_base"), F.col(c) == F.col("n_grams")).otherwise(F.col(c) >= F.lit(min_share) * F.col("n_grams"))
    # In a band of diagonals a span is a run of places with the template's words in their order.
    placed = merged.where(share("votes")).select(*template, "band", "diagonal", F.explode("places").alias("pos"))
    along = Window.partitionBy("row", "tid", "band").orderBy("pos", F.col("pos") - F.col("diagonal"))
    at = F.col("pos") - F.col("diagonal")
    goes_on = (at > F.lag(at).over(along)) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) <= max_gap)
    runs = placed.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("span", F.sum("starts").over(along))
    spans = runs.groupBy(*template, "band", "span").agg(F.count("*").alias("seen"), F.min("pos").alias("lo"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    kept = (F.col("tid") >= 0) & share("seen") & (F.col("is_base") | (F.col("length") <= 2 * F.col("n_grams")))
    spans = spans.withColumn("kept", kept).withColumn("base", F.col("kept") & F.col("is_base"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c), F.col("label")))), ",")
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("lo").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("lo").cast("long"))).alias("last_word"),
        joined("base").alias("base_labels"),
        joined("kept").alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("seen") / F.col("n_grams"))), F.lit(0.0)).alias("score"),
    )
    return few_files(found.drop("row"), docs)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH grams(tid, is_base, label, n_grams, tpos, tw, tn) AS (VALUES {", ".join(str(g) for g in template_grams())}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
g AS (SELECT r, pos - 1 AS pos, words[pos] AS w, words[pos + 1] AS n FROM (SELECT r, words, unnest(range(1, len(words))) AS pos FROM d)),
votes AS (
  SELECT g.r, t.tid, t.is_base, t.label, t.n_grams, g.pos - t.tpos AS diagonal, list(g.pos) AS places
  FROM g JOIN grams t ON g.w = t.tw AND g.n = t.tn GROUP BY ALL),
apart AS (
  SELECT *, CASE WHEN is_base THEN 1 WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tid ORDER BY diagonal) <= {MAX_GAP} THEN 0 ELSE 1 END AS a FROM votes),
bands AS (SELECT *, sum(a) OVER (PARTITION BY r, tid ORDER BY diagonal) AS band FROM apart),
heard AS (SELECT *, sum(len(places)) OVER (PARTITION BY r, tid, band) AS votes FROM bands),
placed AS (
  SELECT r, tid, is_base, label, n_grams, band, diagonal, unnest(places) AS pos FROM heard
  WHERE CASE WHEN is_base THEN votes = n_grams ELSE votes >= {MIN_SHARE} * n_grams END),
runs AS (
  SELECT *, CASE WHEN pos - diagonal > lag(pos - diagonal) OVER along AND abs(diagonal - lag(diagonal) OVER along) <= {MAX_GAP} THEN 0 ELSE 1 END AS s FROM placed
  WINDOW along AS (PARTITION BY r, tid, band ORDER BY pos, pos - diagonal)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY r, tid, band ORDER BY pos, pos - diagonal) AS span FROM runs),
spans AS (
  SELECT r, tid, is_base, label, n_grams, band, span, count(*) AS seen, min(pos) AS lo, max(pos) - min(pos) + 1 AS length
  FROM numbered GROUP BY ALL),
kept AS (
  SELECT * FROM spans WHERE CASE WHEN is_base THEN seen = n_grams ELSE seen >= {MIN_SHARE} * n_grams AND length <= 2 * n_grams END),
found AS (
  SELECT r, count(*) FILTER (is_base) AS n_base, min(lo) FILTER (is_base) AS first_word, max(lo) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(seen / n_grams) AS score
  FROM kept GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(f.n_base, 0) AS n_base, CAST(f.first_word AS BIGINT) AS first_word,
       CAST(f.last_word AS BIGINT) AS last_word, coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels, coalesce(f.score, 0.0) AS score
FROM d LEFT JOIN found f ON d.r = f.r
"""
