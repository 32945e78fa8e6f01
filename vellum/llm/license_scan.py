"""Operator 4, license scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a line, or a run of consecutive words a quarter longer than the template whatever line breaks stand between them
(a notice may be wrapped), as the set of its words. It matches a template if it holds at least ``containment`` of the template's
words. The words of all templates are counted over the whole corpus and each template is ordered by them, rarest first. A
matching block must hold one of the template's first |T| - need + 1 words (prefix filter) and have at least ``need`` words
(length filter). The words of all templates have a rank in that order; a line is also held as its sorted ranks, and where the first
word it shares with a template's prefix stands in both says how many more they can share (positional filter).
A document without a prefix word of any template, nearly all, is left after one search; only in the others are blocks made
and compared. The templates are a list of bounded size, so the join needs no shuffle; only their words' counts (a row for
each word) are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Phrases and the labels they stand for.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices by which licenses are commonly stated: (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
MAX_TEMPLATES = 500
SLACK = 4  # a run of words has 1 / SLACK more of them than the template: comment marks may stand between its lines
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return sorted(set(re.split(_NOT_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))) - {""})


def need(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def run_length(text: str) -> int:
    """Words of the runs that are compared with a template."""
    n = len([w for w in re.split(_NOT_WORD, text.translate(str.maketrans(_UPPER, _LOWER))) if w])
    return n + n // SLACK


def plain(text: Column) -> Column:
    """Words, A-Z lower-cased, with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NOT_WORD, " "))


def word_counts(texts: DataFrame, words: Sequence[str]) -> DataFrame:
    """How often each of ``words`` stands in the corpus (column plain)."""
    return texts.select(F.explode(F.split("plain", " ")).alias("word")).where(F.col("word").isin(list(words))).groupBy("word").count()


def license_scan(docs: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases and templates of licenses in each text.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and last_word (smallest and largest start of one, or
    null), base_labels, labels (with the templates'; both distinct, sorted, joined by commas) and score: 1 where a phrase
    stands, else the largest containment that reaches ``percent``, else 0. Null counts as empty: no words, empty labels, 0.
    Repeated and null ids keep their rows. Other columns are ignored. At most MAX_TEMPLATES templates: their words go
    into the plan (more are scanned in several calls).
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates a call")
    sets = [(label, template_words(text), run_length(text)) for label, text in templates]
    sets = [(label, words, need(len(words), percent), run) for label, words, run in sets if words]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    vocabulary = sorted({w for _, words, _, _ in sets for w in words})
    counted = {r["word"]: r["count"] for r in word_counts(base.select(plain(F.col("text")).alias("plain")), vocabulary).collect()}  # a row for each word of the templates
    ordered = [(label, sorted(words, key=lambda w: (counted.get(w, 0), w)), n, run) for label, words, n, run in sets]

    double = F.concat(F.lit(" "), F.replace(F.col("plain"), F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has a space of its own on both sides
    rows = base.withColumn("plain", plain(F.col("text"))).withColumn("padded", double)
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("n_words", n_words.cast("long"))

    counts, firsts, lasts, marks = [], [], [], []
    for phrase, label in PHRASES:
        inside = " " + phrase.replace(" ", "  ") + " "
        n = ((F.length("padded") - F.length(F.replace(F.col("padded"), F.lit(inside), F.lit("")))) / len(inside)).cast("long")
        there = F.contains(F.col("padded"), F.lit(inside))
        words_of = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
        before, behind = F.substring_index("padded", inside, 1), F.substring_index("padded", inside, -1)
        counts.append(F.when(there, n).otherwise(0))
        firsts.append(F.when(there, words_of(before)))
        lasts.append(F.when(there, F.col("n_words") - words_of(behind) - len(phrase.split(" "))))
        marks.append(F.when(there, F.lit(label)))

    prefixes = sorted({w for _, words, n, _ in ordered for w in words[: len(words) - n + 1]})
    # every template against the blocks of a row: (label, containment) of those that match
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    listed = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.array(*[F.lit(rank[w]) for w in words]).alias("ranks"), F.array(*[F.lit(rank[w]) for w in words[: len(words) - n + 1]]).alias("first"), F.array(*map(F.lit, words[: len(words) - n + 1])).alias("prefix"), F.lit(n).alias("need"), F.lit(run).alias("run")) for label, words, n, run in ordered])
    blocks = F.transform(F.split(F.col("text"), "\n"), lambda line: F.array_distinct(F.split(plain(line), " ")))
    blocks = F.filter(blocks, lambda b: (F.size(b) >= min(n for _, _, n, _ in ordered)) & F.arrays_overlap(b, F.array(*map(F.lit, prefixes))))
    blocks = F.transform(blocks, lambda b: F.array_sort(F.filter(F.transform(b, lambda w: F.try_element_at(ranks, w)), lambda r: r.isNotNull())))

    def held(block: Column, t: Column) -> Column:
        shared = F.array_min(F.array_intersect(t["first"], block))  # the first word of the prefix that the block has
        left = F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], shared), F.size(block) - F.array_position(block, shared)) + 1
        return F.when((F.size(block) >= t["need"]) & (left >= t["need"]), F.size(F.array_intersect(t["ranks"], block))).otherwise(0)

    # the places of prefix words; every run that matches holds one, so only runs around them are looked at
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(F.array(*map(F.lit, prefixes)), w), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())

    def runs(t: Column) -> Column:
        """The most words of the template that a run around one of its prefix words holds."""
        near = F.filter(F.col("places"), lambda p: F.array_contains(t["prefix"], p["word"]))
        first = lambda p: F.greatest(p["at"] - t["run"] + 1, F.lit(0))
        common = lambda start, n: F.size(F.array_intersect(t["words"], F.slice("words", start + 1, n)))
        near = F.filter(near, lambda p: common(first(p), p["at"] - first(p) + t["run"]) >= t["need"])
        return F.array_max(F.transform(near, lambda p: F.array_max(F.transform(F.sequence(first(p), p["at"]), lambda i: common(i, t["run"])))))

    best = F.transform(listed, lambda t: F.struct(t["label"].alias("label"), F.greatest(F.array_max(F.transform(F.col("blocks"), lambda b: held(b, t))), runs(t)).alias("held"), F.size(t["words"]).alias("size"), t["need"].alias("need")))
    matched = F.filter(best, lambda m: m["held"] >= m["need"])
    some_prefix = reduce(lambda a, b: a | b, [F.contains(F.col("padded"), F.lit(f" {w} ")) for w in prefixes])
    kind = "array<struct<label:string,held:int,size:int,need:int>>"
    rows = rows.withColumn("blocks", F.when(some_prefix, blocks)).withColumn("words", F.when(some_prefix, F.split("plain", " "))).withColumn("places", places).withColumn("matched", F.when(F.col("blocks").isNotNull(), matched).otherwise(F.array().cast(kind)))
    labels = lambda items: F.array_join(F.array_sort(F.array_distinct(items)), ",")
    base_labels = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return rows.select(
        "doc_id",
        "n_words",
        reduce(lambda a, b: a + b, counts).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        labels(base_labels).alias("base_labels"),
        labels(F.concat(base_labels, F.transform("matched", lambda m: m["label"]))).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matched", lambda m: m["held"].cast("double") / m["size"])), F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The definition, without any filter: every line against every template, every place against every phrase."""
    sets = [(label, template_words(text)) for label, text in TEMPLATES]
    lists = ", ".join(f"('{label}', {words!r}, {need(len(words), 90)})" for label, words in sets)
    places = " UNION ALL ".join(
        "SELECT doc_id, i - 1 AS pos, '{}' AS label FROM w, range(1, len(words) + 1) t(i) WHERE {}".format(label, " AND ".join(f"words[i{f' + {j}' if j else ''}] = '{w}'" for j, w in enumerate(p.split(" ")))) for p, label in PHRASES
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM d),
p AS ({places}),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM p GROUP BY doc_id),
t(label, tw, need) AS (VALUES {lists}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
sets AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(translate(line, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS s FROM lines),
m AS (SELECT doc_id, label, len(list_intersect(tw, s)) / len(tw) AS share FROM sets, t WHERE len(list_intersect(tw, s)) >= need),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(g.more, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(g.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id
"""


QUERIES = {"op4_license_scan": op4_license_scan}
SQL = {"op4_license_scan": _sql()}
