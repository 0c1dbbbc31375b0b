"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block is a window of consecutive words, whatever lines they stand on; a template of m words has windows of
SLACK * m words, or the whole text where it is shorter. A block meets a template when it holds at least `threshold` of
the template's distinct words.
The words of all templates are ordered by their frequency over all documents, rarest first. A block that meets a
template of n words lacks at most n - ceil(threshold * n) of them, so it holds one of the template's first
n - ceil(threshold * n) + 1 words: these alone are joined (prefix filter). A block with too few distinct words for a
template goes (length filter); at a shared word at place i of the template's order, only the words from i on and those
before it can still be shared, so a first shared word that lies too far back ends the pair (positional filter). What is
left is counted exactly: of the windows around a word of the prefix, the first of those that share most. The templates are a fixed, small table; it is the only side that is broadcast.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. The base labels come from phrases
whose words stand consecutively anywhere in the text, also across lines.

Defined results: null or empty texts have no words, no labels and score 0; a text with base labels has score 1, any
other the largest containment of a template it meets, else 0; ties of templates change nothing, as all that are met are
listed; rows that repeat an id or have none are each judged by their own text; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linelake.llm.common import table, text_hash

THRESHOLD = 0.9

#: Words of a block for each word of the template that it is held against.
SLACK = 1.5

#: Phrases (words) and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates: label and text of a license line.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("public-domain", "This work has been dedicated to the public domain"),
    ("reserved", "Copyright. All rights reserved."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
_BARE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of text in any case


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between them and none around."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _SEPARATORS, " "))


def words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def window_sizes(templates=TEMPLATES) -> dict[int, int]:
    """Words of a block by the template's number."""
    return {i: math.ceil(SLACK * len(re.sub(_SEPARATORS, " ", text.lower()).split())) for i, (_, text) in enumerate(templates)}


def template_words(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(set(re.sub(_SEPARATORS, " ", text.lower()).split()))) for i, (label, text) in enumerate(templates)]


def _folded(line: str) -> Column:
    """Words of a line, quickly: a superset of the exact words where they are ASCII."""
    return F.split(F.lower(line), _SEPARATORS, -1)


def frequencies(docs: DataFrame, templates) -> dict[str, int]:
    """How often each word of the templates stands in all texts."""
    known = sorted({w for _, _, own in templates for w in own})
    counted = docs.select(F.explode(_folded("text")).alias("word")).filter(F.col("word").isin(known)).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}  # at most a row per template word


def ordered(templates, frequency: dict[str, int]) -> list[tuple[int, str, list[str]]]:
    return [(i, label, sorted(own, key=lambda w: (frequency.get(w, 0), w))) for i, label, own in templates]


def _needs(templates, threshold: float) -> dict[int, int]:
    return {i: max(1, math.ceil(threshold * len(own) - 1e-9)) for i, _, own in templates}


def _index(spark: SparkSession, templates, threshold: float, sizes: dict[int, int] | None = None) -> tuple[DataFrame, list[str]]:
    """The words of all prefixes with their templates, as a table and as a list."""
    need = _needs(templates, threshold)
    prefix = [(w, i, label, own, at, len(own), need[i], (sizes or {}).get(i, 0)) for i, label, own in templates for at, w in enumerate(own[: len(own) - need[i] + 1])]
    return spark.createDataFrame(prefix, "token string, template int, label string, own array<string>, at int, n int, need int, wide int"), sorted({x[0] for x in prefix})


def windows_met(texts: DataFrame, keys: list[str], templates, sizes: dict[int, int], threshold: float = THRESHOLD) -> DataFrame:
    """keys, template, label, start (word number), wide, shared, containment of windows that meet a template: for each
    word of a template's prefix in a text, the first of the windows around it that share most. texts: keys and `w`, the words."""
    index, rare = _index(texts.sparkSession, templates, threshold, sizes)
    most = max(sizes.values())
    known = F.array(*map(F.lit, rare))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(known, F.get("w", i)))
    around = F.transform(places, lambda i: F.struct(i.alias("p"), F.get("w", i).alias("token"), F.greatest(i - (most - 1), F.lit(0)).alias("low"), F.slice("w", F.greatest(i - (most - 1), F.lit(0)) + 1, 2 * most - 1).alias("region")))
    anchors = texts.filter(F.size("w") > 0).select(*keys, F.explode(around).alias("a")).select(*keys, "a.*")
    met = anchors.join(F.broadcast(index), "token")
    # the part of the region that windows of this template reach
    low = F.greatest(F.col("p") - F.col("wide") + 1, F.lit(0))
    met = met.withColumn("first", low).withColumn("region", F.slice("region", F.col("first") - F.col("low") + 1, F.col("wide") * 2 - 1))
    met = met.filter(F.size(F.array_intersect("own", "region")) >= F.col("need"))
    met = met.filter(F.col("n") - F.col("at") + F.size(F.array_intersect(F.slice("own", F.lit(1), F.col("at")), "region")) >= F.col("need"))
    shared = F.transform(F.sequence(F.col("first"), F.col("p")), lambda s: F.struct((-F.size(F.array_intersect("own", F.slice("region", s - F.col("first") + 1, F.col("wide"))))).alias("less"), s.alias("start")))
    best = met.withColumn("best", F.array_min(shared)).withColumn("shared", -F.col("best.less")).filter(F.col("shared") >= F.col("need"))
    return best.select(*keys, "template", "label", F.col("best.start").alias("start"), "wide", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def contained(blocks: DataFrame, keys: list[str], templates, threshold: float = THRESHOLD) -> DataFrame:
    """keys, template, label, shared, containment of each pair of a block and a template that it meets. blocks: keys
    and `tokens`, an array of distinct words. templates: (number, label, distinct words in the global order)."""
    index, rare = _index(blocks.sparkSession, templates, threshold)
    held = blocks.withColumn("hits", F.array_intersect("tokens", F.array(*map(F.lit, rare)))).filter(F.size("hits") > 0)
    pairs = (
        held.select(*keys, "tokens", F.explode("hits").alias("token"))
        .join(F.broadcast(index), "token")
        .filter(F.size("tokens") >= F.col("need"))
        .filter(F.col("n") - F.col("at") + F.size(F.array_intersect(F.slice("own", F.lit(1), F.col("at")), "tokens")) >= F.col("need"))
    )
    first = pairs.filter(F.size(F.array_intersect(F.slice("own", F.lit(1), F.col("at")), "tokens")) == 0)  # a pair once, at its first shared word
    exact = first.withColumn("shared", F.size(F.array_intersect("own", "tokens"))).filter(F.col("shared") >= F.col("need"))
    return exact.select(*keys, "template", "label", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def base_places(w: str, phrase: str) -> Column:
    """Word numbers at which the phrase begins; w: a column of words."""
    parts = phrase.split()
    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: reduce(lambda a, b: a & b, [F.get(w, i + k) == p for k, p in enumerate(parts)]))


def count_words(text: Column) -> Column:
    pieces = F.size(F.split(text, f"{_BARE}+", -1))
    outer = text.rlike(f"^{_BARE}").cast("int") + text.rlike(f"{_BARE}\\z").cast("int")
    return F.when(text == "", 0).otherwise(pieces - outer).cast("long")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: n_words, n_base, first_word, last_word, base_labels and labels (arrays), score, blocks
    (number of the first word, words, label and containment of the windows of windows_met)."""
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc_id"), text_hash(text).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    rows = template_words(templates)
    rows = ordered(rows, frequencies(own, rows))
    need = _needs(rows, threshold)
    rare = sorted({w for i, _, o in rows for w in o[: len(o) - need[i] + 1]})
    some = own.filter(F.arrays_overlap(_folded("text"), F.array(*map(F.lit, rare)))).select("doc_id", "hash", words(spaced(F.col("text"))).alias("w"))
    met = windows_met(some, ["doc_id", "hash"], rows, window_sizes(templates), threshold)
    met = met.groupBy("doc_id", "hash").agg(F.collect_set("label").alias("met"), F.max("containment").alias("most"), F.sort_array(F.collect_set(F.struct("start", "wide", "label", "containment"))).alias("blocks"))

    # a sieve on the bare text, so that few texts are split into a column of words
    sieve = F.col("text").rlike("(?i)" + "|".join(f"{_BARE}+".join(p.split()) for p in phrases))
    none = F.array().cast("array<string>")
    held = own.select("doc_id", "hash", count_words(F.col("text")).alias("n_words"), F.when(sieve, words(spaced(F.col("text")))).otherwise(none).alias("w"))
    places = [F.when(F.size("w") > 0, base_places("w", p)).otherwise(F.array().cast("array<int>")) for p in phrases]
    held = held.select("doc_id", "hash", "n_words", *[x.alias(f"p{k}") for k, x in enumerate(places)])
    held = held.select("doc_id", "hash", "n_words", F.concat(*[f"p{k}" for k in range(len(places))]).alias("places"), F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())])).alias("base"))
    # what a row meets is decided by its text, so the join asks for both, the id and the text
    met = met.withColumnsRenamed({"doc_id": "met_id", "hash": "met_hash"})
    both = held.join(met, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("hash") == F.col("met_hash")), "left")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("base")).alias("base_labels"), F.array_sort(F.array_union("base", F.coalesce("met", none))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"), "blocks",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
