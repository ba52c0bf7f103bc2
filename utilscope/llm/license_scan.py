"""License labels of text blocks: phrases, and an exact containment join with templates.

A block is a line, or a run of words whatever the line breaks in it, as hard-wrapped notices need.
A template is found in a block when the share of the template's distinct words that the block
holds reaches the threshold: an overlap of `need` words at least. Words
of all templates are ordered by the number of documents that hold them, rare ones first. A
block that meets `need` must hold one of the first `size - need + 1` words of the template
(prefix filter), hold `need` template words at all (length filter), and have enough words left
on both sides behind the first shared one (position filter). Survivors are counted exactly.
Runs are cut around each place of a prefix word, as far to both sides as the template is long, so
they are counted in their row and take no join.

Everything is Spark SQL functions; only the templates, which are parameters, are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utilscope.llm.storage import materialize
from utilscope.workspace import literal_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


# Phrases of the base labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Opening sentences of well-known licenses.
TEMPLATES = {
    "mit": [
        "released under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ],
    "apache-2": [
        "licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl-3": ["this work is licensed under the GNU General Public License, version 3"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0"],
    "cc-by": ["this work is licensed under a Creative Commons Attribution 4.0 International License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


@dataclass(frozen=True)
class Scan:
    """What to look for; `percent` is the least share of a template's distinct words."""

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in TEMPLATES.items()})
    percent: int = 90

    def __post_init__(self):
        if not "".join([*self.phrases, *(t for texts in self.templates.values() for t in texts)]).isascii():
            raise ValueError("phrases and templates are ASCII")

    def template_sets(self) -> list[tuple[str, list[str]]]:
        return [(label, sorted(set(words_of(t)))) for label, texts in self.templates.items() for t in texts]

    def reaches(self) -> list[int]:
        """For each of `template_sets`, the words that a run takes to each side of one of them.

        The template's length, repeated words too, and as many other words as `percent` lets differ.
        """
        return [-(-len(words_of(t)) * 100 // self.percent) - 1 for texts in self.templates.values() for t in texts]

    def vocabulary(self) -> list[str]:
        return sorted({w for _, words in self.template_sets() for w in words})


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _places(phrase: list[str]) -> Column:
    """Start words of a phrase in `words`; looked for only where all its words occur in `lower`."""
    held = [F.col("lower").contains(w) for w in sorted(set(phrase), key=lambda w: (-len(w), w))]
    enough = reduce(lambda a, b: a & b, held) & (F.size("words") >= len(phrase))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - len(phrase)),
        lambda i: F.slice("words", i + 1, len(phrase)) == _texts(phrase),
    )
    return F.when(enough, starts).otherwise(F.array().cast("array<int>"))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first.

    One row per vocabulary word reaches the driver; the vocabulary is a parameter.
    """
    held = docs.select(F.explode(F.array_intersect(_texts(vocabulary), "words")).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _prefix_table(scan: Scan, order: list[str]) -> list[tuple]:
    """(word, template, label, place, size, need) for the prefix words of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, words) in enumerate(scan.template_sets()):
        words = sorted(words, key=rank.__getitem__)
        need = -(-len(words) * scan.percent // 100)
        rows += [
            (w, number, label, place, len(words), need)
            for place, w in enumerate(words[:len(words) - need + 1])
        ]
    return rows


def _runs(scan: Scan, prefixes: list[tuple]) -> Column:
    """(label, share) of every template found in a run of `words` around one of the `marks`."""
    def held(words: list[str], reach: int):
        def overlap(mark: Column) -> Column:
            first = F.greatest(mark["at"] - reach, F.lit(0))
            return F.size(F.array_intersect(_texts(words), F.slice("words", first + 1, mark["at"] + reach + 1 - first)))

        return overlap

    def starts(firsts: list[str]):
        return lambda mark: mark["word"].isin(firsts)

    found = []
    for number, ((label, words), reach) in enumerate(zip(scan.template_sets(), scan.reaches())):
        own = [r for r in prefixes if r[1] == number]
        if own:
            best = F.array_max(F.transform(F.filter("marks", starts([r[0] for r in own])), held(words, reach)))
            found.append(F.when(
                best >= own[0][5], F.struct(F.lit(label).alias("label"), (best / len(words)).alias("share"))
            ))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<label:string,share:double>>")


def _lowered(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, the text in lower case (NULL as empty) and its words.

    Words sought are ASCII, so for letters beyond A-Z the case does not matter, but for the two
    whose lower case holds an ASCII letter.
    """
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    odd = data.contains("\u0130") | data.contains("\u212a")
    lower = F.when(odd, F.translate(data, UPPER, LOWER)).otherwise(F.lower(data))
    return docs.select(F.col(id).alias("id"), lower.alias("lower")).withColumn(
        "words", F.array_remove(F.split("lower", SEPARATORS), "")
    )


def scan_licenses(docs: DataFrame, scan: Scan = Scan(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with its words, phrase places, labels and score.

    `n_words`; `n_base`: places where a phrase stands; `first_word` / `last_word`: smallest and
    largest start (NULL without any); `base_labels`: labels of phrases; `labels`: those and the
    labels of templates found; `score`: 1.0 where a phrase stands, else the largest share of a
    template found in one line or run, 0.0 without any. Empty and NULL texts have no words. Every
    repeated row, also of one id, keeps a row of its own; other columns are not read.
    """
    spark = docs.sparkSession
    lowered = _lowered(docs, id, text)
    order = word_order(lowered, scan.vocabulary())
    prefixes = _prefix_table(scan, order)
    names = {"word": T.StringType(), "template": T.IntegerType(), "label": T.StringType(),
             "place": T.IntegerType(), "size": T.IntegerType(), "need": T.IntegerType()}
    table = literal_rows(spark, prefixes, T.StructType([T.StructField(n, t) for n, t in names.items()]))
    sets = F.create_map(*[
        x for number, (_, words) in enumerate(scan.template_sets()) for x in (F.lit(number), _texts(words))
    ])
    firsts = sorted({r[0] for r in prefixes})
    first_words = _texts(firsts)
    phrases = [(words_of(p), label) for p, label in scan.phrases.items()]
    found = lowered.select(
        "id", F.size("words").cast("long").alias("n_words"),
        *[_places(words).alias(f"places{i}") for i, (words, _) in enumerate(phrases)],
        F.when(F.arrays_overlap("words", first_words), F.split("lower", "\n")).alias("lines"),
        F.when(F.arrays_overlap("words", first_words), F.col("words")).alias("words"),
    ).withColumn("row", F.monotonically_increasing_id()).withColumn("marks", F.array_compact(F.transform(
        "words", lambda w, at: F.when(w.isin(firsts), F.struct(at.alias("at"), w.alias("word")))
    )))
    starts = F.flatten(F.array(*[F.col(f"places{i}") for i in range(len(phrases))]))
    labels = F.array(*[F.when(F.size(f"places{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])
    blocks = F.transform("lines", lambda line: F.array_intersect(_texts(order), F.split(line, SEPARATORS)))
    rows = materialize(found.select(
        "row", "id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
        F.filter(blocks, lambda b: F.arrays_overlap(b, first_words)).alias("blocks"),
        _runs(scan, prefixes).alias("runs"),
    ))
    held = rows.select("row", F.posexplode(F.array_distinct("blocks")).alias("block", "tokens"))
    shared = held.select("row", "block", "tokens", F.posexplode("tokens").alias("at", "word")).join(
        F.broadcast(table), "word"
    )
    first = shared.groupBy("row", "block", "template", "label", "size", "need").agg(
        F.min("place").alias("place"), F.min("at").alias("at"), F.first("tokens").alias("tokens")
    )
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("tokens") - F.col("at") - 1)
    overlap = F.size(F.array_intersect("tokens", sets[F.col("template")]))
    hits = (
        first.where((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
        .withColumn("overlap", overlap).where("overlap >= need")
    )
    by_row = hits.groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("share")
    )
    merged = F.array_union(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))), F.col("runs.label"))
    share = F.coalesce(F.greatest("share", F.array_max(F.col("runs.share"))), F.lit(0.0))
    return rows.join(by_row, "row", "left").select(
        F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(merged), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
