"""License texts and tags in documents, found by votes on diagonals. DataFrame functions only.

Every window of ``K`` words of every text is joined to the positions that its hash has in the license
templates. A hit at word i of a text and word j of a template votes for the diagonal i - j; a passage
that follows a template collects its votes on one diagonal, and on a few neighbouring ones where words
were put in or left out. Votes are summed by diagonal, neighbouring diagonals are merged, and a merged
span counts if the template positions it covers make up enough of the template.

A short phrase is its own template: all its windows must vote for one diagonal, which is the place where
it begins. Texts reach the join once: a window of sentinels keeps every row in it, hits or none, so
nothing is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import fields

K = 3
#: Diagonals at most this far apart belong to one passage.
DRIFT = 3
#: Part of a template's windows that a passage has to hold.
COVERAGE = 0.6

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices from the public texts of common licenses.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A window no text can hold: its words hold characters that words never have.
_SENTINEL = [" ", " ", " "]


@dataclass(frozen=True)
class Template:
    """A word sequence to be looked for. ``whole``: only complete, unbroken copies count."""

    name: str
    label: str
    words: tuple[str, ...]
    whole: bool


def standard_templates() -> list[Template]:
    out = [Template(f"phrase:{p}", label, tuple(p.split()), True) for p, label in PHRASES.items()]
    return out + [Template(f"notice:{label}", label, tuple(text.split()), False) for label, text in NOTICES.items()]


def template_windows(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per template window: its words, its template and position, and the template's facts.

    The templates are given by the caller, so this table has a known size: one row per template word.
    """
    rows = [(*_SENTINEL, "", "", -1, 0, False)]
    for t in templates:
        if len(t.words) < K:
            raise ValueError(f"template {t.name} has fewer than {K} words")
        for j in range(len(t.words) - K + 1):
            rows.append((*t.words[j : j + K], t.name, t.label, j, len(t.words) - K + 1, t.whole))
    schema = "t0 string, t1 string, t2 string, template string, label string, j int, windows int, whole boolean"
    return spark.createDataFrame(rows, schema).withColumn("template_hash", F.xxhash64("t0", "t1", "t2"))


def words_of(text: Column) -> Column:
    """Words of a text; null has none. Lower-casing other letters too changes no word's bounds."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def license_spans(docs: DataFrame, keep: list[str], templates: list[Template], text: str = "text") -> DataFrame:
    """``row_id, keep, template, label, whole, first_word, last_word, covered``: one row per passage found.

    ``row_id`` tells repeated rows apart; rows without a passage are absent.
    """
    hits = _hits(docs, keep, template_windows(docs.sparkSession, templates), text)
    return _passages(_diagonals(hits.where("j >= 0"), keep), keep)


def _hits(docs: DataFrame, keep: list[str], windows: DataFrame, text: str) -> DataFrame:
    w = F.col("w")
    grams = F.arrays_zip(w.alias("w0"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("w1"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("w2"))
    sentinel = F.array(F.struct(*[F.lit(s).alias(f"w{i}") for i, s in enumerate(_SENTINEL)]))
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), *keep, words_of(F.col(text)).alias("w"))
    listed = texts.select("row_id", *keep, F.size("w").cast("long").alias("n_words"), F.concat(sentinel, grams).alias("g"))
    each = listed.select("row_id", *keep, "n_words", F.posexplode("g").alias("i", "g")).select("row_id", *keep, "n_words", (F.col("i") - 1).alias("i"), "g.*")
    same = (F.xxhash64("w0", "w1", "w2") == F.col("template_hash")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    return each.join(F.broadcast(windows), same).select("row_id", *keep, "n_words", "i", "template", "label", "j", "windows", "whole")


def _diagonals(hits: DataFrame, keep: list[str]) -> DataFrame:
    """Votes per diagonal; ``seen`` lists the template positions that voted (at most the template's length)."""
    by = ["row_id", *keep, "template", "label", "windows", "whole", (F.col("i") - F.col("j")).alias("diagonal")]
    return hits.groupBy(*by).agg(F.collect_set("j").alias("seen"), F.min("i").alias("low"), F.max("i").alias("high"))


def _passages(diagonals: DataFrame, keep: list[str]) -> DataFrame:
    """Neighbouring diagonals merged to passages, those that hold too little of their template left out."""
    order = Window.partitionBy("row_id", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    # a whole phrase has one diagonal; other passages go on while the next diagonal is near and not a new copy
    begins = F.col("whole") | step.isNull() | (step > DRIFT)
    merged = diagonals.withColumn("passage", F.sum(begins.cast("int")).over(order))
    spans = merged.groupBy("row_id", *keep, "template", "label", "windows", "whole", "passage").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("found"), F.min("low").alias("first_word"), (F.max("high") + K - 1).alias("last_word")
    )
    covered = F.col("found") / F.col("windows")
    enough = F.when(F.col("whole"), F.col("found") == F.col("windows")).otherwise(covered >= COVERAGE)
    return spans.where(enough).select("row_id", *keep, "template", "label", "whole", F.col("first_word").cast("long"), F.col("last_word").cast("long"), covered.alias("covered"))


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest covered part of any template, 0 without one. Null and empty texts have no
    words and no labels. Repeated rows and ids are kept apart; an empty table gives an empty result;
    other columns are ignored. One long text's votes are at most its words times the templates' repeats.
    """
    docs = fields(docs, doc_id="long", text="string")
    keep = ["doc_id", "n_words"]
    hits = _hits(docs, ["doc_id"], template_windows(docs.sparkSession, standard_templates()), "text")
    # the sentinel row of every text passes through the same steps as a template of its own
    diagonals = _diagonals(hits.withColumn("windows", F.greatest("windows", F.lit(1))), keep)
    spans = _passages(diagonals.withColumn("whole", F.col("whole") | (F.col("template") == "")), keep)
    real, base = F.col("template") != "", F.col("whole") & (F.col("template") != "")
    told = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row_id", *keep).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        told(base).alias("base_labels"), told(real).alias("labels"), F.coalesce(F.max(F.when(real, F.col("covered"))), F.lit(0.0)).alias("score"),
    ).drop("row_id")
