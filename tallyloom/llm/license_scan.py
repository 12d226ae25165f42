"""License scan by diagonal voting: DataFrame expressions only.

Words: ASCII capitals lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. All rolling hashes of `k` words of every
document are joined with the places of the templates' own; a match at document word p and template word q votes for the
diagonal p - q of that template. Votes are counted by diagonal (few rows, combined before the shuffle), neighbouring
diagonals at most `slack` apart are merged, which bridges words put in or left out, and a merged run is verified: all k
words of each vote are equal, not hashes alone, it holds at least `coverage` of the template's places, each counted once, and it
is no longer than the template by more than `stretch`. A verified run gives its label unless it overlaps one of another label
that covers more of its own template: the notices of a family differ by a word only. The templates are the constants below,
so the broadcast side is of fixed size.

The score is the share of the best run's template, 0 without any. Labels are those of verified runs and the base
phrases' ("mit license", "apache license", "general public license").

Cases. Null or empty text: no words, no labels, score 0. Rows that repeat doc_id and text share their votes and each get
the result. Null doc_id: as any other. Capitals outside ASCII are lower-cased too for matching; none of them turns into
a letter of a phrase or template (the Kelvin sign is kept from it). Very long texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import kept, let

#: Phrases that give a base label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and wording of well-known notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


#: Words of a cell in which overlapping runs meet.
CELL = 128


@dataclass(frozen=True)
class LicenseParams:
    k: int = 3
    slack: int = 3
    coverage: float = 0.6
    stretch: float = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(ws: Column, k: int, among: list[int] | None = None) -> Column:
    """(pos, hash, gram) of every run of k words; gram has them, parted by spaces. among: only those with one of these hashes, so
    few texts are put together."""
    places = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    of = lambda i: [F.get(ws, i + j) for j in range(k)]
    if among is not None:
        places = F.filter(places, lambda i: F.xxhash64(*of(i)).isin(among))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(*of(i)).alias("hash"), F.concat_ws(" ", *of(i)).alias("gram")))


def template_grams(spark, p: LicenseParams) -> DataFrame:
    """template, label, t_grams (its places, 63 at most), t_pos, hash and t_gram."""
    rows = [(i, label, re.findall(r"[a-z0-9]+", text.lower())) for i, (label, text) in enumerate(TEMPLATES)]
    if max(len(ws) for _, _, ws in rows) - p.k + 1 > 63:
        raise ValueError("the places of a template are bits of a 64-bit integer")
    t = spark.createDataFrame(rows, "template int, label string, ws array<string>")
    return t.select("template", "label", (F.size("ws") - p.k + 1).alias("t_grams"), F.inline(_grams(F.col("ws"), p.k))).withColumnsRenamed({"pos": "t_pos", "gram": "t_gram"})


def license_runs(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """Merged diagonals: doc_id, text_hash, template, label, first and last (words, inclusive), coverage and verified."""
    templates = template_grams(docs.sparkSession, p)
    # fixed by the templates, at most 63 for each
    among = [r["hash"] for r in templates.select("hash").distinct().collect()]
    grams = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.explode(F.transform(F.array(words_of(F.col("text"))), lambda ws: _grams(ws, p.k, among))).alias("g"))
    grams = grams.select("doc_id", "text_hash", F.inline("g"))
    votes = grams.join(F.broadcast(templates), "hash").filter(F.col("gram") == F.col("t_gram"))
    row = ["doc_id", "text_hash", "template"]
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("t_pos"))
    by_diagonal = votes.groupBy(*row, "label", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.bit_or(place).alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    along = Window.partitionBy(*row).orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > p.slack, F.lit(True)).cast("int")
    runs = by_diagonal.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along)).groupBy(*row, "label", "t_grams", "run").agg(
        (F.bit_count(F.bit_or("places")) / F.first("t_grams")).alias("coverage"), F.min("first").alias("first"), (F.max("last") + p.k - 1).alias("last")
    )
    length, whole = F.col("last") - F.col("first") + 1, F.col("t_grams") + p.k - 1
    return runs.withColumn("verified", (F.col("coverage") >= p.coverage) & (length <= whole * (1 + p.stretch) + p.slack))


def _outdone(runs: DataFrame) -> DataFrame:
    """Verified runs that overlap a verified run of another label and better coverage: doc_id, text_hash, template, run.

    Runs meet in cells of CELL words, so a text that repeats its notices makes no pair of each two of them."""
    cells = runs.filter("verified").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
    a, b = cells.alias("a"), cells.alias("b")
    meet = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & (F.col("a.cell") == F.col("b.cell"))
    worse = (F.col("a.label") != F.col("b.label")) & (F.col("a.coverage") < F.col("b.coverage")) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    return a.join(b, meet & worse, "left_semi").select("doc_id", "text_hash", "template", "run").distinct()


def _phrases(ws: Column) -> Column:
    """(start, label) of every place of a base phrase, found by its last word."""
    phrases = [(phrase.split(), label) for phrase, label in PHRASES.items()]
    lasts = sorted({words[-1] for words, _ in phrases})

    def found(i: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,label:string>")
        for words, label in phrases:
            k = len(words) - 1
            here = F.lit(True)
            for j, w in enumerate(words):
                here = here & (F.coalesce(F.get(ws, i - k + j), F.lit("")) == w)
            out = F.when(here, F.struct((i - k).cast("int").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(lasts), i)), lambda i: i.isNotNull())
    return F.filter(F.transform(at, found), lambda x: x.isNotNull())


def license_scan(docs: DataFrame, p: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score."""
    base = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.inline(F.transform(F.array(words_of(F.col("text"))), lambda ws: F.struct(F.size(ws).cast("bigint").alias("n_words"), _phrases(ws).alias("_found")))),
    )
    found = kept(license_runs(docs, p), "runs")
    out = _outdone(found).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("template").alias("_t"), F.col("run").alias("_r"), F.lit(True).alias("_out"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("run") == F.col("_r"))
    named = F.when(F.col("verified") & F.col("_out").isNull(), F.col("label"))
    # Sets of labels are bounded by the templates.
    runs = found.join(out, same, "left").groupBy("doc_id", "text_hash").agg(F.collect_set(named).alias("_labels"), F.max("coverage").alias("_score"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_labels", "_score")
    starts, labels = F.transform("_found", lambda x: x["start"]), F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["label"])))
    joined = base.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.size("_found").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        labels.alias("base_labels"), F.array_sort(F.array_union(labels, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
