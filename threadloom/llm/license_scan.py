"""Finds licence notices in documents, DataFrame functions only.

Texts and templates are cut into windows of six words that overlap by four, so each five-word
shingle lies in just one window of a text. A window is sketched by eight min-hashes, each a band of its
own, and windows that agree in a band are candidates. A window that shares one of its two shingles has a
min-hash similarity of a third to a half and is met with a probability of 0.96 to 0.996; templates of several
shingles meet through more windows, and two windows that are equal always do. A template of one shingle has no such
second chance, so it has a band of its own, in which windows with just its shingle meet it in any case.
Template windows start at every word, whatever the phase of a text's windows is.

Candidates are verified by the exact containment of the template's shingles in the document: at least 0.8.

Defined cases: null texts are empty; texts of fewer than five words have no shingle and match nothing.
Rows repeated with one id are one document; rows without id cannot be named and are never reported.
An empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import pick, stage

WORDS = 5
SPAN = 2
BANDS = 8
CONTAINMENT = 0.8
# Template bands up to this number are broadcast (some 30 bytes each); more are joined by a shuffle.
BROADCAST_BANDS = 500_000
# Up to so many shingles of one-shingle templates are looked for in each window before it gets that band; above, all windows get it.
LISTED_SINGLES = 5_000

# Customary notices of public licences.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction"),
    ("mit-warranty", 'The software is provided "as is", without warranty of any kind, express or implied, including '
     "but not limited to the warranties of merchantability"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "You may not use this file except in compliance with the License. You may obtain a copy of "
     "the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License"),
    ("agpl-header", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def with_shingles(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Replaces a text by the hashes of all its five-word shingles, in order; none for fewer words."""
    kept = [c for c in rows.columns if c != text]
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Columns of their own, or each shingle would split its text again.
    rows = rows.select(*kept, words.alias("_words"))
    last = F.size("_words") - WORDS
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return rows.select(*kept, F.transform(
        places, lambda i: F.xxhash64(F.slice("_words", i + 1, F.lit(WORDS)))).alias(name))


def with_bands(rows: DataFrame, hashes: str, step: int, single: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replaces the shingle hashes by a row for each window and band: band, least (the min-hash). Windows with a shingle that
    ``single`` tells to be some template's only one have two rows more, with their shingles in band -1.

    Windows become rows of two shingles first, so that hashing is done on plain columns, which Spark compiles."""
    kept = [c for c in rows.columns if c != hashes]
    last = F.greatest(F.lit(0), F.size(hashes) - 1 - (SPAN - 1) * (step == 1))
    starts = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = rows.select(*kept, F.explode(F.transform(starts, lambda s: F.struct(
        F.get(hashes, s).alias("a"), F.coalesce(F.get(hashes, s + 1), F.get(hashes, s)).alias("b")))).alias("_w")).select(*kept, "_w.*")
    each = [F.struct(F.lit(k).alias("band"), F.least(F.xxhash64("a", F.lit(k)), F.xxhash64("b", F.lit(k))).alias("least")) for k in range(BANDS)]
    bands = F.array(*each)
    if single is not None:
        own = [F.struct(F.lit(-1).alias("band"), F.col(c).alias("least")) for c in "ab"]
        bands = F.when(single(F.col("a")) | single(F.col("b")), F.array(*each, *own)).otherwise(bands)
    return windows.select(*kept, F.inline(bands))


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates), "license_id string, notice string")


def find_licenses(
    docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per document and licence: id, license_id, n_shared, containment."""
    known = with_shingles(pick(templates, license_id="license_id", notice="notice"), "notice", "hashes")
    known = known.select("license_id", F.array_distinct("hashes").alias("notice"), "hashes")
    ones = known.where(F.size("notice") == 1).select("license_id", "notice", F.lit(-1).alias("band"), F.col("notice")[0].alias("least"))
    known = stage(with_bands(known, "hashes", 1).unionByName(ones).distinct(), "templates")
    singles = [r["least"] for r in known.where("band = -1").select("least").distinct().limit(LISTED_SINGLES + 1).collect()]
    few = known.count() <= BROADCAST_BANDS
    index = known.select("license_id", "band", "least")
    rows = pick(docs, id=id_col, text=text_col).where("id IS NOT NULL")
    hashed = with_shingles(rows, "text", "hashes")
    met = with_bands(hashed, "hashes", SPAN, lambda h: h.isin(singles) if len(singles) <= LISTED_SINGLES else F.lit(True))
    met = met.join(F.broadcast(index) if few else index, ["least", "band"]).select("id", "license_id")
    met = stage(met.groupBy("id", "license_id").agg(F.count(F.lit(1)).alias("n")).select("id", "license_id"), "candidates")
    # The few texts that have a candidate are hashed once more.
    texts = with_shingles(rows.join(met.select("id").distinct(), "id", "left_semi"), "text", "hashes")
    notices = known.select("license_id", "notice").distinct()
    both = met.join(texts, "id").join(notices, "license_id")
    shared = F.size(F.array_intersect("notice", "hashes"))
    both = both.groupBy("id", "license_id").agg(
        F.max(shared).cast("bigint").alias("n_shared"), F.max(shared / F.size("notice")).alias("containment"))
    return both.where(F.col("containment") >= containment).select(
        F.col("id").alias(id_col), "license_id", "n_shared", "containment")
