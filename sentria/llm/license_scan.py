"""Operator 3: license scans with MinHash bands over overlapping text windows, in DataFrame functions only.

Templates are grouped by length; for a group of at most S words, windows of S + s words start at every s-th word, so some
window holds any passage of S words whole. A window and a template collide if one of BANDS minima of hashed 5-word
shingles agrees. A window that holds a template whole has a similarity J of at least about one half with it, so all bands
miss with probability (1 - J)^32, below 1e-9; even with a fifth of the shingles gone it stays below 1e-5. Every collision is
verified: the window must contain at least 80 % of the template's shingles.

Windows are laid only where an anchor word stands. Anchors are chosen such that less than 80 % of a template's shingles are
free of them, so a window without an anchor can never be a match, and nothing is lost.

Defined results: a null or empty text, and a text of fewer than five words, holds no license; a null doc_id stays null; rows
are kept one by one; templates of fewer than five words are refused; without templates nothing is found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.runtime import materialize, read_table

SHINGLE, BANDS, PERCENT = 5, 32, 80
#: Template tables of up to so many characters are broadcast.
BROADCAST_CHARS = 1 << 20
# Public license notices by identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_WORD = re.compile(r"[a-z0-9]+")


def _size(words: int) -> int:
    """The group a template of so many words belongs to: exact up to 12, then steps of a quarter."""
    size = 12
    while size < words:
        size = size * 5 // 4
    return words if words <= 12 else size


def _stride(size: int) -> int:
    return max(1, size // 5)


def anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Words such that more than a fifth of each template's shingles hold one: words of many templates first, then long ones."""
    split = [_WORD.findall(text.lower()) for _, text in templates]
    spread = {w: sum(w in set(words) for words in split) for words in split for w in words if len(w) >= 6}
    chosen: list[str] = []
    for words in split:
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        own = sorted({w for w in words if w in spread}, key=lambda w: (-spread[w], -len(w), w)) + sorted(set(words), key=len, reverse=True)
        for w in own:
            if sum(any(x in chosen for x in s) for s in shingles) * 100 > (100 - PERCENT) * len(shingles):
                break
            if w not in chosen:
                chosen.append(w)
    return chosen


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _shingles(words: Column) -> Column:
    """Distinct hashes of the 5-word shingles of an array of words; none of fewer than five."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (SHINGLE - 1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _bands(shingles: Column, size: Column) -> Column:
    seeds = F.array(*[F.lit(b) for b in range(BANDS)])
    return F.transform(seeds, lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, size, b))))


def _once(value: Column) -> Column:
    """A generator of one row: the optimizer cannot copy the expression into each place that refers to it."""
    return F.explode(F.array(value))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (identifiers, sorted, comma-joined) and first_word (where the first match's window starts)."""
    spark = docs.sparkSession
    counted = [(i, name, text, len(_WORD.findall(text.lower()))) for i, (name, text) in enumerate(templates)]
    if short := [name for _, name, _, n in counted if n < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    if not counted:
        return keyed.select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"), F.lit(None).cast("long").alias("first_word"))
    known = spark.createDataFrame([(i, name, text, _size(n)) for i, name, text, n in counted], "template int, license string, template_text string, size int")
    known = known.select("template", "license", "size", _once(_shingles(_words(F.col("template_text")))).alias("wanted"))
    known = known.select("*", _once(_bands(F.col("wanted"), F.col("size"))).alias("template_bands"))
    known = known.select("template", "license", "size", "wanted", "template_bands", F.posexplode("template_bands").alias("band", "key"))
    if sum(len(text) for _, text in templates) <= BROADCAST_CHARS:
        known = F.broadcast(known)
    marks = anchors(templates)
    sizes = sorted({_size(n) for *_, n in counted})
    # the words' stems keep the test on the raw text cheap and let nothing through that the exact test would miss
    marked = keyed.where(F.lower("text").rlike("|".join(marks)))
    words = marked.select("doc_id", "text_key", _once(_words(F.col("text"))).alias("w")).where(F.size("w") >= SHINGLE)
    places = words.select("*", _once(F.filter(F.transform("w", lambda x, i: F.when(x.isin(marks), i)), lambda i: i.isNotNull())).alias("places")).where(F.size("places") > 0)
    sized = places.withColumn("group", F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(_stride(s)).alias("stride")) for s in sizes])))
    size, stride = F.col("group.size"), F.col("group.stride")
    length = size + stride
    # starts of the windows that hold an anchor: multiples of the stride
    lowest = lambda p: F.greatest(F.lit(0), F.ceil((p - length + 1) / stride).cast("int"))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(lowest(p), F.floor(p / stride).cast("int")), lambda k: k * stride))))
    laid = sized.select("doc_id", "text_key", "w", size.alias("size"), length.alias("length"), F.explode(starts).alias("start"))
    windows = laid.select("doc_id", "text_key", "size", "start", F.slice("w", F.col("start") + 1, F.col("length")).alias("v")).where(F.size("v") >= SHINGLE)
    windows = windows.select("doc_id", "text_key", "size", "start", _once(_shingles(F.col("v"))).alias("held"))
    windows = windows.select("*", _once(_bands(F.col("held"), F.col("size"))).alias("bands"))
    entries = windows.select("doc_id", "text_key", F.col("size").alias("window_size"), "start", "held", "bands", F.posexplode("bands").alias("window_band", "window_key"))
    first = F.array_position(F.zip_with("bands", "template_bands", lambda x, y: x == y), True) == F.col("band") + 1
    met = entries.join(known, (F.col("window_key") == F.col("key")) & (F.col("window_band") == F.col("band")) & (F.col("window_size") == F.col("size")) & first)
    verified = met.where(100 * F.size(F.array_intersect("held", "wanted")) >= PERCENT * F.size("wanted"))
    found = verified.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("license")).alias("names"), F.min("start").cast("long").alias("first_word"))
    found = materialize(found, "licenses").withColumnRenamed("doc_id", "found_id").withColumnRenamed("text_key", "found_key")
    every = keyed.select("doc_id", "text_key")
    joined = every.join(found, every["doc_id"].eqNullSafe(found["found_id"]) & (F.col("text_key") == F.col("found_key")), "left")
    return joined.select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), "first_word")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        words = _WORD.findall(text.lower())
        size = _size(len(words))
        rows.append(f"({i}, '{name}', '{' '.join(words)}', {_stride(size)}, {size + _stride(size)})")
    return ", ".join(rows)


SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_values()}) AS v(template, license, words, stride, length)),
ts AS (SELECT DISTINCT template, license, stride, length, unnest(list_transform(range(1, len(string_split(words, ' ')) - 3), lambda x: array_to_string(string_split(words, ' ')[x:x + 4], ' '))) AS g FROM t),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
s AS (SELECT r, p, array_to_string(w[p + 1:p + 5], ' ') AS g FROM (SELECT r, w, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
h AS (SELECT r, template, license, g, unnest(range(greatest(0, CAST(ceil((p + 5 - length) / stride) AS BIGINT)), CAST(floor(p / stride) AS BIGINT) + 1)) * stride AS start FROM s JOIN ts USING (g)),
c AS (SELECT r, template, license, start, count(DISTINCT g) AS hits FROM h GROUP BY r, template, license, start),
m AS (SELECT r, license, start FROM c JOIN tn USING (template) WHERE 100 * hits >= 80 * n),
f AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, min(start) AS first_word FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses, CAST(first_word AS BIGINT) AS first_word FROM d LEFT JOIN f USING (r)
"""
