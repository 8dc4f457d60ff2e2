"""License scans by MinHash over text windows, in DataFrame functions alone.

A template is the set of its five-word shingles.  Templates are grouped in size
classes a fourth apart; for a class of c shingles a text is cut into windows of
5c/4 shingles, c/4 apart, so that any run of c shingles lies in one window
whole.  A window that holds a template has a Jaccard similarity to it of
0.45 or more even if only 0.8 of the template is there, and 0.64 if all is:
with 32 bands of two rows it shares a band with probability 0.999, or 1 - 5e-8.
Windows and templates that share a band are compared exactly: the share of the
template's shingles that the window contains must be 0.8 or more.

Windows are cut only where they hold a cue word.  The cue words are taken from
the templates so that 0.8 of a template's shingles cannot be had without one;
leaving out windows without any drops no match.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIN_SIMILARITY, SHINGLE_WORDS, let, only, stage

BANDS, ROWS = 32, 2
TOKEN = r"[a-z0-9]+(?:[.'-][a-z0-9]+)*"
#: Words too common to look for.
_COMMON = frozenset("the a an of to and or in on is are be by for with this that under any may not you it as at from all no if such".split())

# fixed values: license notices, as they stand in files
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced"],
}


def template_words(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def template_shingles(text: str) -> list[tuple[str, ...]]:
    """Different shingles; a template under five words has none and is no template."""
    w = template_words(text)
    return sorted({tuple(w[i : i + SHINGLE_WORDS]) for i in range(len(w) - SHINGLE_WORDS + 1)})


def size_class(n: int) -> int:
    c = 1
    while c < n:
        c = max(c + 1, c * 5 // 4)
    return c


def cue_words(texts: list[str], min_containment: float) -> list[str]:
    """Words of which any text with so much of a template's shingles has one."""
    cues: set[str] = set()
    for text in texts:
        left = template_shingles(text)
        n = len(left)
        while n and len(left) >= min_containment * n:
            left = [s for s in left if not cues & set(s)]
            if len(left) < min_containment * n:
                break
            words = {w for s in left for w in s}
            cues.add(max(words, key=lambda w: (w not in _COMMON, sum(w in s for s in left), len(w), w)))
    return sorted(cues)


def _masks() -> list[int]:
    """One constant for each hash function: h xor constant orders hashes anew."""
    return [xxhash.xxh64_intdigest(b"mask", k) - (1 << 63) for k in range(BANDS * ROWS)]


def _xor(mask: int):
    return lambda x: x.bitwiseXOR(F.lit(mask))


def band_keys(shingles: Column, size: Column) -> Column:
    """array<long>: the keys of the bands of a set of shingle hashes."""

    def keys(s: Column) -> Column:
        least = [F.array_min(F.transform(s, _xor(m))) for m in _masks()]
        return F.array(*[F.xxhash64(size, F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])

    return let(F.array_distinct(shingles), keys)


def shingle_hashes(words: Column) -> Column:
    """array<long>, in order; none if there are fewer than five words."""
    n = F.size(words) - SHINGLE_WORDS + 1
    each = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), each)).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """license, template, size, marks array<long>, band_keys array<long>."""
    rows = [(name, k, size_class(len(s)), template_words(t)) for name, texts in templates.items() for k, t in enumerate(texts) if (s := template_shingles(t))]
    schema = T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    marks = spark.createDataFrame(rows, schema).withColumn("marks", F.array_distinct(shingle_hashes(F.col("words")))).drop("words")
    return marks.withColumn("keys", band_keys(F.col("marks"), F.col("size")))


def _cuts(size: int, spots: Column, hashes: Column) -> Column:
    """array<struct<size, start, window>>: the windows for a size class that
    hold one of the words `spots` of a text with the shingles `hashes`."""
    length, step = -(-5 * size // 4), max(1, size // 4)
    reach = length + SHINGLE_WORDS - 1  # words of a window
    around = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - reach + 1) / step)).cast("int"), F.floor(p / step).cast("int"))
    inside = F.filter(F.array_distinct(F.flatten(F.transform(spots, around))), lambda k: k * step < F.size(hashes))
    return F.transform(inside, lambda k: F.struct(F.lit(size).alias("size"), (k * step).cast("int").alias("start"), F.slice(hashes, k * step + 1, F.lit(length)).alias("window")))


def cue_windows(text: Column, cues: dict[int, list[str]]) -> Column:
    """The windows of all size classes that hold a cue word of the class."""
    every = sorted({w for words in cues.values() for w in words})
    spots = lambda w: F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.get(w, i).isin(every))
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    found = let(words, lambda w: F.struct(w.alias("words"), spots(w).alias("spots"), shingle_hashes(w).alias("hashes")))

    def of_class(f: Column, c: int) -> Column:
        return _cuts(c, F.filter(f["spots"], lambda p: F.get(f["words"], p).isin(cues[c])), f["hashes"])

    return let(found, lambda f: F.concat(*[of_class(f, c) for c in sorted(cues)]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, min_containment: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, license, first_word, last_word, containment: a row for each place
    where a document has a license notice.

    Words are runs of ASCII letters and digits (with . ' - inside) of the
    lower-cased text, counted from 0.  Places of one license that overlap are
    one.  Null and empty texts, and those under five words, have none.  Rows
    that repeat id and text count once; a null doc_id is kept.  An empty table
    or no templates give an empty result; other columns fall away.
    """
    templates = TEMPLATES if templates is None else templates
    known = template_table(docs.sparkSession, templates)
    texts = [t for group in templates.values() for t in group]
    of_size: dict[int, list[str]] = {}
    for t in texts:
        if s := template_shingles(t):
            of_size.setdefault(size_class(len(s)), []).append(t)
    cues = {c: cue_words(group, min_containment) for c, group in (of_size or {1: []}).items()}
    d = only(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text"))
    any_cue = "(?i)(?:" + "|".join(sorted({re.escape(w) for words in cues.values() for w in words}) or [r"\z."]) + ")"
    windows = d.where(F.col("text").rlike(any_cue)).select("doc_id", "text_key", F.explode(cue_windows(F.col("text"), cues)).alias("w"))
    windows = windows.select("doc_id", "text_key", "w.size", "w.start", "w.window").withColumn("keys", band_keys(F.col("window"), F.col("size")))
    # the same template in the same window by several bands is one pair
    bands = known.select("license", "template", "marks", F.col("size").alias("s"), F.explode("keys").alias("key"))
    found = windows.withColumn("key", F.explode("keys")).drop("keys").join(bands, "key").where("size = s")
    found = found.groupBy("doc_id", "text_key", "license", "template", "size", "start").agg(F.any_value("window").alias("window"), F.any_value("marks").alias("marks"))
    found = found.withColumn("containment", F.size(F.array_intersect("window", "marks")) / F.size("marks")).where(F.col("containment") >= min_containment)
    hits = F.filter(F.sequence(F.lit(0), F.size("window") - 1), lambda i: F.array_contains("marks", F.get("window", i)))
    found = found.select("doc_id", "text_key", "license", "containment", (F.col("start") + F.array_min(hits)).alias("first_word"), (F.col("start") + F.array_max(hits) + SHINGLE_WORDS - 1).alias("last_word"))
    found = stage(found, "license-places")
    # overlapping places of a license become one
    mine = "partition by doc_id, text_key, license order by first_word, last_word"
    opens = F.expr(f"coalesce(first_word > max(last_word) over ({mine} rows between unbounded preceding and 1 preceding), true)")
    found = found.withColumn("opens", opens.cast("int")).withColumn("place", F.expr(f"sum(opens) over ({mine} rows between unbounded preceding and current row)"))
    return found.groupBy("doc_id", "text_key", "license", "place").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("containment").alias("containment")).select("doc_id", "license", "first_word", "last_word", "containment")
