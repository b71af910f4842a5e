"""License scans (op 6, DataFrame functions only).

A file's units are the sentences of its lines and of its paragraphs (the lines of
a header or licence file joined, comment marks left out).  Every unit of
the whole text that holds a cue word is compared with licence templates by the
cosine of sparse TF-IDF vectors; the best template at or above ``threshold`` is
the file's licence.  Versions and clauses are terms like any other, so
the nearer of two related licences is the one that names them.  Document
frequencies of template terms are counted over all files; other terms weigh as
much as the rarest.  A licence file (LICENSE, COPYING ..) also speaks for its
directory: a file without a licence of its own takes that of its nearest
ancestor directory.

``templates`` is a table (licence, phrase), by default ``TEMPLATES``.

Defined results for odd input
- null or empty text: no licence of its own; null path: nothing to inherit
- ties: the larger cosine, then the licence name first in code point order;
  for a directory with several licence files likewise
- repeated rows: each gets its own, equal, result; files that share a path are
  told apart by their text
- empty table: an empty result; very long texts: whole
- extra columns: kept, unless they clash with an output column (replaced)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import keep

# fixed values: public licence notices and opening phrases
_GPL = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version {} of the License, or (at your "
        "option) any later version.")
_LGPL = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General "
         "Public License as published by the Free Software Foundation; either version {} of the License, or (at your "
         "option) any later version.")
_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met")
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CC.format("Attribution")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring "
                "rights to this work to the public domain worldwide under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _LGPL.format("Lesser", "2.1")),
    ("LGPL-3.0", _LGPL.format("Lesser", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# a licence whose text opens with another one's words: the clause that only it has decides
NARROWER = {"BSD-3-Clause": "BSD-2-Clause"}
CUES = "(?i)licen[sc]e|copyright|permission|redistribut|spdx|cc by|public domain"
LICENCE_FILES = ["LICENSE", "LICENCE", "COPYING", "UNLICENSE", "LICENSE.txt", "LICENCE.txt", "LICENSE.md",
                 "LICENCE.md", "COPYING.txt"]
TERM = "[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"
SENTENCE = "\\n|(?<=[.!?])[ \\t]+"
PARAGRAPH = "\\n(?:[ \\t\\r#*;/%-]*+\\n)++"
COMMENT = "(?m)^[ \\t]*(?:[#*;%]+|//+|/[*]+|--+)?[ \\t]*|(?<![ \\t\\r])[ \\t\\r]++$"
THRESHOLD = 0.6
OUT = ["licence", "score", "basis"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def units(text: Column) -> Column:
    """The sentences of every line, and those of every paragraph of several lines."""
    cued = lambda a: F.filter(a, lambda s: s.rlike(CUES))
    lines = cued(F.split(text, SENTENCE))
    blocks = F.filter(F.split(text, PARAGRAPH), lambda b: b.contains("\n") & b.rlike(CUES))
    joined = F.transform(blocks, lambda b: F.replace(F.regexp_replace(b, COMMENT, ""), F.lit("\n"), F.lit(" ")))
    return F.concat(lines, cued(F.flatten(F.transform(joined, lambda b: F.split(b, SENTENCE)))))


def _vectors(files: DataFrame, text: str, templates: DataFrame) -> tuple[DataFrame, float]:
    """(template, licence, term, w) with rows of length one, the idf of each
    template term, and the idf of any other term."""
    spark = files.sparkSession
    t = keep(templates.select(F.monotonically_increasing_id().alias("template"), "licence", "phrase"), "licence-phrases")
    tf = t.select("template", "licence", F.explode(terms(F.col("phrase"))).alias("term")) \
        .groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocab = sorted(r["term"] for r in tf.select("term").distinct().collect())     # the templates' terms
    words = F.array_intersect(F.split(F.lower(F.col(text)), "[^a-z0-9.-]+"), F.array(*[F.lit(v) for v in vocab]))
    df = files.select(F.explode(F.array_union(words, F.array(F.lit("")))).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in df.collect()}
    total = df.pop("", 0)
    idf = spark.createDataFrame([(v, float(df.get(v, 0))) for v in vocab], "term string, df double") \
        .select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").withColumn("v", F.col("tf") * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    w = w.join(norm, "template").select("template", "licence", "term", "idf", (F.col("v") / F.col("norm")).alias("w"))
    rarest = spark.sql("select 1").select((F.log(F.lit(1.0 + total)) + 1).alias("x")).first()["x"]
    return keep(w, "licence-templates"), rarest


def header_matches(files: DataFrame, path: str, text: str, threshold: float, templates: DataFrame) -> DataFrame:
    """(path, text_hash, licence, score): the best template of each file that has one."""
    weights, rarest = _vectors(files, text, templates)
    said = files.select(F.col(path).alias("path"), F.xxhash64(text).alias("text_hash"),
                        F.posexplode(F.array_distinct(units(F.col(text)))).alias("unit", "s")).distinct()
    tf = said.select("path", "text_hash", "unit", F.explode(terms(F.col("s"))).alias("term")) \
        .groupBy("path", "text_hash", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.broadcast(weights.select("term", "idf").distinct())                  # the templates' terms
    tf = keep(tf.join(idf, "term", "left")
              .withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rarest))).drop("idf"), "licence-terms")
    key = ["path", "text_hash", "unit"]
    norm = tf.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = tf.join(F.broadcast(weights.select("template", "licence", "term", "w")), "term") \
        .groupBy(*key, "template", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    same = [dot["path"].eqNullSafe(norm["path"]), dot["text_hash"] == norm["text_hash"], dot["unit"] == norm["unit"]]
    cos = dot.join(norm, same[0] & same[1] & same[2]).select(
        dot["path"], dot["text_hash"], "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")) \
        .where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("licence")))
    found = cos.groupBy("path", "text_hash").agg(best.alias("b"), F.collect_set("licence").alias("all")) \
        .select("path", "text_hash", "b.licence", (-F.col("b.s")).alias("score"), "all")     # at most one per licence
    licence = F.col("licence")
    for narrow, wide in NARROWER.items():
        licence = F.when((F.col("licence") == wide) & F.array_contains("all", narrow), F.lit(narrow)).otherwise(licence)
    return found.withColumn("licence", licence).drop("all")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD,
         templates: DataFrame | None = None) -> DataFrame:
    """``files`` plus licence, score and basis ("header", "inherited" or null)."""
    if templates is None:
        templates = files.sparkSession.createDataFrame(TEMPLATES, "licence string, phrase string")
    # the row travels as one value, so its columns cannot clash with the joins'
    base = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("_row"),
                        F.col(path).alias("path"), F.col(text).alias("text"))
    found = keep(header_matches(base, "path", "text", threshold, templates), "licence-headers")
    named = F.element_at(F.split("path", "/"), -1).isin(LICENCE_FILES)
    rank = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("licence")))
    by_dir = found.where(named).groupBy(directory(F.col("path")).alias("anc")).agg(rank.alias("b")) \
        .select("anc", F.col("b.licence").alias("dir_licence"), (-F.col("b.s")).alias("dir_score"))
    dirs = base.select(directory(F.col("path")).alias("dir")).where("dir IS NOT NULL").distinct()
    steps = F.split("dir", "/")
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")) \
        .select("dir", "depth", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/").alias("anc"))
    near = keep(chain.join(by_dir, "anc").groupBy("dir")
                .agg(F.max_by(F.struct("dir_licence", "dir_score"), "depth").alias("near")), "licence-dirs")
    out = base.withColumn("text_hash", F.xxhash64("text")).withColumn("dir", directory(F.col("path"))).drop("text")
    own = found.select(F.col("path").alias("_p"), F.col("text_hash").alias("_h"), "licence", "score")
    out = out.join(own, F.col("path").eqNullSafe(F.col("_p")) & (F.col("text_hash") == F.col("_h")), "left") \
        .join(near, "dir", "left")
    kept = [F.col("_row")[c].alias(c) for c in files.columns if c not in OUT]
    return out.select(
        *kept, F.coalesce("licence", "near.dir_licence").alias("licence"),
        F.coalesce("score", "near.dir_score").alias("score"),
        F.when(F.col("licence").isNotNull(), F.lit("header"))
        .when(F.col("near").isNotNull(), F.lit("inherited")).alias("basis"))
