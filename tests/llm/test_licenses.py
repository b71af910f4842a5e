import math
import re
from collections import Counter

from parley.llm import licenses as Z

SCHEMA = "path string, text string, score string"
ROWS = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.txt", "plain words only"),
        ("a/b/y.txt", "text before.\nThis work is licensed under the GNU General Public License, version 3."),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0. And more words follow here."),
        ("a/b/c/d/z.txt", "the word license alone in a long sentence of many other words that say nothing at all about it"),
        ("q/w.txt", "none"), (None, "Licensed under CC BY-NC 4.0."), (None, "nothing"), ("a/n.txt", None), ("a/e.txt", ""),
        ("LICENSE", "Licensed under CC BY-NC 4.0."), ("top.txt", "x"), ("a/e.txt", ""), ("a/long.txt", "word " * 50_000),
        ("dup/f.txt", "Released under the MIT License."), ("dup/f.txt", "no"), ("a/blank.txt", "licence\n" + "\n # \n" * 20_000 + " " * 20_000 + "x\ny")]


def own(text, df, total):
    term = re.compile(Z.TERM)
    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1 if t in df else math.log(1 + total) + 1
    vec = lambda s: {t: n * idf(t) for t, n in Counter(term.findall(s.lower())).items()}
    best = None
    seen = set()
    blocks = [b for b in re.split(Z.PARAGRAPH, text or "") if "\n" in b]
    for s in [*re.split(Z.SENTENCE, text or ""),
              *(s for b in blocks for s in re.split(Z.SENTENCE, re.sub(Z.COMMENT, "", b).replace("\n", " ")))]:
        if not re.search(Z.CUES, s):
            continue
        v = vec(s)
        for name, phrase in Z.TEMPLATES:
            w = vec(phrase)
            cos = round(sum(v.get(t, 0) * x for t, x in w.items())
                        / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())), 9)
            if cos >= Z.THRESHOLD:
                seen.add(name)
                best = min(best or (0.0, ""), (-cos, name))
    for narrow, wide in Z.NARROWER.items():
        if best and best[1] == wide and narrow in seen:
            best = (best[0], narrow)
    return best


def test_against_brute_force(spark):
    term = re.compile(Z.TERM)
    vocab = {t for _, p in Z.TEMPLATES for t in term.findall(p.lower())}
    df = Counter({v: 0 for v in vocab})
    for _, t in ROWS:
        df.update(set(re.split("[^a-z0-9.-]+", (t or "").lower())) & vocab)
    got = Z.scan(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)).collect()
    assert len(got) == len(ROWS)
    found = {(p, t): own(t, df, len(ROWS)) for p, t in ROWS}
    dirs = {}
    for (p, t), b in found.items():
        if b and p and p.split("/")[-1] in Z.LICENCE_FILES:
            d = "/".join(p.split("/")[:-1])
            dirs[d] = min(dirs.get(d, b), b)
    for r in got:
        b, basis = found[r["path"], r["text"]], "header"
        if b is None and r["path"] is not None:
            parts, basis = r["path"].split("/")[:-1], "inherited"
            for k in range(len(parts), -1, -1):
                if "/".join(parts[:k]) in dirs:
                    b = dirs["/".join(parts[:k])]
                    break
        if b is None:
            assert r["licence"] is None and r["basis"] is None
        else:
            assert (r["licence"], r["basis"]) == (b[1], basis) and abs(r["score"] + b[0]) < 1e-8
    assert {r["licence"] for r in got if r["path"] is None} == {"CC-BY-NC-4.0", None}
    by = {(r["path"], r["text"]): r["licence"] for r in got}
    assert by["a/b/c/x.txt", "plain words only"] == "Apache-2.0" and by["a/n.txt", None] == "MIT"
    assert by["q/w.txt", "none"] == "CC-BY-NC-4.0"


GPL = """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU {0}General Public License as published by
 * the Free Software Foundation; either version {1} of the License, or
 * (at your option) any later version.
 */
int main;
"""


def test_near_relatives_are_told_apart(spark):
    bsd2 = ("Copyright (c) 2020\n\nRedistribution and use in source and binary forms, with or without\nmodification, are "
            "permitted provided that the following conditions are met:\n\n1. Redistributions of source code must\nretain it.\n")
    bsd3 = bsd2 + ("\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or "
                   "promote products derived from\nthis software without specific prior written permission.\n")
    cases = [("GPL-2.0", GPL.format("", 2)), ("GPL-3.0", GPL.format("", 3)), ("AGPL-3.0", GPL.format("Affero ", 3)),
             ("LGPL-3.0", GPL.format("Lesser ", 3).replace("program", "library")),
             ("LGPL-2.1", GPL.format("Lesser ", 2.1).replace("program", "library")),
             ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
             ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."),
             ("CC-BY-SA-4.0", "x\n\nLicensed under CC BY-SA 4.0."), ("BSD-2-Clause", bsd2), ("BSD-3-Clause", bsd3),
             ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy"),
             ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
                     "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
             ("Unlicense", "This is free and unencumbered software released into the public domain."), (None, "int main;\nno notice")]
    df = spark.createDataFrame([(f"d{i}/f", t, "x") for i, (_, t) in enumerate(cases)], SCHEMA)
    got = {r["path"]: r["licence"] for r in Z.scan(df).collect()}
    assert [got[f"d{i}/f"] for i in range(len(cases))] == [n for n, _ in cases]


def test_other_templates(spark):
    own = spark.createDataFrame([("House-1", "Use of this file needs a permission of the house.")], "licence string, phrase string")
    df = spark.createDataFrame([("a/f", "Use of this file\nneeds a permission of the house.", "x"),
                                ("a/g", "Licensed under the MIT License.", "x")], SCHEMA)
    assert {r["path"]: r["licence"] for r in Z.scan(df, templates=own).collect()} == {"a/f": "House-1", "a/g": None}


def test_empty(spark):
    assert Z.scan(spark.createDataFrame([], SCHEMA)).count() == 0
