import math
import re
from collections import Counter

from pyspark.sql import functions as F

from seatracks.llm import licenses as L
from seatracks.llm.queries import queries

SCHEMA = "doc_id long, path string, text string"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def weights_by_hand():
    """idf and unit vectors from the templates' texts, apart from the library's."""
    bags = [Counter(w for w in re.findall("[a-z0-9]+", text.lower()) if w not in L.COMMON) for _, text in L.TEMPLATES]
    df = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in df.items()}
    units = []
    for b in bags:
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        units.append({w: n * idf[w] / norm for w, n in b.items()})
    return idf, math.log(1 + len(bags)) + 1, units


IDF, OTHER, UNITS = weights_by_hand()


def best(passages):
    """Brute-force cosine of all passages to all templates."""
    top = (False, 0.0, 0, None)
    for text in passages:
        tf = Counter(w for w in re.findall(L.TERM, text.lower()) if w not in L.COMMON)
        x = {w: n * IDF.get(w, OTHER) for w, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for t, (name, _) in enumerate(L.TEMPLATES):
            score = round(sum(v * UNITS[t].get(w, 0.0) for w, v in x.items()) / norm, 6) if norm else 0.0
            if score >= L.THRESHOLD:
                top = max(top, (name != L.WEAK, score, -t, name))
    return top


def passages(text):
    """By kind: lines, paragraphs of several lines, sentences."""
    low = (text or "").lower()
    return low.split("\n"), [p for p in re.split(L.BLANK, low) if "\n" in p], re.split(L.SENTENCE_END, low)


def scanned(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("clash")).withColumn("license", F.lit("x")).withColumn("dir", F.lit("y"))
    return {r["doc_id"]: (r["license"], r["score"], r["found"], r["license_dir"]) for r in L.scan(df, "doc_id", F.col("path")).collect()}


def test_anchors_are_needed():
    idf, other, weights, anchors = L.template_vectors()
    for t in range(len(L.TEMPLATES)):
        rest = sum(x * x for (k, w), x in weights.items() if k == t and w not in anchors)
        assert math.sqrt(rest) < L.THRESHOLD


def test_headers_files_and_inheritance(spark):
    code = "int main() { return 0; }\n" * 30
    rows = [
        (1, "p/LICENSE", MIT + "\nand more words that say nothing at all"),
        (2, "p/a/b/x.c", code),
        (3, "p/a/LICENSE.txt", "# " + APACHE),
        (4, "p/x.c", code),
        (5, "p/a/y.c", f"// {APACHE.upper()}\n{code}"),
        (6, "q/x.c", code),
        (7, "pa/x.c", code),
        (8, "x.c", None),
        (9, None, MIT),
        (10, None, code),
        (11, "q/z.c", "All rights"),
        (12, "p/long.c", "word " * 200_000 + "\n" + MIT),
    ]
    got = scanned(spark, rows)
    assert got[1][0] == "MIT" and got[1][2] == "header"
    assert got[2][0] == "Apache-2.0" and got[2][2:] == ("inherited", "p/a")
    assert got[4][0] == "MIT" and got[4][2:] == ("inherited", "p")
    assert got[5][0] == "Apache-2.0" and got[5][2] == "header"
    assert got[6][0] is got[7][0] is got[8][0] is got[10][0] is None
    assert got[9][:3] == ("MIT", 1.0, "header") and got[12][:3] == ("MIT", 1.0, "header")


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a/x", MIT), (1, "a/x", MIT), (2, "a/y", "")], SCHEMA)
    got = L.scan(df, "doc_id", F.col("path")).collect()
    assert len(got) == 3 and sorted(r["found"] for r in got) == ["header", "header", "inherited"]
    assert L.scan(spark.createDataFrame([], SCHEMA), "doc_id", F.col("path")).count() == 0


def test_no_python_in_plan(spark, data):
    plan = queries()["op1_license_scan"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text").collect()
    path = lambda r: "/".join(x for x in (r["source"], str(r["doc_id"] % 10) if r["doc_id"] % 10 else None) if x)
    own = {r["doc_id"]: max(best(p) for p in passages(r["text"])) for r in docs}
    dirs = {}
    for r in docs:
        _, score, _, name = own[r["doc_id"]]
        if name:
            n = max(sum(len(re.findall(L.TERM, x)) for x in kind if best([x])[3]) for kind in passages(r["text"]))
            if n >= L.FILE_SHARE * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])):
                dirs[path(r)] = max(dirs.get(path(r), (0.0, "")), (score, name))
    got = {r["doc_id"]: r for r in queries()["op1_license_scan"](spark, data).collect()}
    assert len(got) == len(docs)
    for r in docs:
        _, score, _, name = own[r["doc_id"]]
        g, d = got[r["doc_id"]], path(r)
        above = next((x for x in (d, r["source"] or "", "") if x in dirs), None)
        if name:
            assert (g["license"], g["score"], g["found"], g["license_dir"]) == (name, score, "header", d)
        elif above is not None:
            assert (g["score"], g["license"], g["found"], g["license_dir"]) == (*dirs[above], "inherited", above)
        else:
            assert g["license"] is None and g["found"] is None


def test_usual_headers_and_licence_lines(spark):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 */
int main() {}"""
    rows = [
        (1, "a/1", gpl, "GPL-3.0"),
        (2, "b/2", "// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        (3, "c/3", "# SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        (4, "d/4", "Copyright (c) 2020 Foo Inc. All rights reserved.", "All-rights-reserved"),
        (5, "e/5", "Some long paragraph about the shop. It goes on and on for many words. Released under the MIT License. And then it goes on again with other matters.", "MIT"),
        (6, "f/6", "Copyright 2020 X\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n  http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
        (7, "g/7", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        (8, "h/8", "We were granted permission to use the hall, and the gnu ate the notice.", None),
        (9, "i/9", "Copyright Foo. All rights reserved.\n\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ]
    got = scanned(spark, [r[:3] for r in rows])
    assert {i: got[i][0] for i, *_ in rows} == {i: name for i, _, _, name in rows}


def test_licence_files_of_the_system(spark):
    """Each full licence text gets its own name."""
    import os

    folder = "/usr/share/common-licenses"
    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    there = [f for f in want if os.path.exists(f"{folder}/{f}")]
    if not there:
        __import__("pytest").skip("no licence texts here")
    rows = [(i, f"{f}/LICENSE", open(f"{folder}/{f}", encoding="utf-8", errors="replace").read()) for i, f in enumerate(there)]
    rows += [(100 + i, f"{f}/deep/er/x.c", "int x;") for i, f in enumerate(there)]
    got = scanned(spark, rows)
    assert {f: got[i][0] for i, f in enumerate(there)} == {f: want[f] for f in there}
    assert {f: (got[100 + i][0], got[100 + i][3]) for i, f in enumerate(there)} == {f: (want[f], f) for f in there}
