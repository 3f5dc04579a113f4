"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages are compared with templates of header size: notices, headers, titles and conditions of licences and their SPDX
lines. A text's passages are its lines, its paragraphs of several lines (blank lines, or comment signs alone, part
them), its sentences, and the whole text of files named like a licence; so a header is found wrapped, in one line, or
inside a longer paragraph, and a licence file by its title or conditions. Only passages that hold an anchor word are
scored: a template's anchors are its heaviest words, short ones and numbers last, so many that without any of them no passage reaches the
threshold. Files whose words are mostly licence passages, or that are named like a licence, set the licence of their
directory; a file without a licence of its own takes that of the nearest directory above it. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, written

# Names, and usual notices, titles, headers and conditions of public licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("Artistic-1.0", "The Artistic License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)
#: A reservation of rights says less than any licence: it counts where nothing else is found.
WEAK = "All-rights-reserved"
#: Each licence's SPDX line follows from its name; the tag is named twice, so that a short name alone (MIT is a German word too) is no match.
TEMPLATES = NOTICES + tuple((name, f"SPDX-License-Identifier: {name} (SPDX)") for name in dict.fromkeys(n for n, _ in NOTICES) if name != WEAK)
# Words that are common in any text and count in no vector.
COMMON = frozenset("a all an and any are as at be by for from in is it no not of on or that the this to under use was with without work".split())
TERM = r"[a-z0-9]+"
#: What parts paragraphs, and sentences.
BLANK = r"\n[^a-z0-9\n]*\n"
SENTENCE_END = r"[.!?;:][)\"']*[ \t\r\n]+|" + BLANK
LINE, PARAGRAPH, SENTENCE, WHOLE = range(4)
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicense)([.-][^/]*)?$"
THRESHOLD = 0.75
#: Share of a file's words in licence lines from which on it counts as a licence file.
FILE_SHARE = 0.5


def template_vectors(templates=TEMPLATES, threshold: float = THRESHOLD):
    """(idf by word, idf of other words, unit weights by (template, word), anchors)."""
    import re

    bags = [Counter(w for w in re.findall(TERM, text.lower()) if w not in COMMON) for _, text in templates]
    n = len(bags)
    df = Counter(w for bag in bags for w in bag)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    other = math.log(1 + n) + 1
    weights, anchors = {}, set()
    for t, bag in enumerate(bags):
        raw = {w: k * idf[w] for w, k in bag.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        unit = {w: x / norm for w, x in raw.items()}
        weights |= {(t, w): x for w, x in unit.items()}
        rest = 1.0
        for w, x in sorted(unit.items(), key=lambda p: (p[0].isdigit(), len(p[0]) <= 3, -p[1], p[0])):
            if rest < (threshold - 1e-9) ** 2:
                break
            anchors.add(w)
            rest -= x * x
    return idf, other, weights, sorted(anchors)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A small fixed table from one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def scan(df: DataFrame, id_col: str, path: Column, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, path, license, score, found, license_dir) for each row of ``df``.

    found: ``header`` (a passage of its own: the best score, ties to the earlier template; a reservation of rights only
    where no licence is found), ``inherited`` or null without a licence. license_dir: the directory it comes from. Null
    texts and paths have no licence of their own; a null path inherits nothing; whole texts are scanned, however long;
    repeated rows are scanned one by one; other columns of ``df`` do not matter; an empty table gives an empty result.
    """
    spark = df.sparkSession
    idf, other, weights, anchors = template_vectors(templates, threshold)
    vocabulary = _table(spark, [{"word": w, "idf": x} for w, x in idf.items()], "word:string,idf:double")  # as many rows as the templates have words
    vectors = _table(spark, [{"template": t, "word": w, "weight": x} for (t, w), x in weights.items()], "template:int,word:string,weight:double")
    names = F.array(*(F.lit(name) for name, _ in templates))
    anchor = r"(?<![a-z0-9])(?:" + "|".join(anchors) + r")(?![a-z0-9])"

    low = F.lower("text")
    held = lambda kind, texts: F.transform(F.filter(texts, lambda x: x.rlike(anchor)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    passages = F.concat(
        held(LINE, F.split(low, "\n")),
        held(PARAGRAPH, F.filter(F.split(low, BLANK), lambda x: F.instr(x, "\n") > 0)),
        held(SENTENCE, F.split(low, SENTENCE_END)),
        held(WHOLE, F.when(named, F.array(low)).otherwise(F.array().cast("array<string>"))),
    )
    nothing = F.array().cast("array<struct<kind:int,text:string>>")
    files = df.select(F.col(id_col), path.alias("path"), F.col(text_col).alias("text")).select(
        id_col,
        "path",
        F.monotonically_increasing_id().alias("rid"),
        named.alias("named"),
        F.coalesce(F.when(F.col("text").rlike(f"(?i){anchor}"), passages), nothing).alias("passages"),
        "text",
    )
    words = F.when(F.size("passages") > 0, F.regexp_count("text", F.lit(WORD))).otherwise(0)
    files = written(files.withColumn("n_words", words).drop("text"), "files")

    at = ["rid", "pos", "kind", "n_terms"]
    each = files.select("rid", F.posexplode("passages").alias("pos", "passage")).select("rid", "pos", "passage.kind", _terms(F.col("passage.text")).alias("words"))
    terms = each.select("rid", "pos", "kind", F.size("words").alias("n_terms"), F.explode("words").alias("word")).where(~F.col("word").isin(*sorted(COMMON)))
    terms = terms.groupBy(*at, "word").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(vocabulary), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    weighed = written(weighed.select(*at, "word", "x"), "terms")
    norms = weighed.groupBy(*at).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "word").groupBy("rid", "pos", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["rid", "pos"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    strong = F.get(names, F.col("template")) != WEAK
    line_best = scored.groupBy(*at).agg(F.max(F.struct(strong.alias("strong"), "score", (-F.col("template")).alias("t"))).alias("best"))
    kinds = line_best.groupBy("rid", "kind").agg(F.max("best").alias("best"), F.sum("n_terms").alias("licence_words"))
    own = kinds.groupBy("rid").agg(F.max("best").alias("best"), F.max("licence_words").alias("licence_words"))
    own = written(own.select("rid", F.col("best.score").alias("score"), F.get(names, -F.col("best.t")).alias("license"), "licence_words"), "own")

    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    known = files.select(id_col, "path", "rid", "named", "n_words").join(own, "rid", "left").withColumn("dir", folder)
    setters = known.where(F.col("license").isNotNull() & F.col("dir").isNotNull() & (F.col("named") | (F.col("licence_words") >= FILE_SHARE * F.col("n_words"))))
    dirs = written(setters.groupBy("dir").agg(F.max(F.struct("score", "license")).alias("s")).select("dir", F.col("s.license").alias("dir_license"), F.col("s.score").alias("dir_score")), "dirs")
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    above = known.where(F.col("license").isNull() & F.col("dir").isNotNull()).select("rid", F.posexplode(ancestors).alias("depth", "dir"))
    nearest = above.join(dirs, "dir").groupBy("rid").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score")).alias("n"))
    nearest = written(nearest, "nearest")
    out = known.join(nearest, "rid", "left")
    return out.select(
        id_col,
        "path",
        F.coalesce("license", "n.dir_license").alias("license"),
        F.coalesce("score", "n.dir_score").alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("n.dir_license").isNotNull(), "inherited").alias("found"),
        F.when(F.col("license").isNotNull(), F.col("dir")).otherwise(F.col("n.dir")).alias("license_dir"),
    )
