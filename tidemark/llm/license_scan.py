"""License scans: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

Paragraphs are lines, and windows of two or three lines without a blank one among them, so that a wrapped notice is found; a
window counts under its first line, and only where no shorter or earlier paragraph of the same family overlaps it. Features are
word n-grams (1 to 3) that hold an anchor word; a multinomial logistic regression with an L1 penalty weighs them for each
licence family and for "unknown". Training texts are made by rule: templates and body paragraphs of the licences in varied
wrapping, and ordinary sentences that use anchor words for "unknown". Calibration is done on templates and sentences that a
first fit has not seen: a temperature for the probabilities (least log loss), and the probability below which a paragraph
counts as unknown. A prediction stands if the paragraph also shares `SHARED` of the n-grams of one of the family's templates,
names no other version than the family's, and does not deny the licence.

Lines that name a licence, but of which no family stands, are counted as unknown.

A paragraph without an anchor word has no feature, and no template is without one, so texts without one aren't split at all:
this drops nothing. Null or empty text has no paragraph; repeated rows are scanned row by row; classes that tie go to the first
by place in TEMPLATES; very long texts are scanned whole; no rows give none. Only the two named columns are read. All of it is
DataFrame functions and pyspark.ml on the JVM.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words

UNKNOWN, SHARED = "unknown", 0.6
#: A feature holds one of these words.
ANCHORS = ["license", "licensed", "licence", "licensing", "copyright", "mit", "apache", "gnu", "gpl", "lgpl", "agpl", "bsd", "isc", "mozilla", "mpl", "eclipse", "epl", "eupl", "creative", "commons", "cc", "by", "sa", "nc", "cc0", "spdx", "unlicense", "unencumbered", "redistribution", "redistribute", "warranty", "warranties", "permission", "contributors", "reserved"]
#: Anchors that stand in ordinary sentences; a template's n-grams that hold these alone are under SHARED of it.
WEAK = ["by", "nc", "sa"]
#: Notices and body paragraphs by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "This project is released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "See the License for the specific language governing permissions and limitations under the License"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The Software is provided as is, without warranty of any kind, express or implied"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "Distributed under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "LGPL": ["Licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["Licensed under the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-or-later", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License"],
    "BSD": ["Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "ISC": ["Released under the ISC License", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "Licensed under the Eclipse Public License"],
    "EUPL-1.2": ["Licensed under the EUPL, version 1.2", "SPDX-License-Identifier: EUPL-1.2", "Licensed under the EUPL"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense"],
    "CC-BY": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "Licensed under a Creative Commons Attribution License", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution NonCommercial License"],
    "CC0": ["Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["Copyright. All rights reserved", "This software is proprietary and all rights are reserved"],
}
ORDINARY = ["the driver showed a license at the gate", "students at mit met by the river", "apache is a people of the southwest", "by the house and by the sea", "the warranty of the car ended", "she asked for permission to leave", "a table was reserved by the guests", "the creative writers met by noon", "common land and commons by the road", "he had no licence to fish", "written by hand", "copyright is a matter of law", "a redistribution of land by the king", "going by train", "one by one they left", "the eclipse was seen by many", "the contributors met in spring", "they redistribute bread to the poor", "the licence of the pub was lost", "a wide range of warranties by dealers", "he is licensed to teach", "the license fee was raised by the board"]
WRAPS = ["{}", "{}.", "Note: {}", "{} and so on", "/* {} */", "File notice. {}", "{}, see the file for details", "# {}"]
#: What a family's name looks like before a version, and the version that the family has.
VERSIONS = {"Apache-2.0": (r"apache", "2"), "MPL-2.0": (r"mozilla|mpl", "2"), "EPL-2.0": (r"eclipse|epl", "2"), "EUPL-1.2": (r"eupl", "1.2")}
#: A licence that is denied.
DENIED = r"(?i)\b(?:not|never|no longer|neither)\s+(?:\w+\s+){0,2}?(?:licen[sc]ed|released|distributed|available|covered|dedicated|subject)\b"
#: A line that names a licence.
NAMED = r"(?i)\b(?:licen[sc]e[ds]?|spdx|copyright)\b"
#: Temperatures that calibration tries.
HEAT = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


def grams(w: Column) -> Column:
    """The distinct n-grams, 1 to 3 words, that hold an anchor word."""
    anchors = F.array(*map(F.lit, ANCHORS))
    some = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.slice(w, i + 1, n))
    return F.array_distinct(F.transform(F.filter(F.concat(some(1), some(2), some(3)), lambda g: F.arrays_overlap(g, anchors)), lambda g: F.array_join(g, " ")))


def _fitted(rows: DataFrame, families: list[str]) -> dict:
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(rows)
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.5, maxIter=60, family="multinomial").fit(counted.transform(rows))
    weights = model.coefficientMatrix.toArray()
    return {"families": families, "heat": 1.0, "bias": [float(x) for x in model.interceptVector], "weights": {g: [float(x) for x in weights[:, i]] for i, g in enumerate(counted.vocabulary) if abs(weights[:, i]).max() > 1e-6}}


def train(spark: SparkSession) -> dict:
    """Vocabulary, weights a class, bias, families, the calibrated temperature (heat) and least probability."""
    texts = [(f, wrap.format(t), k % 3 == 2) for f, ts in (TEMPLATES | {UNKNOWN: ORDINARY}).items() for k, t in enumerate(ts) for wrap in WRAPS]
    families = [*TEMPLATES, UNKNOWN]
    rows = spark.createDataFrame([(float(families.index(f)), t, held) for f, t, held in texts], "label double, text string, held boolean").withColumn("grams", let(words(F.col("text")), grams)).coalesce(1).cache()
    first = _fitted(rows.filter("not held"), families)
    held = rows.filter("held")
    loss = lambda heat: F.avg(-F.log(F.get(let(classed(F.col("grams"), first | {"heat": heat}), lambda c: c["all"]), F.col("label").cast("int")) + 1e-12))
    losses = held.agg(*[loss(h).alias(f"h{k}") for k, h in enumerate(HEAT)]).first()
    heat = min(zip(losses, HEAT, strict=True))[1]
    # No held-out ordinary sentence may pass as a licence; never under one half.
    judged = held.filter(F.col("label") == len(families) - 1).select(let(classed(F.col("grams"), first | {"heat": heat}), lambda c: F.struct(c["k"].alias("k"), c["p"].alias("p"))).alias("c"))
    wrong = judged.filter(F.col("c.k") != len(families) - 1).agg(F.max("c.p")).first()[0]
    # No licence is denied for a wrong guess beyond this: the templates confirm each prediction.
    learned = _fitted(rows, families) | {"heat": heat, "least": min(0.9, max(0.5, wrong or 0.0))}
    rows.unpersist()
    return learned


@lru_cache(maxsize=4)
def _trained(application: str) -> dict:
    """train(), once an application: its texts are fixed."""
    return train(SparkSession.active())


def classed(g: Column, model: dict) -> Column:
    """struct(k, p, all): the likeliest class of a paragraph's n-grams, its probability, and those of all classes."""
    table = F.create_map(*[x for gram, w in model["weights"].items() for x in (F.lit(gram), F.array(*map(F.lit, w)))])
    logits = F.aggregate(F.filter(F.transform(g, lambda x: F.try_element_at(table, x)), lambda w: w.isNotNull()), F.array(*map(F.lit, model["bias"])), lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
    shares = let(logits, lambda z: let(F.transform(z, lambda x: F.exp((x - F.array_max(z)) / model["heat"])), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))))
    return let(shares, lambda e: F.struct((F.array_position(e, F.array_max(e)) - 1).cast("int").alias("k"), F.array_max(e).alias("p"), e.alias("all")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array<struct<paragraph, family, probability>>: the confirmed licence paragraphs of each text; n_unknown: lines that name a licence, of no known family."""
    model = _trained(docs.sparkSession.sparkContext.applicationId)
    spark = docs.sparkSession
    rows = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string").select("family", let(words(F.col("text")), grams).alias("g")).collect()
    templates = F.array(*[F.struct(F.lit(model["families"].index(r.family)).alias("k"), F.array(*map(F.lit, r.g)).alias("g")) for r in rows if r.g])
    empty = F.expr("cast(array() as array<struct<paragraph:int,k:int,p:double>>)")

    def judged(line: Column, i: Column) -> Column:
        return let(let(words(line), grams), lambda g: let(classed(g, model), lambda c: F.when(
            (F.size(g) > 0) & (c["k"] < len(TEMPLATES)) & (c["p"] > model["least"])
            & F.exists(templates, lambda t: (t["k"] == c["k"]) & (F.size(F.array_intersect(t["g"], g)) >= SHARED * F.size(t["g"])))
            & ~line.rlike(DENIED) & ~other_version(line, c["k"]),
            F.struct(i.alias("paragraph"), c["k"].alias("k"), c["p"].alias("p")))))

    def other_version(line: Column, k: Column) -> Column:
        named = F.lit(False)
        for family, (name, version) in VERSIONS.items():
            told = F.regexp_extract(line, rf"(?i)\b(?:{name})\b[^0-9\n]{{0,30}}?([0-9]+(?:\.[0-9]+)?)", 1)
            named = F.when(k == model["families"].index(family), (told != "") & ~told.startswith(version)).otherwise(named)
        return named

    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"].rlike(pattern))
    found = F.when(text.rlike(pattern), F.filter(F.transform(lines, lambda y: judged(y["x"], y["i"])), lambda s: s.isNotNull())).otherwise(empty)
    strong = r"(?i)(?<![a-z0-9])(?:" + "|".join(a for a in ANCHORS if a not in WEAK) + r")(?![a-z0-9])"

    def windows(x: Column) -> Column:
        some = lambda i, n: let(F.slice(x, i + 1, F.lit(n)), lambda part: F.struct(i.alias("i"), F.lit(n).alias("n"), F.when((F.size(part) == n) & ~F.exists(part, lambda y: F.trim(y) == ""), F.array_join(part, " ")).alias("x")))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.array(some(i, 2), some(i, 3))))
        return F.transform(F.filter(every, lambda c: F.coalesce(c["x"].rlike(strong), F.lit(False))), lambda c: F.struct(c["n"].alias("n"), judged(c["x"], c["i"]).alias("h")))

    def apart(hits: Column) -> Column:
        start, end = lambda c: c["h"]["paragraph"], lambda c: c["h"]["paragraph"] + c["n"]
        over = lambda a, c: (a["h"]["k"] == c["h"]["k"]) & (start(a) < end(c)) & (start(c) < end(a)) & ((a["n"] < c["n"]) | ((a["n"] == c["n"]) & (start(a) < start(c))))
        return F.filter(hits, lambda c: ~F.exists(hits, lambda a: over(a, c)))

    single = F.transform(found, lambda h: F.struct(F.lit(1).alias("n"), h.alias("h")))
    wrapped = F.filter(let(F.split(text, "\n"), windows), lambda c: c["h"].isNotNull())
    none = F.expr("cast(array() as array<struct<n:int,h:struct<paragraph:int,k:int,p:double>>>)")
    found = F.when(text.rlike(strong), let(F.concat(single, wrapped), apart)).otherwise(none)
    names = F.array(*map(F.lit, model["families"]))
    hits = F.array_sort(F.transform("hits", lambda c: c["h"]))
    told = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), found.alias("hits"))
    # A line within a wrapped notice that was found is not unknown.
    unknown = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"].rlike(NAMED) & ~F.exists("hits", lambda c: (c["h"]["paragraph"] <= y["i"]) & (y["i"] < c["h"]["paragraph"] + c["n"])))
    n_unknown = F.when(F.col("text").rlike(NAMED), F.size(unknown)).otherwise(0).cast("long")
    shown = F.transform(hits, lambda h: F.struct(h["paragraph"].alias("paragraph"), F.get(names, h["k"]).alias("family"), F.round(h["p"], 6).alias("probability")))
    return told.select("doc_id", shown.alias("found"), n_unknown.alias("n_unknown"))
