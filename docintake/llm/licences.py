"""Licence scan: a trained paragraph classifier whose findings are confirmed against templates.

Paragraphs are the runs of non-blank lines of a text. What is scored are a paragraph's windows: each line, and
each stretch of neighbouring lines that a notice of ``SPAN`` words, the longest template's, can reach over, so
notices may be wrapped in any way and several may stand in one paragraph. Of a family's windows those count
that no smaller one inside matches as well; one inside a better match of another family is a part of that.
A paragraph's findings are its families. Features are the distinct word 1- to 3-grams of a window; the
classifier is a sparse (elastic-net) multinomial logistic regression over licence families and an unknown
class, trained by Spark's own LogisticRegression on texts made from ``TEMPLATES`` by rule, on hard negatives
made from their words, on notices of other licences (``OTHERS``), and on a bounded sample of the corpus's lines
(``NEGATIVES``, but those that a template confirms) as unknown. British spelling counts as American.
Probabilities are calibrated by a temperature, fitted on training rows held out from it. A finding needs
family probability of at least ``CONFIDENT`` and above the unknown class's, and a template of that family of
whose n-grams the window holds the share ``CONFIRM``, n-grams of few families weighing more.

Every paragraph is scored. Words outside the vocabulary become gaps first, so a window's n-grams are those that
the model or a template has; a window without any gets the intercepts' answer, which is unknown.

Everything on the main path is DataFrame functions and Spark's own transformers: n-grams by higher-order functions,
scores row by row, without a shuffle; only windows that the model takes for a licence are joined with the templates
(a small table that is broadcast; its size is set by TEMPLATES).

Defined cases: null and empty texts have no paragraphs and no findings; repeated rows each get a row (rows
are told apart by a hash of their text, so equal rows share their findings); very long texts and lines are
taken whole; of equally probable families all that are confirmed count; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docintake.llm.common import bounded_sample, stored, table, with_texts

# Notices that licences ask to be put on works, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "Zlib": ["Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
}
# Notices of licences that are no family here, and of none.
OTHERS = [
    "This work is licensed under the Eclipse Public License, version 2.",
    "Licensed under the Eclipse Public License - v 1.0",
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This project is licensed under the Artistic License 2.0.",
    "Released under the Microsoft Public License.",
    "Licensed under the Server Side Public License, version 1.",
    "Use of this software is governed by the Business Source License 1.1.",
    "Licensed under the Elastic License 2.0.",
    "This program is licensed under the Open Software License version 3.0.",
    "Released under the Python Software Foundation License, version 2.",
    "Licensed under the Common Public Attribution License, version 1.0.",
    "This work is licensed under the Academic Free License, version 3.",
    "Licensed under the Universal Permissive License, version 1.0.",
    "This library is licensed under the IBM Public License.",
    "Licensed under the Mulan Permissive Software License, Version 2.",
    "This work is licensed under a proprietary license.",
    "This program is commercial software: you may not redistribute it or modify it.",
    "Copyright 2020 the authors. All rights reserved.",
    "This software is confidential and proprietary; unauthorized copying of this file is prohibited.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "SPDX-License-Identifier: EUPL-1.2",
    "The license of this driver has expired.",
    "See the license for the terms that apply to this file.",
]
UNKNOWN = "unknown"
#: Lines of the corpus that serve as unknown in training, and the texts that they are taken from, at most.
NEGATIVES, NEGATIVE_TEXTS = 2000, 500
CONFIDENT, CONFIRM = 0.5, 0.6
GRAM = 3
#: Lines of a paragraph whose windows one row makes.
CHUNK_LINES = 128
#: What is between paragraphs.
BLANK = r"\n\s*\n"
#: Words of most texts: n-grams of these alone are no features.
COMMON = {"a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "may", "no", "not", "of", "on", "or", "that", "the", "this", "to", "will", "with", "you"}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower().replace("licence", "license"))


#: Words of the longest template.
SPAN = max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)


def grams_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(words) - n + 1)})


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit("[a-z0-9]+"), F.lit(0))


def grams_column(words: Column) -> Column:
    """Distinct word 1- to GRAM-grams that hold no gap (null). ``words`` is bound to a lambda's variable, so it is
    computed once."""

    def runs(w: Column, n: int) -> Column:
        if n == 1:
            return w
        return F.transform(w, lambda x, i: F.when(x.isNotNull(), F.concat(x, *(c for k in range(1, n) for c in (F.lit(" "), F.get(w, i + k))))))

    every = F.transform(F.array(words), lambda w: F.array_compact(F.array_distinct(F.concat(*(runs(w, n) for n in range(1, GRAM + 1))))))
    return F.get(every, 0)


def training_rows() -> list[tuple[str, list[str], bool]]:
    """(family, n-grams, is it kept for calibration) made by rule from the templates: whole, within filler words,
    with a word left out, and cut at the end; as unknown: the words in reversed order, every other word, single words
    and pairs, the words that all templates share, and OTHERS, whole, within filler words and with a word left out."""
    out: list[tuple[str, list[str]]] = []
    filler = ["see", "the", "file", "for", "details", "copyright", "2020", "authors", "all", "in", "this", "and"]

    def variants(family: str, w: list[str]) -> list[tuple[str, list[str]]]:
        rows = [(family, w)] * 2 + [(family, filler[i : i + 3] + w + filler[i + 4 : i + 9]) for i in range(5)]
        return rows + [(family, w[:i] + w[i + 1 :]) for i in range(min(len(w), 12))]

    named = set(words_of(" ".join([*TEMPLATES, *(t for t in map(str.lower, TEMPLATES))]))) | {"gnu", "affero", "lesser", "mozilla", "apache", "boost", "creative", "commons", "documentation"}
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = words_of(t)
            out += variants(family, w) if len(w) > 8 else [(f, x) for f, x in variants(family, w) if named & set(x)]
            out += [(family, w[: -(-len(w) * k // 10)]) for k in (8, 9) if len(w) > 10]
            out += [(UNKNOWN, w[::-1]), (UNKNOWN, w[::2]), (UNKNOWN, w[1::2]), (UNKNOWN, sorted(w)), (UNKNOWN, filler)]
            out += [(UNKNOWN, w[i : i + 2] + filler[i % 6 : i % 6 + 5]) for i in range(0, min(len(w) - 1, 12), 2)]
    for t in OTHERS:
        out += variants(UNKNOWN, words_of(t))
    out += [(UNKNOWN, words_of(x)) for x in ("licensed under", "this work is licensed under", "released under the license", "the license of this work", "all rights reserved", "version 2 0", "see the license", "free software", "a public license", "this work is under a license", "licensed under the public license version", "spdx license identifier")] * 2
    return [(f, grams_of(w), k % 5 == 4) for k, (f, w) in enumerate(out)]


def template_grams() -> list[tuple[str, str, int, float]]:
    """(n-gram, family, template, share): shares of a template add up to 1; n-grams of few families weigh more."""
    of: dict[str, set[str]] = {}
    for f, texts in TEMPLATES.items():
        for t in texts:
            for g in grams_of(words_of(t)):
                of.setdefault(g, set()).add(f)
    weight = {g: math.log(1 + len(TEMPLATES) / len(fs)) for g, fs in of.items()}
    out = []
    for f, texts in TEMPLATES.items():
        for n, t in enumerate(texts):
            grams = grams_of(words_of(t))
            total = sum(weight[g] for g in grams)
            out += [(g, f, n, weight[g] / total) for g in grams]
    return out


def like_templates(hits: DataFrame, unit: list[str]) -> DataFrame:
    """unit, family, containment: of the n-grams (unit, gram) in the family's likest template, where at least CONFIRM."""
    template = F.broadcast(hits.sparkSession.createDataFrame(template_grams(), "gram string, family string, template int, share double"))
    like = hits.join(template, "gram").groupBy(*unit, "family", "template").agg(F.sum("share").alias("containment"))
    return like.groupBy(*unit, "family").agg(F.max("containment").alias("containment")).filter(F.col("containment") >= CONFIRM)


class Model:
    """The vocabulary and the regression as Spark holds them; weights by n-gram and family, intercepts, temperature."""

    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], temperature: float):
        self.vocabulary, self.regression, self.families, self.temperature = vocabulary, regression, families, temperature
        weight = regression.coefficientMatrix.toArray()
        grams = [(w, *map(float, weight[:, i])) for i, w in enumerate(vocabulary.vocabulary) if abs(weight[:, i]).max() > 1e-6]
        self.grams, self.intercept = grams, regression.interceptVector.toArray().tolist()
        #: Words of the vocabulary, and those of them that every n-gram of it has one of.
        every = {g for g, *_ in grams} | {g for g, *_ in template_grams()}
        self.words = {w for g in every for w in g.split()}
        self.telling = self.words - COMMON


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    spark = docs.sparkSession
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows = training_rows()
    made = spark.createDataFrame([(f, float(families.index(f)), g, held) for f, g, held in rows], "family string, label double, grams array<string>, held boolean")
    some = with_texts(bounded_sample(docs.select(key).filter(F.col(key).isNotNull()), key, NEGATIVE_TEXTS), docs, key, text)
    lines = some.select(F.explode(F.split(F.col(text).cast("string"), "\n")).alias("line")).filter(F.col("line").rlike("[a-zA-Z0-9]"))
    plain = stored(bounded_sample(lines.distinct(), "line", NEGATIVES).withColumn("grams", grams_column(words_column(F.col("line")))), "licence-lines")
    plain = plain.join(like_templates(plain.select("line", F.explode("grams").alias("gram")), ["line"]), "line", "left_anti")
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.lit(float(len(families) - 1)).alias("label"), "grams", (F.pmod(F.xxhash64("line"), F.lit(5)) == 4).alias("held"))
    counts = Counter(g for _, grams, _ in rows for g in grams)
    vocabulary = CountVectorizerModel.from_vocabulary(sorted(g for g, n in counts.items() if n > 1 and not set(g.split()) <= COMMON), "grams", "features")
    vocabulary.setBinary(True)
    rows = stored(made.unionByName(plain), "licence-rows")
    train = stored(vocabulary.transform(rows.coalesce(1)), "licence-features")
    model = LogisticRegression(regParam=0.002, elasticNetParam=0.3, maxIter=40, family="multinomial").fit(train.filter(~F.col("held")))
    # Temperature: the one that gives the rows held out from training the largest likelihood.
    raw = [(r["rawPrediction"].toArray(), int(r["label"])) for r in model.transform(train.filter("held")).select("rawPrediction", "label").collect()]  # bounded like the training rows

    def loss(t: float) -> float:
        return sum(math.log(sum(math.exp((x - max(z)) / t) for x in z)) - (z[y] - max(z)) / t for z, y in raw)

    return Model(vocabulary, model, families, min((0.4, 0.5, 0.65, 0.8, 1.0, 1.25, 1.6, 2.0), key=loss))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, paragraph (from 0), paragraph_text: the runs of non-blank lines of each text."""
    return docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.col(text).cast("string"), BLANK)).alias("paragraph", "paragraph_text")).filter(F.col("paragraph_text").rlike("[a-zA-Z0-9]"))


def chunks_column(paragraph: Column) -> Column:
    """(start, lines) of a paragraph's chunks: ``CHUNK_LINES`` of its lines that have letters or digits, and the ones that
    follow as far as windows reach, so a long paragraph is many rows of a bounded number of lines."""
    lines = F.filter(F.split(paragraph, "\n"), lambda x: F.lower(x).rlike("[a-z0-9]"))
    starts = lambda x: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK_LINES)))
    cut = lambda x: F.transform(starts(x), lambda i: F.struct(i.alias("start"), F.slice(x, i + 1, CHUNK_LINES + SPAN + 1).alias("lines")))
    return F.get(F.transform(F.array(lines), cut), 0)


def windows_column(chunk: Column, model: Model) -> Column:
    """(first line, last line, words) of each window of a chunk's first ``CHUNK_LINES`` lines that holds a telling word:
    lines between the first and the last have less than SPAN words. Words outside the vocabulary are gaps (null). Arrays
    are bound to lambda variables once."""

    def windows(lines: Column) -> Column:
        def more(i: Column, at: Column) -> Column:  # at: (windows that begin with line i, words of the last, words in between)
            def longer(acc: Column, line: Column) -> Column:
                grown = F.concat(acc["words"], line["words"])
                tells = acc["tells"] | line["tells"]
                new = F.struct(F.concat(acc["found"], F.array(F.struct(i.alias("first"), (i + F.size(acc["found"])).alias("last"), tells.alias("tells"), grown.alias("words")))).alias("found"), grown.alias("words"), tells.alias("tells"), (acc["inner"] + F.size(line["words"])).alias("inner"))
                return F.when((F.size(acc["found"]) > 1) & (acc["inner"] >= SPAN), acc).otherwise(new)

            none = F.struct(F.array().cast("array<struct<first:int,last:int,tells:boolean,words:array<string>>>").alias("found"), F.array().cast("array<string>").alias("words"), F.lit(False).alias("tells"), (-F.size(at["words"])).alias("inner"))
            return F.aggregate(F.slice(lines, i + 1, SPAN + 1), none, longer, lambda acc: F.filter(acc["found"], lambda x: x["tells"]))

        every = F.flatten(F.transform(F.slice(lines, 1, CHUNK_LINES), lambda line, i: more(i, line)))
        return F.when(F.exists(lines, lambda line: line["tells"]), every)

    def read(line: Column) -> Column:
        words = F.transform(words_column(line), lambda w: F.when(w.isin(*sorted(model.words)), w))
        return F.get(F.transform(F.array(words), lambda x: F.struct(x.alias("words"), F.exists(x, lambda w: F.coalesce(w.isin(*sorted(model.telling)), F.lit(False))).alias("tells"))), 0)

    lines = F.transform(chunk["lines"], read)
    return F.get(F.transform(F.array(lines), windows), 0)


def tight(found: DataFrame) -> DataFrame:
    """The findings (id, paragraph, first, last, family, containment, ...) that count: see the module's text."""
    where = ["id", "paragraph"]

    def pairs(rows: DataFrame) -> DataFrame:
        """Findings inside others of their paragraph; a window has SPAN + 1 lines at most."""
        outer = rows.select(*where, F.struct("first", "last", "family", "containment").alias("outer"), F.explode(F.sequence("first", "last")).alias("line"))
        inner = rows.select(*where, F.col("first").alias("line"), F.struct("first", "last", "family", "containment").alias("inner"))
        return outer.join(inner, [*where, "line"]).filter("inner.last <= outer.last AND (inner.first > outer.first OR inner.last < outer.last)")

    name = ["first", "last", "family"]
    loose = pairs(found).filter("inner.family = outer.family AND inner.containment >= outer.containment").select(*where, *(F.col(f"outer.{c}").alias(c) for c in name)).distinct()
    kept = stored(found.join(loose, [*where, *name], "left_anti"), "licence-tight")
    part = pairs(kept).filter("inner.family <> outer.family AND inner.containment < outer.containment").select(*where, *(F.col(f"inner.{c}").alias(c) for c in name)).distinct()
    return kept.join(part, [*where, *name], "left_anti")


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per confirmed finding (paragraph and family): key, paragraph, family, probability, unknown_probability, containment."""
    unit = ["id", "paragraph", "first", "last"]
    rows = paragraphs(docs, key, text).select("id", "paragraph", F.explode(chunks_column(F.col("paragraph_text"))).alias("c"))
    rows = rows.select("id", "paragraph", "c.start", F.explode(windows_column(F.col("c"), model)).alias("w"))
    rows = rows.select("id", "paragraph", (F.col("start") + F.col("w.first")).alias("first"), (F.col("start") + F.col("w.last")).alias("last"), grams_column(F.col("w.words")).alias("grams"))
    raw = model.regression.transform(model.vocabulary.transform(rows)).select(*unit, "grams", vector_to_array("rawPrediction").alias("raw"))

    def shares(z: Column) -> Column:  # softmax; arrays are bound to lambda variables, so each is computed once
        once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
        e = once(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / model.temperature)))
        return once(e, lambda e: once(F.aggregate(e, F.lit(0.0), lambda p, q: p + q), lambda total: F.transform(e, lambda x: x / total)))

    # What is left of all windows: those that the model takes for a licence. A filter would be pushed below the scores
    # and compute them again; a generator isn't.
    likely = F.filter(F.array(F.struct(*unit, "grams", F.get(F.transform(F.array("raw"), shares), 0).alias("p"))), lambda r: F.array_max(F.slice(r["p"], 1, len(model.families) - 1)) >= CONFIDENT)
    scored = stored(raw.select(F.explode(likely).alias("r")).select("r.*"), "licence-scored")
    hits = scored.select(*unit, F.explode("grams").alias("gram"))
    scored = scored.select(*unit, F.element_at("p", -1).alias("unknown_probability"), F.posexplode(F.slice("p", 1, len(model.families) - 1)).alias("class", "probability"))
    scored = scored.filter((F.col("probability") >= CONFIDENT) & (F.col("probability") > F.col("unknown_probability")))
    scored = scored.select(*unit, F.element_at(F.lit(model.families), F.col("class") + 1).alias("family"), "probability", "unknown_probability")
    like = like_templates(hits, unit)
    found = tight(stored(scored.join(like, [*unit, "family"]), "licence-windows"))
    best = found.groupBy("id", "paragraph", "family").agg(F.max(F.struct("probability", "containment", "unknown_probability")).alias("best"))
    return best.select(F.col("id").alias(key), "paragraph", "family", "best.probability", "best.unknown_probability", "best.containment")


def scan_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_paragraphs, n_findings, licences (families, sorted, comma-joined; empty:
    none), probability (the surest finding's, or null)."""
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("id"), body.alias("text"), F.xxhash64(body).alias("same"))
    thin = rows.select("id", "same", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), lambda x: x.rlike("[a-zA-Z0-9]"))).alias("n_paragraphs"))
    found = scan(rows.select(F.struct("id", "same").alias("who"), "text"), model, "who", "text")
    per = found.groupBy("who").agg(F.count(F.lit(1)).alias("n_findings"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"), F.max("probability").alias("probability"))
    per = stored(per.select("who.id", "who.same", "n_findings", "licences", "probability"), "findings")
    out = thin.join(per, (thin["id"].eqNullSafe(per["id"])) & (thin["same"] == per["same"]), "left")
    return out.select(thin["id"].alias(key), "n_paragraphs", F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"), F.coalesce("licences", F.lit("")).alias("licences"), "probability")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, fit(docs))
