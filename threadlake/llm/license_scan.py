"""Licence scans by a trained paragraph classifier. DataFrame operations and Spark ML (JVM) only.

Paragraphs (lines, and neighbouring lines that a notice is wrapped over) become sparse counts of hashed word 1- and 2-grams; a multinomial logistic regression, trained on variants of the
licence families' templates, on plain prose and on lines of the scanned documents that no template half holds, gives each family its log-odds against the unknown class.
These are calibrated on held-out variants and held-out lines of the documents: a curve turns them into a probability, and a family is only predicted where it is more
probable than the unknown class and above what all but a stated share of the held-out plain lines have.
A prediction is confirmed by comparing the paragraph with the family's templates, as the share of the template's words that it holds in order of bigrams.

Features are the n-grams that the training rows have; all others would weigh nothing. Every line goes to the classifier but those whose words can't
bring any family's log-odds to the threshold, by an upper bound that is taken from the regression's own weights. Of paragraphs of several lines only those are that match ``CUES``, near a line with a word of ``cue_words``: they count only where they are confirmed,
and a confirmed one has such a word, as in each template fewer bigrams than must be held are free of these words. Each line is split into words once, for both.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.session import Scratch

#: A notice or two of each licence family, in the wording of the public licence texts.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
UNKNOWN = "unknown"
FEATURES = 1 << 14
PARTS = 64  # of the training rows, at most; each gives the driver a gradient per iteration
HALF = 0.5  # share of a template's bigrams from which a line isn't plain
FALSE_ALARMS = 0.001  # share of held-out plain lines that may be taken for a licence
#: Plain paragraphs, some of which talk of licences or share their words without granting one.
PROSE = [
    "the driver renewed a licence last week", "she will attend the public hearing on version two of the plan", "free lunch for any person at the office", "terms of the contract were discussed under pressure",
    "this work was hard and long", "a copy of the report is attached", "the general was released from hospital", "see the file for a list of conditions that are met in winter", "no such thing as a common source",
    "the software was slow", "use the binary search here", "all rights of way are shown on the map", "creative people work at night", "they may not use this road except on sundays", "redistribution of wealth is debated",
    "der die das und ist in den von zu mit", "le la les de des et une dans pour que", "el la los de que y en un una por", "and the of to in is it that was for on with as are", "permission to land was denied",
    "the foundation was laid in spring", "the source of the river is in the hills", "two of the three forms were lost", "please modify the date of the meeting", "his license plate was dirty",
]


def words(text: Column) -> Column:
    """Lower-cased words: letters, digits; runs of digits as 0."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[0-9]+(\.[0-9]+)*", "0"), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def with_grams(rows: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Adds n-grams ``_g``, the words ``_w`` and their bigrams; of a list of wanted ones all that the paragraph has, and few others."""
    single, at = F.col("_w"), F.sequence(F.lit(1), F.size("_w") - 1)
    if wanted is not None:
        first, second = (sorted(set(x)) for x in zip(*(g.split() for g in wanted if " " in g), strict=True))
        single = F.filter("_w", lambda w: w.isin(wanted))
        at = F.filter(at, lambda i: F.element_at("_w", i).isin(first) & F.element_at("_w", i + 1).isin(second))
    pairs = F.transform(at, lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    return rows.withColumn("_g", F.when(F.size("_w") > 1, F.concat(single, pairs)).otherwise(single))


def training_set(spark: SparkSession) -> DataFrame:
    """Variants of each template: whole, without its first or last words, between other words; and prose. A fixed few hundred rows."""
    rows = []
    for family, texts in sorted(TEMPLATES.items()):
        for text in texts:
            words = text.split()
            forms = {text, " ".join(words[1:]), " ".join(words[:-1]), f"// {text}", f"Note: {text} See the site for details.", f"{text} All rights reserved by the authors.", text.upper()}
            forms |= {" ".join(words[: max(4, len(words) * 3 // 4)]), " ".join(words[len(words) // 4 :])} if len(words) > 8 else set()
            rows += [(family, x) for x in sorted(forms) if x]
    for i, text in enumerate(PROSE):
        other = PROSE[(i * 7 + 3) % len(PROSE)]
        rows += [(UNKNOWN, x) for x in (text, f"{text} {other}", f"{other}. {text}.", " ".join(text.split()[:4]), " ".join(text.split()[-3:]))]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "family string, text string, n int")


class Model:
    """A family is predicted where its log-odds against the unknown class are ``margin`` or more; the calibrated probability is 1 / (1 + exp(-slope * log-odds - offset))."""

    def __init__(self, regression: LogisticRegressionModel, families: list[str], margin: float, slope: float, offset: float, known: list[str]):
        self.regression, self.families, self.slope, self.offset, self.known = regression, families, slope, offset, known
        bias = regression.interceptVector.toArray()
        self.margin = max(margin, float((bias[:-1] - bias[-1]).max()) + 1e-3)  # a paragraph without any known n-gram is unknown
        self.strong, self.weak, self.least_weak = self._bound()

    def probability(self, odds: Column) -> Column:
        return 1 / (1 + F.exp(-(odds * self.slope + self.offset)))

    def _bound(self) -> tuple[list[str], list[str], int]:
        """(strong, weak, n): a paragraph without a strong word and with fewer than n weak ones can't reach the threshold.

        A family's log-odds against unknown are those of the intercepts plus the gains of the paragraph's distinct n-grams. A bigram is only there with both its words, so its
        gain is charged to the rarer of them; what a word can bring at most is its own gain and that of all bigrams charged to it, each where positive.
        Words that bring less than a quarter of what is needed are weak; they are bounded by their number.
        """
        tf = HashingTF(numFeatures=FEATURES)
        weights, bias = self.regression.coefficientMatrix.toArray(), self.regression.interceptVector.toArray()
        gain = {g: max(0.0, float((weights[:-1, i] - weights[-1, i]).max())) for g in self.known for i in (tf.indexOf(g),)}
        common = {w for text in PROSE for w in text.split()}
        brings = {g: v for g, v in gain.items() if " " not in g}
        for g, v in gain.items():
            if " " in g:
                a, b = g.split(" ")
                brings[a if b in common and a not in common else b] += v
        needed = max(1e-9, self.margin - float((bias[:-1] - bias[-1]).max()) - 1e-6)
        strong = sorted(w for w, v in brings.items() if v >= needed / 4)
        weak = {w: v for w, v in brings.items() if 0 < v < needed / 4}
        return strong, sorted(weak), math.ceil(needed / max(weak.values())) if weak else 1

    def hopeful(self, words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(self.strong)) | (F.size(F.filter(words, lambda w: w.isin(self.weak))) >= self.least_weak)


def _scored(rows: DataFrame, regression: LogisticRegressionModel, families: list[str], known: list[str]) -> DataFrame:
    """Adds the likeliest family and ``_odds``, its log-odds against the unknown class."""
    tf = HashingTF(numFeatures=FEATURES, inputCol="_f", outputCol="features", binary=True)
    rows = rows.withColumn("_f", F.filter("_g", lambda g: g.isin(known)))
    out = regression.transform(tf.transform(rows)).withColumn("_r", vector_to_array("rawPrediction"))
    each = F.slice("_r", 1, len(families) - 1)
    best = F.array_max(each)
    return out.withColumn("_odds", best - F.element_at("_r", len(families))).withColumn("family", F.element_at(F.array(*map(F.lit, families)), F.array_position(each, best).cast("int")))


def plain_lines(docs: DataFrame, known: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_g, held): the known n-grams of every different line that no template half holds; a fifth of the lines is held out. Null ids' lines aren't taken."""
    return _plain_sets(docs, known, id_col, text_col).select("_g", "held", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def _plain_sets(docs: DataFrame, known: list[str], id_col: str, text_col: str) -> DataFrame:
    """(_g, held, n): the same with the number of lines that have these n-grams. Lines are told apart by a hash, so that what is shuffled of one is that and its few n-grams."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.explode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("_line"))
    lines = lines.select(F.xxhash64("_line").alias("_d"), F.xxhash64("_line", F.lit(1)).alias("_h"), F.explode(F.array(words(F.col("_line")))).alias("_w")).where(F.size("_w") > 0)
    wanted = {*known, *(g for texts in _templates().values() for t in texts for g in t)}
    grams = with_grams(lines, sorted(wanted)).select("_d", "_h", F.array_sort(F.array_distinct(F.filter("_g", lambda g: g.isin(sorted(wanted))))).alias("_g"))
    sets = grams.groupBy("_d", "_h").agg(F.first("_g").alias("_g")).groupBy("_g", (F.pmod("_h", F.lit(5)) == 0).alias("held")).agg(F.count("*").alias("n"))
    sets = sets.where(F.greatest(*(c for family in TEMPLATES for c in _shares(family))) < HALF)
    return sets.groupBy(F.filter("_g", lambda g: g.isin(known)).alias("_g"), "held").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", false_alarms: float = FALSE_ALARMS) -> Model:
    """Fit on four fifths of the templates' variants and of plain lines, then calibrate on the rest.

    Plain lines are all different ones of ``docs`` and the few of ``PROSE``; together the former weigh as much as the variants at most. Lines with the same known n-grams are one row with
    their number as its weight.
    The margin is the greater of the log-odds at which a family is as probable as the unknown class, and of those that at most ``false_alarms`` of the held-out plain lines have.
    """
    families = [*sorted(TEMPLATES), UNKNOWN]
    made = with_grams(training_set(spark).withColumn("_w", words(F.col("text"))))
    made = made.select("family", "_g", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("weight")).cache()  # a few hundred rows
    known = sorted(r["g"] for r in made.where(~F.col("held")).select(F.explode("_g").alias("g")).distinct().collect())
    rows = made
    if docs is not None:
        plain = Scratch(spark, "licences").table(_plain_sets(docs, known, id_col, text_col), "plain")
        share = made.where(~F.col("held")).count() / max(1, plain.where(~F.col("held")).agg(F.sum("n")).first()[0] or 0)
        rows = made.unionByName(plain.select(F.lit(UNKNOWN).alias("family"), "_g", "held", "n", (F.col("n") * min(1.0, share)).alias("weight")))
    rows = rows.withColumn("label", (F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1).cast("double"))
    data = HashingTF(numFeatures=FEATURES, inputCol="_g", outputCol="features", binary=True).transform(rows.where(~F.col("held")))
    data = data.select("features", "label", "weight").coalesce(PARTS).persist(StorageLevel.MEMORY_AND_DISK)
    fit = LogisticRegression(maxIter=60, regParam=0.003, elasticNetParam=0.0, family="multinomial", featuresCol="features", labelCol="label", weightCol="weight")
    regression = fit.fit(data)
    back = _scored(rows.where("held").withColumnRenamed("family", "true"), regression, families, known).select("true", "family", "n", "_odds")
    back = back.groupBy("true", "family", "_odds").agg(F.sum("n").alias("n")).coalesce(PARTS).persist(StorageLevel.MEMORY_AND_DISK)
    slope, offset = _curve(back)
    plain = back.where(F.col("true") == UNKNOWN)
    over = math.floor(false_alarms * (plain.agg(F.sum("n")).first()[0] or 0)) + 1
    least = -math.inf
    for r in plain.orderBy(F.desc("_odds")).limit(over).select("_odds", "n").collect():  # a thousandth of the held-out lines' different log-odds at most
        over -= r["n"]
        if over <= 0:
            least = r["_odds"] + 1e-6
            break
    for cached in (made, data, back):
        cached.unpersist()
    return Model(regression, families, max(-offset / slope, least), slope, offset, known)


def _curve(back: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out log-odds, of variants under their own family against plain lines; both kinds weigh the same."""
    rows = back.where((F.col("true") == UNKNOWN) | (F.col("true") == F.col("family"))).select((F.col("true") != UNKNOWN).cast("double").alias("label"), "n", array_to_vector(F.array("_odds")).alias("features"))
    n1, n0 = (max(1, rows.where(F.col("label") == v).agg(F.sum("n")).first()[0] or 0) for v in (1.0, 0.0))
    rows = rows.withColumn("weight", F.col("n") * F.when(F.col("label") == 1.0, 1.0 / n1).otherwise(1.0 / n0))
    curve = LogisticRegression(maxIter=60, regParam=0.001, family="binomial", weightCol="weight").fit(rows)
    return max(1e-3, float(curve.coefficients[0])), float(curve.intercept)


def _templates() -> dict[str, list[list[str]]]:
    import re

    out = {}
    for family, texts in TEMPLATES.items():
        out[family] = []
        for text in texts:
            words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"[0-9]+(\.[0-9]+)*", "0", text.lower())) if w]
            out[family].append([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    return out


def _shares(family: str) -> list[Column]:
    """Of each template of the family, the share of its bigrams that the paragraph holds."""
    return [F.size(F.array_intersect(F.col("_g"), F.array(*map(F.lit, sorted(set(t)))))) / F.lit(float(len(set(t)))) for t in _templates()[family]]


def closeness(families: list[str]) -> Column:
    """The greatest share of a template's bigrams that the paragraph holds, over the templates of its predicted family."""
    out = F.lit(0.0)
    for family in families[:-1]:
        out = F.when(F.col("family") == family, F.greatest(*_shares(family), F.lit(0.0))).otherwise(out)
    return out


#: What a paragraph of several lines needs before it is classified. In each template, less than the confirming share of bigrams is without a cue, so that
#: nothing that can be confirmed lacks one; each cue stands in a line, so that a paragraph of several lines has one where its lines do.
CUES = r"(?im)licen[cs]|permission|redistribut|\bcommons\b|attribution|copyright|\bcc\b|mozilla|software|\bthe\W+mit\b|^\W*mit\b|\bgnu\b|apache|compliance|\bobtain|except|\bbinary\b|modif|permitted|conditions|hereby|documentation|published|foundation|subject|source\W+code|^\W*code\b|spdx|gpl|\bepl\b|or\W+later|\bcc0|waived|neighbou?ring|\brights\b|\bisc\b|\bbsd\b|\bmpl\b|unlicense|unencumbered|\breleased\b|public\W+domain|possible\W+under|to\W+the\W+extent|universal|without\W+fee|distribute|retain|reproduce|disclaimer|endorse|promote|derived|materials|eclipse|affero|accompanying|available|terms\W+of"
WINDOW = 8  # lines that a wrapped notice takes at most; the longest template has 210 letters
CLIP = 400  # letters of a line that lines beside it may share a notice with
WORD = r"[\p{L}\p{N}]"


def cue_words(confirm: float = 0.6) -> list[str]:
    """Words of which a paragraph has one where it holds ``confirm`` of a template's bigrams: of each template the longest, those that most lines have last, until fewer of its bigrams are free of all."""
    out, common = set(), {"and", "any", "as", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"}
    for texts in _templates().values():
        for pairs in map(set, texts):
            for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (w in common, -len(w), w)):
                if sum(out.isdisjoint(p.split()) for p in pairs) < confirm * len(pairs):
                    break
                out.add(word)
    return sorted(out)


def _units(lines: Column, model: Model, cues: list[str]) -> Column:
    """(at, words, part) of what may hold a notice: the words of each line that may reach the model's margin, and, as parts, the lines from each line that is near enough to one with a cue."""
    every = F.transform(F.filter(lines, lambda x: model.hopeful(x["words"])), lambda x: F.struct(x["at"].alias("at"), x["words"].alias("words"), F.lit(None).cast("array<string>").alias("part")))
    near = lambda x, k: F.when(k == 0, F.substring(x["line"], -CLIP, CLIP)).otherwise(F.substring(x["line"], 1, CLIP))
    size = max(map(len, cues)) + 1  # letters beside a clip's end, where what is left of a word may be a cue
    ends = lambda x: F.concat_ws(" ", F.substring(x["line"], CLIP + 1 - size, size), F.substring(x["line"], -CLIP, size))
    cued = lambda x: F.exists(x["words"], lambda w: w.isin(cues)) | ((F.length(x["line"]) > CLIP) & F.exists(words(ends(x)), lambda w: w.isin(cues)))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(lines, cued), lambda x: F.sequence(F.greatest(x["at"] - (WINDOW - 1), F.lit(0)), x["at"]))))
    wide = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(None).cast("array<string>").alias("words"), F.transform(F.slice(lines, i + 1, WINDOW), near).alias("part")))
    return F.concat(every, wide)


def _wrapped(found: DataFrame) -> DataFrame:
    """The confirmed paragraphs of several lines: those closer to a template than each confirmed line of theirs, the closest first, then the shortest, none that shares a line with another."""
    ahead = Window.partitionBy("row").orderBy("paragraph").rangeBetween(0, WINDOW - 1)
    alone = F.collect_list(F.when(F.col("n") == 1, F.struct("paragraph", "closeness"))).over(ahead)
    beaten = F.forall("_alone", lambda x: (x["paragraph"] >= F.col("paragraph") + F.col("n")) | (x["closeness"] < F.col("closeness")))
    free = found.where("confirmed").withColumn("_alone", alone).where((F.col("n") > 1) & beaten).drop("_alone")
    unit = F.struct((-F.col("closeness")).alias("far"), "n", "paragraph", "row", "doc_id", "family", "probability", "closeness", "confirmed")
    held = free.groupBy("row").agg(F.array_sort(F.collect_list(unit)).alias("u"))
    shares = lambda x, y: (y["paragraph"] < x["paragraph"] + x["n"]) & (x["paragraph"] < y["paragraph"] + y["n"])
    kept = F.aggregate("u", F.slice("u", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: shares(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return held.select(F.explode(kept).alias("x")).select("x.*")


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """(doc_id, paragraph, family, probability, closeness, confirmed) of each paragraph with a licence family; paragraph counts lines from 0.

    A paragraph is a line, or up to ``WINDOW`` neighbouring lines with words that hold a hard-wrapped notice; one of several lines goes by its first, and
    is only returned, in place of its lines, where it is confirmed and closer to a template than each of them that is. A family
    below the calibrated margin is unknown and not returned; probability is the calibrated one. Null and empty texts have no paragraph. Null ids, repeated ids and rows are scanned like any others.
    """
    model = model or train(docs.sparkSession, docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    line = lambda x, i: F.struct(i.alias("at"), x.alias("line"), words(x).alias("words"))
    base = base.select("doc_id", "row", F.transform(F.split("text", "\n", -1), line).alias("lines"))
    base = base.select("doc_id", "row", F.explode(_units(F.col("lines"), model, cue_words(confirm))).alias("p"))  # on its own: ids made beside it would number units, not rows
    lengths = F.when(F.col("p.part").isNull(), F.array(F.lit(1))).when(F.size("p.part") > 1, F.sequence(F.lit(2), F.size("p.part")))
    each = base.select("doc_id", "row", F.col("p.at").alias("paragraph"), F.col("p.words").alias("words"), F.col("p.part").alias("part"), F.explode(lengths).alias("n"))
    part = F.slice("part", 1, F.col("n"))
    each = each.where((F.col("n") == 1) | (F.forall(part, lambda x: x.rlike(WORD)) & F.array_join(part, " ").rlike(CUES)))
    # exploded, not filtered: a filter on the words would be pushed below them, and split the text again
    found = F.when(F.col("n") == 1, F.array("words")).otherwise(F.filter(F.array(words(F.array_join(part, " "))), model.hopeful))
    lines = each.select("doc_id", "row", "paragraph", "n", F.explode(found).alias("_w"))
    wanted = {*model.known, *(g for texts in _templates().values() for t in texts for g in t)}
    scored = _scored(with_grams(lines, sorted(wanted)), model.regression, model.families, model.known)
    # exploded, not filtered: a filter on what the model says would be pushed below it, and score again
    hit = F.struct("family", "_odds", "_g")
    hits = F.when(F.col("_odds") >= model.margin, F.array(hit)).otherwise(F.array().cast("array<struct<family:string,_odds:double,_g:array<string>>>"))
    scored = scored.select("doc_id", "row", F.col("paragraph").cast("long").alias("paragraph"), "n", F.explode(hits).alias("h")).select("doc_id", "row", "paragraph", "n", "h.family", "h._odds", "h._g")
    scratch = Scratch(docs.sparkSession, "licences")
    found = scratch.table(scored, "scored")
    found = found.withColumn("closeness", F.round(closeness(model.families), 6)).withColumn("probability", F.round(model.probability(F.col("_odds")), 6)).withColumn("confirmed", F.col("closeness") >= confirm)
    columns = ["doc_id", "paragraph", "family", "probability", "closeness", "confirmed"]
    wrapped = scratch.table(_wrapped(found.drop("_g", "_odds")), "wrapped")
    inside = wrapped.select("row", F.explode(F.sequence("paragraph", F.col("paragraph") + F.col("n") - 1)).alias("paragraph"))
    return found.where("n = 1").join(inside, ["row", "paragraph"], "left_anti").select(*columns).unionByName(wrapped.select(*columns))


def by_document(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_licences, families, licence): per row of ``docs`` the confirmed paragraphs of its id, their families sorted, and the family of the most probable,
    else unknown. Equal probabilities go to the earlier paragraph, then the later name. Rows that repeat an id, a null one too, get the same; an empty table an empty result."""
    sure = found.where("confirmed").groupBy(F.col("doc_id").alias("_d")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max_by("family", F.struct("probability", -F.col("paragraph"), "family")).alias("licence"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(sure, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("licence", F.lit(UNKNOWN)).alias("licence"))
