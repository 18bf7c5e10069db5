"""License scans: a trained paragraph classifier, in DataFrame functions and Spark ML only.

A text is cut into paragraphs' sentences: at blank lines, after a full stop before a capital, and before lines that begin as notices
do; a line break within a sentence is a space, so a notice may be wrapped anywhere.  Of a sentence the *passages* are classified:
runs of its telling words, at most ``GAP`` words apart, with ``PAD`` words on both sides.  The classifier takes sparse word 1- to 3-grams and
gives multinomial logistic regression over the families, ``unknown`` (a notice of no listed family) and ``none``.

Which words are telling follows from the fitted coefficients (``telling_words``): n-grams without any of them can't lift a class
above ``none``, whichever occur together, so what is passed by would be ``none`` if it were classified.

The classifier is trained here on notices made by rule from the fixed names and phrases below; a third of them, chosen by hash,
is held out.  A penalty on the sum of coefficients leaves few n-grams that count, so few words are telling.  The probability from which a family counts is calibrated on the held-out notices that are of no family: at most
``FALSE_ACCEPT`` of these reach it.  A family that does not reach it becomes ``unknown``.

A prediction is then confirmed by comparison with the family's templates: the share of a template's word pairs that the passage
has must reach ``CONFIRM`` for one of them; else it becomes ``unknown``, too.

One decision owns its sentences: notices of one family in sentences that follow each other are one notice, as are ``unknown`` ones beside
those of a family, unless a blank line or a line that begins as notices do lies between.

Results go back to their document by a number given to each row where it is read; texts are not shuffled.

Edge cases: null or empty text has no paragraphs; very long ones are compared whole, in time that grows with their length; repeated
rows are reported each; an empty table gives no rows; columns of other names are passed by.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FALSE_ACCEPT = 0.01
#: The calibrated probability is at least this.
LEAST = 0.5
CONFIRM = 0.8
#: Bound of the n-grams that the classifier knows; training fails if the notices made here reach it.
VOCABULARY = 40_000
#: Telling words further apart are of different passages; the words on either side that go with a passage, at most half as many.
GAP, PAD = 12, 6

#: What notices of each family call their licence.
NAMES = {
    "MIT": ("the MIT License", "MIT license", "the MIT licence", "the MIT/Expat License", "an MIT-style license"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "Apache-2.0", "the Apache Software License, Version 2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0", "GPLv3", "the GNU General Public License, version 3 or later"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0", "GPLv2"),
    "LGPL": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "LGPL-2.1", "the GNU LGPL", "LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "AGPL-3.0", "the GNU AGPL v3", "AGPLv3"),
    "BSD": ("the BSD 3-Clause License", "a BSD-style license", "the New BSD License", "BSD-3-Clause", "the 2-clause BSD license", "the BSD License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL-2.0", "the Mozilla Public License 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "a Creative Commons Attribution license"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal public domain dedication", "CC0-1.0", "Creative Commons Zero"),
}
#: Sentences of the licences themselves.
PHRASES = {
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    "Apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "GPL-3.0": ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPL-2.0": ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",),
    "BSD": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}
#: How notices begin and end, and sentences that follow them.
OPENINGS = ("Licensed under", "Released under", "This work is licensed under", "This software is distributed under the terms of", "The code is available under", "Published under", "Distributed under", "Available under", "All files are covered by", "License:", "Use of this source code is governed by")
ENDINGS = ("", ".", ", unless noted otherwise.", " since 2019.")
FOLLOWING = ("See the LICENSE file for details.", "Copyright 2021 the authors.", "All rights reserved.")
#: Names of no listed family; in the second ones a made-up word comes in.
OTHERS = ("the Example Community License", "the Acme Public License, version 1.1", "a proprietary license", "the terms of our customer agreement", "the Open Widget License 2.0", "the Sample Software License, Version 3", "an internal license", "the Foo Attribution License 4.0", "the Regional Data License, version 2", "a commercial license")
OTHER_FORMS = ("{}", "the {}", "the {} 1.2", "the {} License", "the {} Public License", "the {} License, Version 2.0", "the {} terms", "the {} Software License", "the terms of the {} License")
OTHER_WHOLE = ("{} terms apply", "{} Software terms apply", "{} license terms apply", "The {} License applies", "Subject to the {} License")
#: Sentences that mention such words without being a notice, and such that mention a licence by name.
MENTIONS = (
    "a driver's license is required to rent a car", "the license plate was hard to read", "she studied copyright law for three years", "the Apache helicopter landed in the field", "poetic license is allowed here",
    "fishing licences are sold at the harbour", "der Zug fährt mit der Lizenz des Landes", "the public domain of knowledge grows every year", "a general with a version of the story", "is it an open question",
    "the leaflets were distributed under pressure", "the album was released under another title", "tickets are available under the stairs", "the book was published under a false name", "the water was released under the bridge",
    "the terms of the contract apply to all", "software terms are hard to read", "the source of the river is in the mountains", "permission to leave was granted by the general", "a copy of the letter is in the file",
)
NAMED = (
    "she went to {} office", "he wrote a book on {} and its history", "the class compared {} with others", "lawyers argued about {} for hours", "what does {} mean", "the author of {} gave a talk",
    "many people dislike {} and say so", "we were asked about {} yesterday", "an article on {} appeared in the paper", "they read {} aloud in court", "the text of {} was hard to read", "her lecture covers {} as an example",
)
#: Fixed value: frequent words, of which prose is made by rule.
FREQUENT = "the of and to in a is that it for on with as was at by an be this are from or not all any you may under use which have has had its".split()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """Word 1-, 2- and 3-grams, repeats included."""
    run = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, run(2), run(3))


def _pairs(words: Column) -> Column:
    """Distinct word pairs; of one word the word."""
    return F.when(
        F.size(words) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " ")))
    ).otherwise(words)


def _number(*key) -> int:
    return int.from_bytes(hashlib.md5(repr(key).encode()).digest()[:6], "big")


def prose(n: int, key) -> str:
    """``n`` frequent words, drawn by a hash."""
    return " ".join(FREQUENT[_number(key, i) % len(FREQUENT)] for i in range(n))


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)


def templates() -> dict[str, list[str]]:
    """Names and the sentences of the phrases of each family."""
    return {f: [*NAMES[f], *(t for p in PHRASES.get(f, ()) for t in _sentences(p))] for f in NAMES}


def notices() -> list[tuple[str, str, str]]:
    """(family, notice, form) by rule from the fixed values; the form is what is about the name."""
    made_up = lambda *key: "".join("bcdfglmnprstvz"[_number(*key, i) % 14] + "aeiou"[_number(*key, i, "v") % 5] for i in range(3 + _number(*key) % 2)).capitalize()
    made = [(f, f"{a} {n}{z}", f"{a}|{z}") for f, of in {**NAMES, "unknown": OTHERS}.items() for n in of for a in OPENINGS for z in ENDINGS]
    made += [("unknown", f"{a} {o.format(made_up(o, i, a, z))}{z}", f"{a}|{z}") for o in OTHER_FORMS for i in range(4) for a in OPENINGS for z in ENDINGS]
    made += [("unknown", o.format(made_up(o, i)) + z, o) for o in OTHER_WHOLE for i in range(8) for z in ("", ".")]
    made += [(f, n + z, "|" + z) for f, of in NAMES.items() for n in of for z in ("", ".")] * 2
    made += [(f, f"{a}{t}{z}", f"{a}|{z}") for f, of in PHRASES.items() for p in of for t in _sentences(p) for a in ("", "/* ", "Note: ", "Words before, ") for z in ("", ".", ", and more after.")]
    made += [(f, f"{prose(_number(t, 'a') % 7, t)} {t} {prose(_number(t, 'z') % 7, (t, 1))}", form) for f, t, form in made if _number(t) % 2]
    made += [("none", f"{a}{m}{z}", f"{m}") for m in (*MENTIONS, *FOLLOWING) for a in ("", "He said that ", "In fact, ", "And so ") for z in ("", ".", ", he added.", " and more.")]
    made += [("none", m.format(n) + z, m) for m in NAMED for of in NAMES.values() for n in of for z in ("", ".")]
    made += [("none", prose(1 + i % 12, i), "prose") for i in range(3000)]
    return made + [("none", "", "")] * 20


class Classifier:
    """Vocabulary, coefficients, calibrated bound and the classes in order of index."""

    def __init__(self, vocabulary: CountVectorizerModel, model: LogisticRegressionModel, bound: float, classes: list[str]):
        self.vocabulary, self.model, self.bound, self.classes = vocabulary, model, bound, classes
        self.telling = telling_words(vocabulary.vocabulary, model.coefficientMatrix.toArray(), np.asarray(model.interceptVector))

    def probabilities(self, paragraphs: DataFrame) -> DataFrame:
        """Adds ``p``, one probability per class, to ``paragraphs(words, ...)``."""
        featured = self.vocabulary.transform(paragraphs.withColumn("grams", ngrams(F.col("words"))))
        return self.model.transform(featured).withColumn("p", vector_to_array("probability")).drop("grams", "features", "rawPrediction", "probability", "prediction")


def telling_words(grams: list[str], coefficients: np.ndarray, intercepts: np.ndarray) -> list[str]:
    """Words without any of which every text is of the first class.

    For each other class, its lead in the intercepts and all that n-grams of other words could add to it come to less than zero.  Words
    are taken while this doesn't hold, those that add most first, frequent ones last.
    """
    gains = np.maximum(coefficients - coefficients[0], 0.0)
    lead = intercepts - intercepts[0] + gains.sum(axis=1)
    lead[0] = -np.inf
    having: dict[str, list[int]] = {}
    for i, g in enumerate(grams):
        for w in set(g.split(" ")):
            having.setdefault(w, []).append(i)
    alive, frequent, chosen = np.ones(len(grams), dtype=bool), set(FREQUENT), []
    while having and (worst := lead.argmax()) and lead[worst] > -1e-6:
        adds = {w: gains[worst, [i for i in at if alive[i]]].sum() for w, at in having.items()}
        word = max(adds, key=lambda w: (adds[w] > 0, w not in frequent, adds[w], w))
        gone = [i for i in having.pop(word) if alive[i]]
        alive[gone] = False
        lead = lead - gains[:, gone].sum(axis=1)
        chosen.append(word)
    if lead[1:].max() > -1e-6:
        raise ValueError("a text without words isn't of the first class")
    return sorted(chosen)


def train(spark: SparkSession, max_iter: int = 40, held_by: str = "text") -> Classifier:
    """``held_by``: notices are held out by the hash of their ``text``, or with all others of their ``form``."""
    made = notices()
    classes = ["none", "unknown", *NAMES]
    rows = spark.createDataFrame([(float(classes.index(f)), t, _held(x, t, held_by)) for f, t, x in made], "label double, text string, held boolean").coalesce(1)
    rows = rows.select("label", "held", words_of(F.col("text")).alias("words")).withColumn("grams", ngrams(F.col("words")))
    held, used = rows.where("held"), rows.where("not held")
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=3, vocabSize=VOCABULARY).fit(used)
    if len(vocabulary.vocabulary) >= VOCABULARY:
        raise ValueError("the notices have more n-grams than the classifier may know")
    model = LogisticRegression(regParam=0.001, elasticNetParam=0.99, maxIter=max_iter, family="multinomial").fit(vocabulary.transform(used).select("label", "features"))
    fitted = Classifier(vocabulary, model, LEAST, classes)
    family = F.array_max(F.slice("p", 3, len(NAMES)))
    accepted = fitted.probabilities(held.drop("grams")).where("label < 2").agg(F.percentile(family, F.lit(1 - FALSE_ACCEPT))).first()[0]
    fitted.bound = max(LEAST, accepted or 0.0)
    return fitted


def _held(form: str, text: str, by: str) -> bool:
    return text != "" and form != "prose" and _number("held", form if by == "form" else text) % 3 == 0


def held_out_accuracy(spark: SparkSession, fitted: Classifier, held_by: str = "text") -> float:
    """Share of the held-out notices whose class is found, before confirmation."""
    rows = spark.createDataFrame([(fitted.classes.index(f), t) for f, t, x in notices() if _held(x, t, held_by)], "label int, text string")
    best = fitted.probabilities(rows.select("label", words_of(F.col("text")).alias("words"))).select("label", _best("p")["i"].alias("i"))
    return best.agg(F.avg((F.col("i") == F.col("label")).cast("double"))).first()[0]


def _best(p) -> Column:
    """Struct of the largest probability and its class (ties: the later class)."""
    return F.array_max(F.transform(F.col(p), lambda x, i: F.struct(x.alias("p"), i.alias("i"))))


def _with(value: Column, of) -> Column:
    """``of(value)`` with the value taken once, however often it is used within."""
    return F.transform(F.array(value), of)[0]


_STARTS = "[^\\p{L}\\p{N}\\n]*(?:" + "|".join(re.escape(o) for o in OPENINGS) + ")"
#: Empty matches: before blank lines, after full stops before capitals, before lines that begin as notices do.
BREAK = r"(?=\n[^\S\n]*\n)|(?<=[.!?])(?=\s+\p{Lu})|(?=\n" + _STARTS + ")"
#: Sentences that are no part of the one before.
FRESH = r"\A\n[^\S\n]*\n|\A\s*" + _STARTS
_newlines = lambda text: F.regexp_count(text, F.lit("\n"))


def passages_of(words: Column, telling: Column) -> Column:
    """Runs of the telling words among ``words``, with the words about them, in order."""
    hits = F.filter(F.transform(words, lambda w, k: F.when(F.array_contains(telling, w), k)), lambda k: k.isNotNull())

    def runs(h):
        firsts = F.filter(F.transform(h, lambda k, j: F.when((j == 0) | (k - F.get(h, j - 1) > GAP), j)), lambda j: j.isNotNull())

        def cut(f):
            def passage(j, n):
                from_ = F.greatest(F.get(h, j) - PAD, F.lit(0))
                to = F.get(h, F.coalesce(F.get(f, n + 1), F.size(h)) - 1) + PAD
                return F.slice(words, from_ + 1, to - from_ + 1)

            return F.transform(f, passage)

        return _with(firsts, cut)

    return _with(hits, runs)


def passages(docs: DataFrame, fitted: Classifier, text_col: str = "text") -> DataFrame:
    """Adds ``row_no``, ``n_paragraphs`` (lines that aren't blank) and, a row for each passage (none: one row of nulls): ``sentence`` and ``passage`` (their
    numbers), ``lines`` (line breaks since the last such sentence), ``lead`` (those at its beginning), ``fresh`` and ``words``."""
    telling = F.array(*[F.lit(w) for w in fitted.telling])
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}]+")

    def found(p):
        hits = F.filter(F.transform(p, lambda t, i: F.when(F.arrays_overlap(plain(t), telling), i)), lambda i: i.isNotNull())

        def told(h):
            def row(i, j):
                last = F.coalesce(F.get(h, j - 1), F.lit(0))
                lines = F.aggregate(F.slice(p, last + 1, i - last), F.lit(0), lambda a, t: a + _newlines(t))
                return F.struct(i.alias("i"), lines.alias("lines"), F.get(p, i).alias("t"))

            return F.transform(h, row)

        return _with(hits, told)

    numbered = docs.withColumn("row_no", F.monotonically_increasing_id()).withColumn("n_paragraphs", F.regexp_count(text, F.lit(r"\S[^\n]*")).cast("long"))
    each = numbered.withColumn("s", F.explode_outer(_with(F.split(text, BREAK), found)))
    cut = each.select(
        *numbered.columns, F.col("s.i").alias("sentence"), F.col("s.lines").alias("lines"), _newlines(F.regexp_extract("s.t", r"\A[^\p{L}\p{N}]*", 0)).alias("lead"), F.col("s.t").rlike(FRESH).alias("fresh"),
        F.posexplode_outer(_with(words_of(F.col("s.t")), lambda w: passages_of(w, telling))).alias("passage", "words"),
    )
    return cut.withColumn("lines", F.when(F.col("passage") == 0, F.col("lines")).otherwise(0))


def classify(found: DataFrame, fitted: Classifier) -> DataFrame:
    """Adds ``family`` (none, unknown or a family), ``probability`` and ``similarity`` to ``found(words, ...)``."""
    scored = fitted.probabilities(found.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))).withColumn("best", _best("p"))
    made = templates()
    pairs = F.array(*[F.array(*[_pairs(words_of(F.lit(t))) for t in made.get(f, ("",))]) for f in fitted.classes])
    own = F.array_distinct(F.concat("words", _pairs(F.col("words"))))  # a template of one word, such as GPLv3, is that word
    share = _with(own, lambda o: F.array_max(F.transform(F.element_at(pairs, F.col("best.i") + 1), lambda t: F.size(F.array_intersect(t, o)) / F.size(t))))
    is_family = F.col("best.i") >= 2
    compared = scored.withColumn("similarity", F.when(is_family, share))
    named = F.element_at(F.array(*[F.lit(c) for c in fitted.classes]), F.col("best.i") + 1)
    sure = (F.col("best.p") >= fitted.bound) & (F.col("similarity") >= CONFIRM)
    return compared.withColumn("family", F.when(is_family & ~sure, "unknown").otherwise(named)).withColumn("probability", F.col("best.p")).drop("p", "best", "words")


def scan(docs: DataFrame, fitted: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, n_notices, families, notices): one row per row of ``docs``.

    ``families`` are the distinct families in order of name; ``notices`` the (position, family, probability, similarity) of each
    notice in order; the position is the line where its sentence begins.
    """
    fitted = fitted or train(docs.sparkSession)
    rows = classify(passages(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fitted).drop("text"), fitted)
    rows = rows.withColumn("is_notice", F.col("family") != "none").repartition("row_no")
    of_row = Window.partitionBy("row_no").orderBy("sentence", "passage")
    of_notices = Window.partitionBy("row_no", "is_notice").orderBy("sentence", "passage")
    run = Window.partitionBy("row_no", "is_notice", "run")
    before = run.orderBy("sentence", "passage").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("sentence").over(of_notices)
    broken = last.isNull() | (F.col("sentence") - last > 1) | ((F.col("sentence") != last) & F.col("fresh"))
    placed = rows.withColumn("position", (F.sum("lines").over(of_row) + F.col("lead")).cast("int")).withColumn("broken", broken.cast("int")).withColumn("run", F.sum("broken").over(of_notices))
    known = F.when(F.col("family") != "unknown", F.col("family"))
    told = placed.withColumn("known", known).withColumn("current", F.last("known", ignorenulls=True).over(before)).withColumn("any", F.max("known").over(run)).withColumn("n_before", F.count("*").over(before))
    begins = F.when(F.col("known").isNotNull(), F.col("current").isNull() | (F.col("current") != F.col("known"))).otherwise(F.col("any").isNull() & (F.col("n_before") == 0))
    notice = F.when(F.col("is_notice") & begins, F.struct("position", "sentence", "passage", "family", "probability", "similarity"))
    listed = told.groupBy("row_no", "id").agg(F.first("n_paragraphs").alias("n_paragraphs"), F.sort_array(F.collect_list(notice)).alias("found"))
    listed = listed.withColumn("notices", F.transform("found", lambda n: F.struct(n["position"].alias("position"), n["family"].alias("family"), n["probability"].alias("probability"), n["similarity"].cast("double").alias("similarity"))))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return listed.select("id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), families.alias("families"), "notices")


def digests(found: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["position"], n["family"])), ",")
    return found.select(F.col("id").alias("doc_id"), "n_paragraphs", "n_notices", F.array_join("families", ",").alias("families"), told.alias("notices"))
