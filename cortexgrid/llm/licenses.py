"""Operator 9: license scans by diagonal voting. DataFrame functions only.

All rolling word k-grams of a document are hashed and joined with the positions of those hashes in the templates, a
table of notices and license texts that is broadcast while it is small. Hits are counted by diagonal (place in the text less place in the
template) and neighbouring diagonals are merged into spans. A span is verified by its words: so much of the template's
words, and so much of its own, must lie in k-grams that both have at these places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cortexgrid.plans import materialize

#: Words are runs of other characters than these, after A-Z is lower-cased.
SPACE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
#: Diagonals so many words apart belong together, and the share of a template that a span must show; a notice of fewer
#: than NOTICE words must be whole.
NEIGHBOURS, COVERAGE, NOTICE = 4, 0.5, 12

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known license notices and texts, or their opening words, by label.
TEMPLATES = {
    "agpl": [
        "gnu affero general public license",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "released under the apache license 2 0",
        "under the apache 2 0 license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ],
    "bsd": [
        "licensed under the bsd license",
        "under the bsd 3 clause license",
        "under the bsd 2 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "cc-by": [
        "cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "cc-by-nc": [
        "cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-nc-sa": [
        "cc by nc sa 4 0",
    ],
    "cc-by-nd": [
        "cc by nd 4 0",
    ],
    "cc-by-sa": [
        "cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc0": [
        "cc0 1 0 universal",
    ],
    "gpl": [
        "licensed under the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "lgpl": [
        "gnu lesser general public license",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": [
        "mozilla public license version 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "reserved": [
        "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
    ],
    "unlicense": [
        "released under the unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SPACE), "")


def _grams(words: Column) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.size(words) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(words, i, GRAM)))
    return F.when(F.size(words) >= GRAM, some).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(label, line) of templates by label."""
    return spark.createDataFrame([(k, x) for k in sorted(templates) for x in templates[k]], "label string, line string")


def template_grams(templates: DataFrame) -> DataFrame:
    """(gram, label, template, at, grams): each k-gram's places, and the number of k-grams of its template; label, line given."""
    made = templates.select("label", F.xxhash64("label", "line").alias("template"), _grams(words_of(F.col("line"))).alias("g"))
    return made.select("label", "template", F.size("g").alias("grams"), F.posexplode("g").alias("at", "gram"))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at, label>>: every place where a phrase's words stand consecutively, by place."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all(F.get(words, i + k) == p for k, p in enumerate(parts)))
        return F.when(F.instr(line, f" {phrase} ") > 0, F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    return F.sort_array(F.concat(*(places(p, label) for p, label in phrases.items())))


def _all(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def scan(docs: DataFrame, templates: DataFrame | None = None, phrases: dict[str, str] = PHRASES, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of docs (doc_id, text).

    documents: doc_id, row_hash, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score. spans:
    row_hash, label, template (hash), first (word), length, score: verified spans, score the share of the template's words
    found. templates is a table of label and line, TEMPLATES by default; it is written, so that Catalyst broadcasts it only
    while it is small. Null and empty texts have no words and no labels. Rows equal in doc_id and text share their spans; other columns
    are ignored; empty docs give no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    words = F.array(words_of(F.col("text")))
    grams = materialize(template_grams(template_table(docs.sparkSession) if templates is None else templates), "templates")
    rolled = given.select("row_hash", F.posexplode(F.get(F.transform(words, _grams), F.lit(0))).alias("place", "gram"))
    hits = rolled.join(grams, "gram").select("row_hash", "label", "template", "grams", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    votes = hits.groupBy("row_hash", "label", "template", "grams", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("at").alias("low"), F.max("at").alias("high"))
    along = Window.partitionBy("row_hash", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int"), F.lit(1))
    merged = votes.withColumn("new", apart).withColumn("band", F.sum("new").over(along))
    # a k-gram's words, in the template and in the text
    own = F.flatten(F.transform("ats", lambda i: F.sequence(i, i + GRAM - 1)))
    there = F.transform(own, lambda i: F.col("diagonal") + i)
    count = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    spans = merged.groupBy("row_hash", "label", "template", "grams", "band").agg(
        count(own).alias("found"), count(there).alias("shared"),
        F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + GRAM).alias("end"),
    )
    score, length = F.col("found") / (F.col("grams") + GRAM - 1), F.col("end") - F.col("first")
    least = F.when(F.col("grams") + GRAM - 1 < NOTICE, F.lit(1.0)).otherwise(F.lit(coverage))
    spans = spans.where((score >= least) & (F.col("shared") >= least * length)).select("row_hash", "label", "template", "first", length.alias("length"), score.alias("score"))
    best = spans.groupBy("row_hash").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score")).withColumnRenamed("row_hash", "_row")
    counted = given.select("doc_id", "row_hash", F.get(F.transform(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), phrase_places(w, phrases).alias("base"))), F.lit(0)).alias("c"))
    base = counted.select("doc_id", "row_hash", F.col("c.n").alias("n_words"), F.col("c.base").alias("base"))
    joined = base.join(best, F.col("row_hash") == F.col("_row"), "left")
    labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    documents = joined.select(
        "doc_id", "row_hash", "n_words", F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["at"].alias("first_word"), F.try_element_at("base", F.lit(-1))["at"].alias("last_word"),
        labels.alias("base_labels"), F.array_sort(F.array_union(labels, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
    return documents, spans


def document_licenses(docs: DataFrame) -> DataFrame:
    """scan's documents with labels joined by commas; nulls, empty texts and repeated rows as there."""
    found, _ = scan(docs)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
