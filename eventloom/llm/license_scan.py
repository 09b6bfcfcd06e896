"""Licence scan by a positional rare-token index, on Spark's own functions only.

A template is the wording of a licence notice with the key phrase that it must contain. One
pass cuts every text into words and writes its hits: the places of all words that stand in
any template. Everything else reads that table. Document frequencies of the templates' words
over the whole corpus give their IDF; a phrase is posted under its highest-IDF word, with the
place of that word and the INDEXED next highest. Each hit of a posted word looks its postings
up and proposes a start of the phrase; the start stays when the next words stand at their
relative places, and counts when the whole phrase does. A phrase always holds its own words,
so no place is lost. A hit takes along only the hits within a notice's length of it, so work is
linear in the hits, however long a text is. Postings are a small table, made from the fixed
templates; more templates make it longer and change no plan.

Defined results: null or blank texts have no words, no places, empty labels and score 0; an
empty table gives no rows; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: Runs of these bytes part words.
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a phrase that its posting checks besides the one that it is posted under.
INDEXED = 2


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: int  # place of the mandatory phrase in words
    length: int  # and its number of words
    base: bool = False

    @property
    def phrase(self) -> tuple[str, ...]:
        return self.words[self.key : self.key + self.length]


def template(label: str, before: str, phrase: str, after: str = "", base: bool = False) -> Template:
    a, b, c = (re.findall("[0-9a-z]+", part.lower()) for part in (before, phrase, after))
    return Template(label, (*a, *b, *c), len(a), len(b), base)


#: The base phrases, then public notices that the method adds.
TEMPLATES = (
    template("mit", "released", "under the mit license", base=True),
    template("apache-2", "licensed under the", "apache license version 2", "0", base=True),
    template("cc-by-nc", "licensed under", "cc by nc", "4 0", base=True),
    template(
        "mit-text", "", "Permission is hereby granted, free of charge,",
        "to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    template("gpl", "you can redistribute it and/or modify it under the terms of the", "GNU General Public License", "as published by the Free Software Foundation, either version"),
    template("lgpl", "you can redistribute it and/or modify it under the terms of the", "GNU Lesser General Public License", "as published by the Free Software Foundation, either version"),
    template("agpl", "you can redistribute it and/or modify it under the terms of the", "GNU Affero General Public License", "as published by the Free Software Foundation, either version"),
    template("apache-text", "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an AS IS basis", "without warranties or conditions of any kind, either express or implied"),
    template("mpl-2", "This Source Code Form is subject to the terms of the", "Mozilla Public License", "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    template("bsd", "", "Redistribution and use in source and binary forms", "with or without modification, are permitted provided that the following conditions are met"),
    template("isc", "", "Permission to use, copy, modify, and/or distribute this software", "for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    template("unlicense", "This is", "free and unencumbered software", "released into the public domain"),
    template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable", "for any damages arising from the use of this software"),
    template("boost", "Distributed under the", "Boost Software License", "Version 1.0"),
    template("epl", "This program and the accompanying materials are made available under the terms of the", "Eclipse Public License"),
    template("cc0", "To the extent possible under law, the person who associated", "CC0", "with this work has waived all copyright and related or neighboring rights"),
    template("cc-by", "This work is licensed under a", "Creative Commons Attribution", "4.0 International License"),
    template("cc-by-sa", "licensed under", "cc by sa", "4 0"),
    template("public-domain", "This work is in the", "dedicated to the public domain"),
    template("all-rights-reserved", "copyright", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), APART), "")


def hits_of(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...]) -> DataFrame:
    """row, id, n_words, hits (at, word) of every row, written: texts are read and cut once."""
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words_of(F.col(text_col)).alias("words"))
    marked = F.transform("words", lambda w, k: F.struct(k.alias("at"), w.alias("word")))
    hits = F.filter(marked, lambda h: h["word"].isin(*vocabulary))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "hits")


def document_frequencies(hits: DataFrame) -> dict[str, int]:
    """In how many rows each word of the templates stands."""
    found = hits.select(F.explode(F.array_distinct("hits.word")).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def postings(spark, templates: tuple[Template, ...], df: dict[str, int]) -> DataFrame:
    """One row per template: the posted word and its place in the phrase, the next rarest words
    with theirs, and the template."""
    out = []
    for t in templates:
        first = sorted({w: k for k, w in reversed(list(enumerate(t.phrase)))}.items(), key=lambda x: (df.get(x[0], 0), x[1]))
        (word, at), rest = first[0], first[1 : 1 + INDEXED]
        out.append((word, at, [(k, w) for w, k in rest], t.label, t.base, list(t.phrase), list(t.words), t.key))
    return spark.createDataFrame(out, "word string, place int, next array<struct<at int, word string>>, label string, base boolean, phrase array<string>, words array<string>, key int")


def places(hits: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(row, label, base, start, share) of each place of a phrase: the word that it starts
    with, and which share of the template's words stands around it."""
    index = postings(hits.sparkSession, templates, document_frequencies(hits))
    posted = [r["word"] for r in index.select("word").distinct().collect()]  # as many as there are templates, at most
    reach = max(len(t.words) for t in templates)
    at = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda k: F.get("hits", k)["word"].isin(*posted))
    near = F.transform(at, lambda k: F.struct(F.get("hits", k)["word"].alias("word"), F.get("hits", k)["at"].alias("at"), F.slice("hits", F.greatest(k + 1 - reach, F.lit(1)), F.lit(2 * reach + 1)).alias("near")))
    some = hits.where(F.size("hits") > 0).where(F.exists("hits", lambda h: h["word"].isin(*posted)))
    found = some.select("row", F.explode(near).alias("hit")).select("row", "hit.*").join(F.broadcast(index), "word")
    found = found.withColumn("start", F.col("at") - F.col("place")).where("start >= 0")
    found = found.where(F.forall("next", lambda n: F.exists("near", lambda h: (h["at"] == F.col("start") + n["at"]) & (h["word"] == n["word"]))))
    inside = F.filter("near", lambda h: (h["at"] >= F.col("start")) & (h["at"] < F.col("start") + F.size("phrase")))
    found = found.where(F.transform(inside, lambda h: h["word"]) == F.col("phrase"))
    begin = F.col("start") - F.col("key")
    stands = F.filter("near", lambda h: (h["at"] >= begin) & (h["at"] - begin < F.size("words")) & F.get("words", h["at"] - begin).eqNullSafe(h["word"]))
    return found.select("row", "label", "base", "start", (F.size(stands) / F.size("words")).alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """id, n_words, found: the (label, base, start, share) of all places, in order, of every row."""
    hits = hits_of(docs, id_col, text_col, templates)
    every = places(hits, templates).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "label", "base", "share"))).alias("found"))
    return hits.select("row", "id", "n_words").join(every, "row", "left").select("id", "n_words", F.coalesce("found", F.array().cast(every.schema["found"].dataType)).alias("found"))


def per_document(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    hits = hits_of(docs, "doc_id", "text", templates)
    base = F.when(F.col("base"), F.col("start"))
    listed = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    found = places(hits, templates).groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    full = hits.select("row", F.col("id").alias("doc_id"), "n_words").join(found, "row", "left")
    return full.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
