"""License scan by diagonal voting, in DataFrame functions only.

Every text becomes words; every window of ``K`` words is hashed and joined to the positions of the same
windows in license templates. A match of text position i with template position j votes for the diagonal
i - j; votes are counted by text, template and diagonal, neighbouring diagonals (a word inserted or left out)
are merged, and a merged diagonal that ``LEAST`` of the template's windows vote for is verified word by word: the
template's words are looked up in order in the text along it, each among the next few words. The words found, as a
share of the template's length or of the span's if that is longer, must reach ``VERIFY``. Base phrases are counted on
the whole text besides.

Scale: one narrow pass computes words, base places and window hashes; the template table is a fixed list of
some hundred windows, so the join is a broadcast of bounded size. Votes exist only where a window matches and carry
the words around their diagonal (twice the template's length at most), so verification needs no text again;
they are combined map-side and keyed by text, template and diagonal, so no license that many texts share
makes a hot key.

Defined results: null text counts as empty (no words, no labels, score 0); null ids and repeated rows keep
their rows (a row is known by two 64-bit hashes of its id and text, and equal rows get equal values); overlapping places all count; an empty table gives an empty result; extra columns
are ignored, also those named like the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Template notices by label (lower case words; what stands in license headers).
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["copyright c all rights reserved"],
}
#: Words in a window; diagonals merged, and words that may stand between two found ones; the share of a template's windows
#: that must vote, and of its words that must be found.
K, NEIGHBOURS, LEAST, VERIFY = 3, 2, 0.3, 0.7
#: What separates words: every ASCII character but digits and small letters.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. The two other characters whose lower case is ASCII are put out of the way first:
    they are word characters either way and never part of a phrase."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("ß")), F.lit("K"), F.lit("ß")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), _SEPARATORS, -1), lambda w: w != "")


def _windows(words: Column, k: int) -> Column:
    """Hashes of all windows of ``k`` words, in order."""
    n = F.size(words)
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + d) for d in range(1, k)]))
    return F.when(n >= k, F.slice(hashed, F.lit(1), n - k + 1)).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, found: dict[str, list[str]] | None = None, k: int = K) -> DataFrame:
    """``(hash, template, label, length, j)`` for each window of each template."""
    rows = [(i, label, len(text.split()), text) for i, (label, text) in enumerate((lb, t) for lb, ts in (found or TEMPLATES).items() for t in ts)]
    got = spark.createDataFrame(rows, "template int, label string, length int, text string").withColumn("w", F.split("text", " "))
    return got.select(F.posexplode(_windows(F.col("w"), k)).alias("j", "hash"), "template", "label", "length")


def notices(spark: SparkSession, found: dict[str, list[str]] | None = None) -> DataFrame:
    """``(template, body)``: the words of each template."""
    rows = [(i, text.split()) for i, text in enumerate(t for ts in (found or TEMPLATES).values() for t in ts)]
    return spark.createDataFrame(rows, "template int, body array<string>")


def votes(rows: DataFrame, spark: SparkSession, k: int = K, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Votes by diagonal of ``rows(rid, words)``: ``(rid, template, label, length, diagonal, n, from, near)``.

    ``near``: the text's words from place ``from``, a little before the diagonal's start, twice the template's length.
    """
    known = templates(spark, k=k)  # fixed templates: some hundred rows
    few = known.agg(F.collect_set("hash").alias("hashes"), F.max("length").alias("length")).first()
    reach = few["length"] + neighbours
    # a window that no template has is dropped where it is made, so that words are copied for matching windows only
    def around(words: Column) -> Column:
        match = F.transform(_windows(words, k), lambda h, i: F.when(h.isin(few["hashes"]), F.struct(i.alias("i"), h.alias("hash"))))
        return F.transform(F.filter(match, lambda m: m.isNotNull()), lambda m: F.struct(m["i"].alias("i"), m["hash"].alias("hash"), F.slice(words, F.greatest(F.lit(1), m["i"] - reach + 1), F.lit(3 * reach)).alias("around")))

    # bound as a variable, the words are split once and not at each use
    each = rows.select("rid", F.get(F.transform(F.array("words"), around), F.lit(0)).alias("m")).select("rid", F.explode("m").alias("m")).select("rid", "m.i", "m.hash", "m.around")
    start = F.greatest(F.lit(0), F.col("i") - F.col("j") - neighbours)
    near = F.slice("around", start - F.greatest(F.lit(0), F.col("i") - reach) + 1, 2 * (F.col("length") + neighbours))
    hits = each.join(F.broadcast(known), "hash").select("rid", "template", "label", "length", (F.col("i") - F.col("j")).alias("diagonal"), "j", start.alias("from"), near.alias("near"))
    return hits.groupBy("rid", "template", "label", "length", "diagonal", "from").agg(F.size(F.collect_set("j")).alias("n"), F.first("near").alias("near"))


def _verified(body: Column, near: Column, neighbours: int) -> Column:
    """``struct<words,first,last>``: how many words of ``body`` stand in ``near`` in order, and the places of the first and last."""
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("at"), F.lit(neighbours).alias("missed"), F.lit(0).alias("words"), none.alias("first"), none.alias("last"))

    def step(s: Column, word: Column) -> Column:
        ahead = F.array_position(F.slice(near, s["at"] + 1, neighbours + 1 + s["missed"]), word).cast("int")
        at, hit = s["at"] + ahead, ahead > 0
        return F.struct(
            at.alias("at"), F.when(hit, 0).otherwise(s["missed"] + 1).alias("missed"), (s["words"] + hit.cast("int")).alias("words"),
            F.when(hit, F.coalesce(s["first"], at - 1)).otherwise(s["first"]).alias("first"), F.when(hit, at - 1).otherwise(s["last"]).alias("last"),
        )

    return F.aggregate(body, zero, step)


def spans(found: DataFrame, k: int = K, neighbours: int = NEIGHBOURS, least: float = LEAST, verify: float = VERIFY) -> DataFrame:
    """``(rid, label, start, end, share)``: verified spans, in words, end exclusive, of merged diagonals."""
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > neighbours, F.lit(True))
    runs = found.withColumn("run", F.sum(new.cast("int")).over(order)).groupBy("rid", "template", "label", "length", "run").agg(
        F.sum("n").alias("n"), F.min(F.struct("diagonal", "from", "near")).alias("low")
    )
    some = runs.where(F.col("n") >= least * (F.col("length") - k + 1)).join(F.broadcast(notices(found.sparkSession)), "template")  # fixed templates
    seen = some.select("rid", "label", "length", "low.from", _verified(F.col("body"), F.col("low.near"), neighbours).alias("v"))
    share = F.col("v.words") / F.greatest("length", F.col("v.last") - F.col("v.first") + 1)
    seen = seen.select("rid", "label", (F.col("from") + F.col("v.first")).alias("start"), (F.col("from") + F.col("v.last") + 1).alias("end"), share.alias("share"))
    return seen.where(F.col("share") >= verify)


def _places(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase starts."""
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        cond = w == first
        for d, x in enumerate(rest, 1):
            cond = cond & F.coalesce(F.get(words, i + d) == x, F.lit(False))
        return F.when(cond, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def licenses(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = F.struct(F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1), "doc_id"))  # the plan reads the table twice
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select(known.alias("rid"), "doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    none = F.array().cast("array<int>")
    places = [F.when(F.array_contains("words", p.split()[0]), _places(F.col("words"), p)).otherwise(none).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    base = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), *places)
    got = spans(votes(rows.drop("doc_id"), spark)).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    own = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(lb)) for k, lb in enumerate(PHRASES.values())]))
    base = base.select("rid", "doc_id", "n_words", every.alias("at"), F.array_sort(F.array_distinct(own)).alias("own"))
    base = base.select("rid", "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"), "own")
    labels = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    return base.join(got, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("own") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
