"""License scans by diagonal voting.

Every document gives a rolling hash for each run of K words. The runs are joined in Spark with the runs of the
templates, a table of fixed text that is broadcast; each match is checked word by word, by the words' hashes, and
votes for a diagonal, its place in the document less its place in the template. Votes are counted by diagonal,
and neighbouring diagonals of a long template are merged (words put in or left out shift the diagonal). In a chain of them the
windows of SPREAD times the template's length are searched: it is a finding when enough of the template's
runs stand in the best one, however long the chain goes on. Short phrases must stand whole on one diagonal.

Only matches and one row for each document are shuffled; the texts are not, and no row of a run carries its text. Odd input: a null or empty text has no
words and no labels; a text of fewer than K words has no runs; rows that repeat an id are each answered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb

K = 3
SHORT = 12  #: words up to which a template must stand whole
COVER = 0.5  #: share of a longer template's runs that must stand in a span
SPREAD = 2.0  #: times the template's length that a finding may take up

# fixed values: the base phrases with their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: passages of public licenses and notices, with their labels
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "released under the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl", "is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-nd", "CC BY ND"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc0", "CC0 1.0 Universal"),
    ("all-rights-reserved", "all rights reserved"),
)


def word_hashes(texts: pa.Array):
    """For each block of texts: hashes of their words, and pointers."""
    for _, _, data, offsets in tb.blocks(texts):
        low = tb.ASCII_LOWER[data]
        starts, ends = tb.spans(low, tb.WORD)
        yield tb.hashes(low, starts, ends), tb.pointers(starts, offsets)


def runs(text: str | Column) -> Column:
    """Column of each text's number of words, and of its runs: hash and words' hashes, after a first of 0, which stands for the text itself."""

    @F.arrow_udf("struct<n_words: bigint, runs: array<struct<run: bigint, words: array<bigint>>>>")
    def answer(texts: pa.Array) -> pa.Array:
        n_words, n_runs, packed, words = [[]], [[0]], [np.empty(0, np.uint64)], [np.empty((0, K), np.uint64)]
        for h, ptr in word_hashes(texts):
            each = np.diff(ptr)
            inside = tb.within_rows(ptr, K)
            kept = np.maximum(each - K + 1, 0)
            out, of = np.zeros(int(kept.sum()) + len(each), np.uint64), np.zeros((int(kept.sum()) + len(each), K), np.uint64)
            mask = np.ones(len(out), bool)
            mask[np.cumsum(kept + 1) - kept - 1] = False
            out[mask] = tb.rolling(h, K)[inside]
            if len(h) >= K:
                of[mask] = np.lib.stride_tricks.sliding_window_view(h, K)[inside]
            n_words.append(each)
            packed.append(out)
            words.append(of)
            n_runs.append(kept + 1)
        flat = np.concatenate(words).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, K, dtype=np.int32)), pa.array(flat))
        each_run = pa.StructArray.from_arrays([pa.array(np.concatenate(packed).view(np.int64)), lists], ["run", "words"])
        by_text = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(n_runs)).astype(np.int32)), each_run)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words).astype(np.int64)), by_text], ["n_words", "runs"])

    return answer(text)


def template_rows(base: dict[str, str], templates) -> list[tuple]:
    """(run, template, label, base, size, at, words) for each run of each template."""
    out = []
    every = [(label, text, True) for text, label in base.items()] + [(label, text, False) for label, text in templates]
    for i, (label, text, is_base) in enumerate(every):
        words = tb_words(text)
        ((h, _),) = list(word_hashes(pa.array([" ".join(words)])))
        for at, run in enumerate(tb.rolling(h, K).view(np.int64).tolist()):
            out.append((run, i, label, is_base, len(words), at, h[at : at + K].view(np.int64).tolist()))
    return out


def tb_words(text: str) -> list[str]:
    low = tb.ASCII_LOWER[np.frombuffer(text.encode() + b"\n", np.uint8)]
    starts, ends = tb.spans(low, tb.WORD)
    return [low[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


def matches(spark: SparkSession, docs: DataFrame, text: str, key: str, base, templates) -> DataFrame:
    """(row, key, n_words, template, label, base, size, at, place) for every run that is a template's, and one row for each text."""
    schema = "run bigint, template int, label string, base boolean, size int, at int, known array<bigint>"
    known = spark.createDataFrame([(0, None, None, None, None, None, None), *template_rows(base, templates)], schema)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), runs(F.coalesce(text, F.lit(""))).alias("r"))
    each = rows.select("row", "key", "r.n_words", F.posexplode("r.runs").alias("place", "x")).select("row", "key", "n_words", "place", "x.run", "x.words")
    hit = each.join(F.broadcast(known), "run").where(F.col("template").isNull() | (F.col("words") == F.col("known")))
    return hit.select("row", "key", "n_words", "template", "label", "base", "size", "at", (F.col("place") - 1).cast("bigint").alias("place"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", base=None, templates=TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row."""
    votes = matches(docs.sparkSession, docs, text, key, BASE if base is None else base, templates).repartition("row")
    of = ["row", "key", "n_words", "template", "label", "base", "size"]
    votes = votes.withColumn("diagonal", F.col("place") - F.col("at"))
    along = Window.partitionBy("row", "template").orderBy("diagonal", "place")
    reach = F.when(F.col("size") > SHORT, F.greatest(F.lit(2), F.floor(F.col("size") / 8))).otherwise(0)
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > reach, F.lit(True))
    chained = votes.withColumn("begins", begins.cast("int")).withColumn("span", F.sum("begins").over(along))
    # places are measured in lengths that a finding may take up, so that one frame serves templates of all sizes
    room = F.greatest(F.when(F.col("size") > SHORT, SPREAD * F.col("size")).otherwise(F.col("size")) - K, F.lit(1))
    ahead = Window.partitionBy("row", "template", "span").orderBy(F.col("place") / room).rangeBetween(0, 1)
    near = chained.withColumn("n", F.size(F.collect_set("at").over(ahead)))  # at most the template's runs
    spans = near.groupBy(*of, "span").agg(F.max("n").alias("n"), F.min("place").alias("lo"))
    cover = F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("size") - K + 1, F.lit(1)))
    found = F.when(F.col("size") <= SHORT, F.col("n") == F.col("size") - K + 1).otherwise(cover >= COVER)
    spans = spans.withColumn("cover", cover).withColumn("found", found)
    base_found = F.col("found") & F.col("base")
    joined = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("row", "key", "n_words").agg(
        F.count(F.when(base_found, 1)).alias("n_base"),
        F.min(F.when(base_found, F.col("lo"))).alias("first_word"),
        F.max(F.when(base_found, F.col("lo"))).alias("last_word"),
        joined(base_found).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("found"), 1)).alias("n_spans"),
    ).drop("row")
