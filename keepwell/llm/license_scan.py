"""Licence scan by diagonal voting.

A text's words are all its runs of letters and digits, A-Z in lower case.  The hash of
every pair of consecutive words is joined with the pairs of the templates.  A hit votes
for its diagonal: position in the text less position in the template.  Votes of one
diagonal and of its neighbours, where a word was put in or left out, are merged into
one span, which counts if its words agree with the template's, it covers enough of the
template, and is not much longer than it.

The phrases of `PHRASES` must stand whole, on one diagonal; their places are counted.
The templates of `TEMPLATES` may be covered in part and give labels of their own.

Pairs join a table of fixed size, so only hits are shuffled, pre-aggregated by diagonal.

Defined cases: a null text is empty and has no words; rows of equal id and text get
equal results, also where the id is null; places count also where they overlap; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepwell.llm.common import quoted, text_batches, worker_state

#: A word before its letters A-Z are lower-cased.
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
#: Pairs of words that leave a task at a time.
EMIT_ROWS = 200_000
#: Phrases whose places are counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences of public licences, in words, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Words put in or left out between diagonals that still merge.
NEIGHBOURS = 3
#: Share of a template's pairs that a span covers at least, and its length against the template's at most.
LEAST_COVER, MOST_LENGTH = 0.75, 1.5


def lower(word: str) -> str:
    """A-Z in lower case, all else as it is."""
    return word.lower() if word.isascii() else word.encode().lower().decode()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of consecutive words, from the words' hashes."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def template_pairs(spark: SparkSession) -> tuple[DataFrame, np.ndarray]:
    """(h, first, second, place, template, label, exact, pairs): the templates' pairs of words, a few hundred rows; their hashes, sorted."""
    rows = []
    for exact, texts in ((True, PHRASES), (False, TEMPLATES)):
        for text, label in texts.items():
            words = text.split()
            own = word_hashes(words)
            hashes = pair_hashes(own[:-1], own[1:]).tolist()
            rows += [(h, a, b, i, text, label, exact, len(words) - 1) for i, (h, a, b) in enumerate(zip(hashes, words, words[1:]))]
    return spark.createDataFrame(rows, "h long, first string, second string, place int, template string, label string, "
                                       "exact boolean, pairs int"), np.array(sorted({r[0] for r in rows}))


def word_pairs(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, mark, at, h, a, b): every pair of consecutive words by its hash; the words of those with a known hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("license_scan")
        for batch in batches:
            seen: dict[str, int] = {}
            order, counts = [], []
            for t in batch.column("text").to_pylist():
                words = WORD.findall(t or "")
                order.extend([seen.setdefault(w, len(seen)) for w in words])
                counts.append(len(words))
            if len(order) < 2:
                continue
            words = [lower(w) for w in seen]
            hashes, texts = word_hashes(words), pa.array(words, pa.string())
            sequence, sizes = np.array(order, dtype=np.int32), np.array(counts, dtype=np.int64)
            row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.arange(len(sequence), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begins = np.flatnonzero(row[1:] == row[:-1])
            for first in range(0, len(begins), EMIT_ROWS):
                i = begins[first:first + EMIT_ROWS]
                a, b = sequence[i], sequence[i + 1]
                h = pair_hashes(hashes[a], hashes[b])
                other = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
                pick = pa.array(row[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pick), batch.column("mark").take(pick), pa.array(at[i]), pa.array(h),
                     texts.take(pa.array(a, mask=other)), texts.take(pa.array(b, mask=other))], ["id", "mark", "at", "h", "a", "b"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark long, at long, h long, a string, b string")


def votes(docs: DataFrame) -> DataFrame:
    """(id, mark, template, label, exact, pairs, diagonal, places): per text, template and diagonal the template's pairs that hit."""
    templates, known = template_pairs(docs.sparkSession)
    # The templates are constants of this module, so their pairs can be sent everywhere.
    hits = word_pairs(docs.select("id", "mark", "text"), known).join(F.broadcast(templates), "h").where("a = first AND b = second")
    return hits.groupBy("id", "mark", "template", "label", "exact", "pairs", (F.col("at") - F.col("place")).alias("diagonal")) \
        .agg(F.collect_set("place").alias("places"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(id, mark, n_words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(WORD.findall(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(counts, pa.int64())],
                                             ["id", "mark", "n_words"])

    return docs.select("id", "mark", "text").mapInArrow(
        run, f"id {docs.schema['id'].dataType.simpleString()}, mark long, n_words long")


def spans(voted: DataFrame) -> DataFrame:
    """(id, mark, template, label, exact, start, cover): places of phrases and spans of templates that count."""
    whole = voted.where(F.col("exact") & (F.size("places") == F.col("pairs"))).select(
        "id", "mark", "template", "label", "exact", F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("cover"))
    along = Window.partitionBy("id", "mark", "template").orderBy("diagonal")
    parted = voted.where(~F.col("exact")) \
        .withColumn("opens", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS, F.lit(True))) \
        .withColumn("run", F.sum(F.col("opens").cast("int")).over(along))
    merged = parted.groupBy("id", "mark", "template", "label", "exact", "pairs", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"),
        F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("places")).alias("last"))
    length, cover = F.col("last") + 2 - F.col("start"), F.col("covered") / F.col("pairs")
    counted = merged.where((cover >= LEAST_COVER) & (length <= MOST_LENGTH * (F.col("pairs") + 1)))
    return whole.unionByName(counted.select("id", "mark", "template", "label", "exact", F.col("start").cast("long").alias("start"),
                                            cover.alias("cover")))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover)."""
    text_batches(df.sparkSession)
    docs = df.select(F.col(quoted(key)).alias("id"), F.xxhash64(quoted(text)).alias("mark"), F.col(quoted(text)).alias("text"))
    base = lambda c: F.when(F.col("exact"), F.col(c))
    found = spans(votes(docs)).groupBy("id", "mark").agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(base("label"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("cover").alias("score"))
    found = found.withColumnsRenamed({"id": "their_id", "mark": "their_mark"})
    rows = word_counts(docs)
    on = F.col("id").eqNullSafe(F.col("their_id")) & (F.col("mark") == F.col("their_mark"))
    return rows.join(found, on, "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
