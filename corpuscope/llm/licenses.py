"""License scans by diagonal voting.

Documents and license texts are words; every rolling word k-gram of every document is hashed and those that occur in
a template are kept as hits (gram, position), compared word by word with the template's gram. Spark joins the hits
to the template positions. A hit at document word p and template word q votes for the diagonal p - q; votes are
counted per document, template and diagonal, neighbouring diagonals (a few inserted or missing words)
merge, and a merged span counts as a license if it covers enough of the template and is not much longer.
Phrases are templates of one gram, so their spans are exact places.

Defined cases: null counts as empty; texts without words have no labels and score 0; repeated rows are
rows of their own; a document holding one phrase very often only makes more hits of its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.tables import materialize
from corpuscope.llm.text import ALPHANUMERIC, LOWER, Words, pieces, utf8, windows

# Phrases with their labels, and public license notices.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
# End of fixed values.

GRAM = 4


def grams(label: str, template: int, text: str, phrase: bool) -> list[tuple]:
    """(gram hash, words, template, position, grams, words of template, label, phrase) of one template."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    words = Words(raw, np.array([0, len(raw)]), ALPHANUMERIC)
    k = min(GRAM, len(words.starts))
    hashed, at = windows(words.hashes(), words.bounds, k)
    own = [raw[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
    return [(int(h.astype(np.int64)), b" ".join(own[i : i + k]), template, int(i), len(at), len(own), k, label, phrase)
            for h, i in zip(hashed, at)]


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES, cover: float = 0.5, drift: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """All documents (row, id, n_words) and their verified spans (row, template, label, phrase, first, end, cover)."""
    spark = docs.sparkSession
    rows = [g for i, (label, text) in enumerate([*phrases, *notices]) for g in grams(label, i, text, i < len(phrases))]
    known: dict[int, tuple[np.ndarray, dict[int, set[bytes]]]] = {}
    for k in sorted({r[6] for r in rows}):
        wanted: dict[int, set[bytes]] = {}
        for r in rows:
            if r[6] == k:
                wanted.setdefault(r[0] & (2**64 - 1), set()).add(r[1])
        known[k] = np.array(sorted(wanted), np.uint64), wanted
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    kind = source.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in pieces(offsets):
                part = LOWER[data[offsets[i] : offsets[j]]]
                words = Words(part, offsets[i : j + 1] - offsets[i], ALPHANUMERIC)
                hashes = words.hashes()
                hits: list[list[dict]] = [[] for _ in range(j - i)]
                for k, (sought, wanted) in known.items():
                    found, at = windows(hashes, words.bounds, k)
                    near = np.minimum(np.searchsorted(sought, found), len(sought) - 1)
                    for x in np.flatnonzero(sought[near] == found).tolist():
                        w = at[x]
                        own = b" ".join(part[a:b].tobytes() for a, b in zip(words.starts[w : w + k], words.ends[w : w + k]))
                        if own in wanted[int(found[x])]:
                            t = words.text[w]
                            hits[t].append({"gram": int(found[x].astype(np.int64)), "at": int(w - words.bounds[t])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.array(np.diff(words.bounds).astype(np.int64)),
                     pa.array(hits, pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32())])))],
                    ["row", "id", "n_words", "hits"],
                )

    scanned = materialize(
        source.mapInArrow(scan, f"row long, id {kind}, n_words long, hits array<struct<gram:long,at:int>>"), "license-hits")
    templates = spark.createDataFrame(
        [(r[0], *r[2:]) for r in rows],
        "gram long, template int, place int, n_grams int, n_template int, k int, label string, phrase boolean",
    )
    votes = (
        scanned.select("row", F.explode("hits").alias("hit")).select("row", "hit.gram", "hit.at")
        .join(F.broadcast(templates), "gram")  # a few hundred fixed rows
        .groupBy("row", "template", "label", "phrase", "n_grams", "n_template", "k", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("phrase"), 0).otherwise(drift), F.lit(True))
    merged = (
        votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
        .groupBy("row", "template", "label", "phrase", "n_grams", "n_template", "span")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max(F.col("last") + F.col("k")).alias("end"))
        .withColumn("cover", F.least(F.lit(1.0), F.col("votes") / F.col("n_grams")))
        .filter((F.col("cover") >= cover) & (F.col("end") - F.col("first") <= F.col("n_template") * 1.5))
    )
    return scanned.select("row", "id", "n_words"), merged.select("row", "template", "label", "phrase", "first", "end", "cover")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, spans = license_spans(docs, id_col, text_col, **options)
    base = F.when(F.col("phrase"), F.col("first"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  a handful of labels at most
    found = spans.groupBy("row").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.max("cover").alias("score"),
    )
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
