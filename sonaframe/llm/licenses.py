"""License scan by diagonal voting.

Every pair of neighbouring words (a 2-gram) of a text is looked up among the
2-grams of the templates: one pass over the texts keeps the positions whose
2-gram stands in some template, and Spark joins them to all template
positions.  A match votes for a diagonal, the text position less the template
position.  Votes are counted for each diagonal; neighbouring diagonals of a
long template (words inserted or left out) are merged; a span is verified by
its share of the template's words.  Short templates need every word in a row.

Words are runs of characters other than ASCII marks and white space, with A-Z
in lower case.  2-grams are exact (pairs of word numbers), so that no vote is
a hash collision.

Edge cases: null and empty texts have no words; a text with one word has no
2-gram; places may overlap; rows that repeat are scanned each, as every row
has a number of its own; null ids are kept; an empty table gives an empty
result.  Columns of the result do not depend on other input columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import doc_texts, parts

WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases whose places are counted, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Wordings of well-known licences and notices, and the label of each.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("bsd license", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution", "cc-by"),
    ("this work is licensed under a creative commons", "creative-commons"),
    ("spdx license identifier", "spdx"),
    ("no part of this publication may be reproduced distributed or transmitted in any form or by any means", "reserved"),
]

#: From this many words on a template is long: it may match in part.
LONG = 8


def template_grams() -> tuple[dict[bytes, int], list[tuple[int, int, int, int, str, bool]]]:
    """Word numbers from 1, and for each template position: (gram, template, position, words, label, base)."""
    words: dict[bytes, int] = {}
    rows = []
    for n, (phrase, label, base) in enumerate([(p, lab, True) for p, lab in BASE.items()] + [(p, lab, False) for p, lab in TEMPLATES]):
        ids = [words.setdefault(w.encode(), len(words) + 1) for w in phrase.split()]
        rows += [((a << 20) | b, n, i, len(ids), label, base) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    return words, rows


def gram_hits(texts: DataFrame) -> DataFrame:
    """row, doc_id, n_words and the hits (pos, gram) of every whole text."""
    words, rows = template_grams()
    grams = np.unique([r[0] for r in rows])

    def scan(batches):
        number = words.get
        for b in parts(batches):
            counts, pos, found = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                w = WORD_BYTES.findall(t.lower())
                counts.append(len(w))
                ids = np.fromiter((number(x, 0) for x in w), np.int64, len(w))
                p = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                g = (ids[p] << 20) | ids[p + 1]
                real = grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g
                pos.append(p[real])
                found.append(g[real])
            ends = pa.array(np.cumsum([0] + [len(p) for p in pos]), pa.int32())
            flat = [np.concatenate(x or [np.zeros(0, np.int64)]) for x in (pos, found)]
            hits = pa.StructArray.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64())], names=["pos", "gram"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, hits)],
                                             names=["row", "doc_id", "n_words", "hits"])

    return texts.mapInArrow(scan, "row long, doc_id long, n_words long, hits array<struct<pos:long,gram:long>>")


def template_table(spark: SparkSession) -> DataFrame:
    """One row for each template position: a fixed table of a few hundred rows."""
    return spark.createDataFrame(template_grams()[1], "gram long, template int, at long, size int, label string, base boolean")


def scan_licenses(docs: DataFrame, share: float = 0.75, slack: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is the largest verified share of a template (1.0 for a whole
    phrase), also below the ``share`` that a label needs.
    """
    texts = doc_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # one exchange: what follows groups by the row and finer
    hits = gram_hits(texts).repartition("row").select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select(
        "row", "doc_id", "n_words", F.col("hit.pos").alias("pos"), F.col("hit.gram").alias("gram"))
    votes = hits.join(F.broadcast(template_table(docs.sparkSession)), "gram", "left").withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = votes.groupBy("row", "doc_id", "n_words", "template", "size", "label", "base", "diagonal").agg(
        F.count("pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")  # the diagonals of one text
    start = F.when((F.col("size") >= LONG) & (F.col("diagonal") - F.lag("diagonal").over(order) <= slack), 0).otherwise(1)
    lines = lines.withColumn("start", start).withColumn("group", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # k-gram votes of an unbroken span speak for one word more than there are votes
    spans = lines.groupBy("row", "doc_id", "n_words", "template", "size", "label", "base", "group").agg(
        F.least(F.sum(F.col("votes") + 1), F.first("size")).alias("words"), F.min("diagonal").alias("place"),
        (F.max("last") - F.min("first")).alias("wide"))
    covered = F.col("words") / F.col("size")
    whole = F.when(F.col("size") < LONG, covered >= 1).otherwise((covered >= share) & (F.col("wide") <= 2 * F.col("size")))
    hit = F.coalesce(whole, F.lit(False))
    base = hit & F.col("base")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("place"))).alias("first_word"),
        F.max(F.when(base, F.col("place"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(covered), F.lit(0.0)).cast("double").alias("score")).drop("row")
