"""License scans by diagonal voting.

Templates are license texts. All rolling word k-gram hashes of the documents
are joined with the templates' k-gram positions in Spark; each match votes for
its offset diagonal (place in the text minus place in the template).
Neighbouring diagonals (a few words inserted or left out) are merged, and a
merged group is verified: the distinct template places it holds have to cover
a share of the template, within a span not much longer than the template.

k-grams that no template has can't join: where the templates' hashes are few
(a checked bound) the tasks drop them beforehand, else all are joined by
shuffling.

Base phrases (fixed) are counted at every place where their words stand
consecutively; they are always reported, whatever the voting says.

Words are runs of a-z, 0-9 and characters above ASCII after folding A-Z.

Cases: null and empty texts have no words and no labels; templates shorter
than k words vote for nothing; a repeated template label counts once; equal
rows get equal answers, rows of a null id too; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import BROADCAST_ROWS, python_ready, row_key, stage

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# License notices as their licenses publish them, and the usual one-line references.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-reference", "Released under the MIT License."),
    ("apache-reference", "Licensed under the Apache License, Version 2.0."),
    ("gpl-reference", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-reference", "Licensed under CC BY-NC 4.0."),
    ("cc-by-reference", "Licensed under CC BY 4.0."),
    ("cc-by-sa-reference", "Licensed under CC BY-SA 4.0."),
)
K = 3

_ROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                  ("base", pa.list_(pa.string())), ("h", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])
_ROW_DDL = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base:array<string>,h:array<bigint>,"
            "pos:array<int>>")


def _scan_udf(k: int, phrases, known):
    words = [(W.word_hashes(p), label) for p, label in phrases]
    labels = sorted({label for _, label in words})

    @F.arrow_udf(_ROW_DDL)
    def scan(text: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            n = w.n_texts
            count, flags = np.zeros(n, np.int64), np.zeros((n, len(labels)), bool)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            for hashes, label in words:
                m = len(w.h) - len(hashes) + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(w.h[:m] == hashes[0])
                for j, h in enumerate(hashes[1:], 1):
                    at = at[(w.h[at + j] == h) & (w.doc[at + j] == w.doc[at])]
                doc = w.doc[at]
                place = at - w.first[doc]
                count += np.bincount(doc, minlength=n)
                flags[doc, labels.index(label)] = True
                np.minimum.at(first, doc, place)
                np.maximum.at(last, doc, place)
            none = count == 0
            h, at = w.grams(range(k), 31)
            if known is not None:
                have = known.value
                maybe = np.flatnonzero(have[np.minimum(np.searchsorted(have, h), max(len(have) - 1, 0))] == h) if len(have) \
                    else np.zeros(0, np.int64)
                h, at = h[maybe], at[maybe]
            doc = w.doc[at]
            hits = np.bincount(doc, minlength=n)
            got = np.argwhere(flags)
            out.append(pa.StructArray.from_arrays(
                [pa.array(w.counts(), pa.int64()), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(flags.sum(1))), pa.int32()),
                                          pa.array([labels[j] for j in got[:, 1]], pa.string())),
                 W.lists(h.view(np.int64), hits, pa.int64()), W.lists((at - w.first[doc]).astype(np.int32), hits, pa.int32())],
                fields=list(_ROW)))
        return pa.concat_arrays(out) if out else pa.array([], _ROW)

    return scan


def template_grams(spark, templates, k: int) -> DataFrame:
    """(label, t_len: k-grams of the template, h, t_pos)."""
    rows = []
    for label, text in templates:
        h, at = W.Words(pa.array([text], pa.string())).grams(range(k), 31)
        rows += [(label, len(h), int(x), int(p)) for x, p in zip(h.view(np.int64), at)]
    return spark.createDataFrame(rows, "label string, t_len int, h bigint, t_pos int")


def vote(hits: DataFrame, grams: DataFrame, k: int = K, apart: int = 4, cover: float = 0.75, stretch: float = 1.5) -> DataFrame:
    """Of (rk, h, pos) hits the verified occurrences (rk, label, start, end,
    covered): diagonals not more than ``apart`` words from the next are one group."""
    matched = hits.join(grams, "h").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    votes = matched.groupBy("rk", "label", "t_len", "diagonal").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("t_pos").alias("places"))
    w = Window.partitionBy("rk", "label").orderBy("diagonal")              # the diagonals of one text and template
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > apart, F.lit(True))
    groups = votes.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(w)).groupBy(
        "rk", "label", "t_len", "group").agg(F.min("lo").alias("start"), (F.max("hi") + k).alias("end"),
                                             F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"))
    covered = F.col("n") / F.col("t_len")
    return groups.withColumn("covered", covered).where(
        (covered >= cover) & (F.col("end") - F.col("start") <= stretch * (F.col("t_len") + k - 1) + apart)).select(
        "rk", "label", "start", "end", "covered")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
                 k: int = K, **vote_kw) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (largest covered share of a verified template; 1
    where a base phrase stands) and spans (label:start:end in words of the
    verified occurrences, by start)."""
    python_ready(docs)
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    n = grams.select("h").distinct().limit(BROADCAST_ROWS + 1).count()
    known = None
    if n <= BROADCAST_ROWS:
        hashes = grams.select("h").distinct().toPandas()["h"].to_numpy(np.int64)      # at most BROADCAST_ROWS
        known = spark.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    base = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .select("id", row_key("id", "text").alias("rk"), _scan_udf(k, phrases, known)("text").alias("s"))
                 .select("id", "rk", "s.*"), "license-hits")
    hits = base.where(F.size("h") > 0).dropDuplicates(["rk"]).select("rk", F.explode(F.arrays_zip("h", "pos")).alias("s")).select(
        "rk", "s.h", "s.pos")
    found = vote(hits, F.broadcast(grams) if known is not None else grams, k, **vote_kw)
    per = stage(found.groupBy("rk").agg(
        F.collect_set("label").alias("more"), F.max("covered").alias("best"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("at")), "licenses")
    no = F.array().cast("array<string>")
    spans = F.transform("at", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string")))
    return base.join(per, "rk", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base"), F.coalesce("more", no))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
        F.coalesce(F.array_join(spans, ","), F.lit("")).alias("spans"))
