"""Repeated passages removed by global hashing of lines, paragraphs or the
sentences in lines.

A text's units are normalised to their word sequences and hashed to 128 bits.
Digests are grouped over the whole table; the occurrence ranked first (by id,
null last, then row, then place) stays. Other occurrences are repetitions, and
runs of repeated units that follow each other are removed if they have
``least`` words in all; what is removed is reported as spans of code points
in the original text. Shorter repetitions (greetings, common lines) stay, and
units of fewer than ``min_words`` words are not judged: one between two units
of a run goes with it. The default unit is the sentence within a line, since a
repeated passage need not start where a line starts.

A digest that stands in a large part of all rows is aggregated before the
shuffle, and its occurrences are joined back with a written table, a join that
Spark can split.

Cases: null and empty texts have no units; repeated rows are documents of
their own (the row written first stays whole); ties of ids are broken by row,
then place; a null id ranks last; other columns pass through; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import python_ready, stage

MIN_WORDS = 5
LEAST = 25
_ROW = pa.struct([("n_chars", pa.int64()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())),
                  ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())), ("words", pa.list_(pa.int32()))])
_DDL = "struct<n_chars:bigint,k1:array<bigint>,k2:array<bigint>,start:array<int>,end:array<int>,words:array<int>>"


def _unit_bounds(data: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all units of a slice of texts: between newlines; for
    paragraphs between blank lines; for sentences also after a full stop,
    exclamation or question mark before white space."""
    newline = np.flatnonzero(data == 10)
    if unit == "paragraph" and len(newline):               # a newline with none but blanks up to another newline
        solid = np.flatnonzero((data != 10) & (data != 32) & (data != 9) & (data != 13))
        before = np.searchsorted(solid, newline)
        newline = newline[np.append(before[1:] == before[:-1], False) | np.append(False, before[1:] == before[:-1])]
    start, end = [off[:-1], newline + 1], [off[1:], newline]
    if unit == "sentence" and len(data) > 1:
        stop = (data[:-1] == 0x2E) | (data[:-1] == 0x21) | (data[:-1] == 0x3F)
        cut = np.flatnonzero(stop & ((data[1:] == 32) | (data[1:] == 9))) + 1
        cut = cut[~np.isin(cut, off)]                      # a text's end is a bound already
        start.append(cut)
        end.append(cut)
    return np.sort(np.concatenate(start)), np.sort(np.concatenate(end))


def _units_udf(min_words: int, unit: str):
    @F.arrow_udf(_DDL)
    def units(text: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            start, end = _unit_bounds(w.data, w.off, unit)
            a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
            doc = np.searchsorted(w.off, start, "right") - 1
            empty = start >= end
            keep = np.flatnonzero((b - a >= min_words) & ~empty)
            start, end, a, b, doc = start[keep], end[keep], a[keep], b[keep], doc[keep]
            n = len(w.h)
            keys = []
            with np.errstate(over="ignore"):
                p, inv = W.powers(W._P, n + 1), W.powers(W._PINV, n + 1)
                for s in (61, 67):
                    sums = np.zeros(n + 1, np.uint64)
                    np.cumsum(W.mix(w.h + W.constants(1, s)[0]) * p[:n], out=sums[1:])
                    keys.append(W.mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(np.uint64)).view(np.int64))
            chars = np.zeros(len(w.data) + 1, np.int64)    # code points before each byte
            np.cumsum((w.data & 0xC0) != 0x80, out=chars[1:])
            base = chars[w.off[doc]]
            per = np.bincount(doc, minlength=w.n_texts)
            out.append(pa.StructArray.from_arrays(
                [pa.array(np.diff(chars[w.off])), W.lists(keys[0], per, pa.int64()), W.lists(keys[1], per, pa.int64()),
                 W.lists((chars[start] - base).astype(np.int32), per, pa.int32()),
                 W.lists((chars[end] - base).astype(np.int32), per, pa.int32()), W.lists((b - a).astype(np.int32), per, pa.int32())],
                fields=list(_ROW)))
        return pa.concat_arrays(out) if out else pa.array([], _ROW)

    return units


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence",
                   min_words: int = MIN_WORDS, least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns in ``keep``, n_chars,
    n_units (units long enough to be judged) and ``removed``, an array of
    (start, end) in order of place."""
    python_ready(docs)
    base = stage(docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k_{c}") for c in keep],
                             _units_udf(min_words, unit)(text_col).alias("s"))
                 .select("*", "s.*").drop("s").withColumn("_row", F.monotonically_increasing_id()), "units")
    units = base.where(F.size("k1") > 0).select("_id", "_row", F.posexplode(F.arrays_zip("k1", "k2", "start", "end", "words")).alias(
        "i", "u")).select("_id", "_row", "i", "u.*")
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("_row").alias("r"), F.col("i").alias("i"))
    first = stage(units.groupBy("k1", "k2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("m"))
                  .where("m > 1").select("k1", "k2", F.col("first.r").alias("r"), F.col("first.i").alias("f")), "repeated")
    again = units.join(first, ["k1", "k2"]).where("not (_row = r and i = f)").select("_row", "i", "start", "end", "words")
    run = F.col("i") - F.row_number().over(Window.partitionBy("_row").orderBy("i"))          # the units of one text
    gone = again.withColumn("run", run).groupBy("_row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words")).where(F.col("words") >= least).groupBy(
        "_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(gone, "_row", "left").select(
        F.col("_id").alias(id_col), *[F.col(f"_k_{c}").alias(c) for c in keep], F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
        F.size("k1").alias("n_units"), F.coalesce("removed", none).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per row of ``docs``: id, n_units, n_removed, kept_chars and
    spans (start:end of what is removed, comma-joined)."""
    r = repeated_units(docs, id_col, text_col, **kw)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return r.select(id_col, "n_units", F.size("removed").alias("n_removed"), (F.col("n_chars") - gone).alias("kept_chars"),
                    F.array_join(spans, ",").alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the repeated passages cut out of the text and
    ``removed``, their spans in the original text."""
    r = repeated_units(docs, id_col, text_col, keep=tuple(c for c in docs.columns if c != id_col), **kw)
    kept = F.transform(F.sequence(F.lit(0), F.size("removed")), lambda i: F.substring(
        F.col(text_col), F.coalesce(F.get("removed", i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get("removed", i)["start"] - F.coalesce(F.get("removed", i - 1)["end"], F.lit(0)), F.lit(2147483647))))
    return r.withColumn(text_col, F.when(F.size("removed") == 0, F.col(text_col)).otherwise(F.array_join(kept, ""))).select(
        *docs.columns, "removed")
