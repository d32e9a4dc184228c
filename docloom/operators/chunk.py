"""Greedy chunking of a document's words under a token budget (CHK-1..3).

Packing is sequential inside one document and independent across
documents, so it runs row-local (no shuffle) as a JVM higher-order
``aggregate`` over the word costs that records where each chunk starts;
chunk texts are slices of the word array joined with spaces.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.ids import md5_id
from docloom.session import small_batches

CostFn = Callable[[Column], Column]

REASON_NULL = "null text"
REASON_LONG_WORD = "word over token budget"


def length_cost(words: Column) -> Column:
    """Stand-in token cost (not a tokenizer): ceil(chars / 4), at least 1."""
    return F.transform(words, lambda w: F.greatest(F.lit(1), F.ceil(F.length(w) / 4)).cast("int"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _starts(costs: Column, budget: int) -> Column:
    """0-based start index of every chunk: one left fold over the costs whose
    accumulator appends an index only when a chunk opens."""
    init = F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("used"), F.lit(0).alias("i"))

    def step(acc, c):
        new = (acc["i"] == 0) | (acc["used"] + c > budget)
        return F.struct(
            F.when(new, F.concat(acc["s"], F.array(acc["i"]))).otherwise(acc["s"]).alias("s"),
            F.when(new, c).otherwise(acc["used"] + c).alias("used"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(costs, init, step, lambda acc: acc["s"])


def length_cost_np(words: list[str]) -> np.ndarray:
    """The same stand-in cost for the Arrow engine: ceil(chars / 4), at least 1."""
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.maximum(1, (lens + 3) // 4)


def pack_words(text: str | None, budget: int, cost=length_cost_np) -> tuple[list[str] | None, str | None]:
    """Greedy packing of one text. With cumulative costs ``cum``, a chunk
    starting at word s ends before the first e with cum[e] - cum[s] > budget,
    so each chunk is one binary search: O(chunks * log words) after the split."""
    if text is None:
        return None, REASON_NULL
    words = [w for w in text.split(" ") if w]
    if not words:
        return [], None
    costs = np.asarray(cost(words), dtype=np.int64)
    if int(costs.max()) > budget:
        return None, REASON_LONG_WORD
    cum = np.concatenate(([0], np.cumsum(costs)))
    out, start, n = [], 0, len(words)
    while start < n:
        end = int(np.searchsorted(cum, cum[start] + budget, side="right")) - 1
        out.append(" ".join(words[start:end]))
        start = end
    return out, None


def _arrow_packer(budget: int, cost):
    @F.pandas_udf("struct<chunks: array<string>, reason: string>")
    def pack(texts: pd.Series) -> pd.DataFrame:
        res = [pack_words(t, budget, cost) for t in texts]
        return pd.DataFrame({"chunks": [r[0] if r[0] is not None else [] for r in res],
                             "reason": [r[1] for r in res]})
    return pack


def stage_chunks(df: DataFrame, text_col: str = "text", budget: int = 510, cost=None,
                 reason_col: str = "fail_reason", engine: str = "arrow") -> DataFrame:
    """Document-level staging: ``_chunks`` (ARRAY of chunk texts) and the
    failure reason; the text column itself is dropped. Row-local: no shuffle.

    ``engine="arrow"`` (default): the packing kernel above in an Arrow-batched
    pandas UDF; ``cost`` is a Python function (list of words -> costs), the
    natural plug point for a real tokenizer. ``engine="sql"``: the same rule
    as a JVM ``aggregate`` fold; ``cost`` is a Column function."""
    if engine == "arrow":
        small_batches(df.sparkSession)                      # a batch's words and chunks are held at once
        keep = [c for c in df.columns if c != text_col]
        r = df.select(*keep, _arrow_packer(budget, cost or length_cost_np)(F.col(text_col)).alias("_r"))
        return r.select(*keep, F.col("_r.reason").alias(reason_col), F.col("_r.chunks").alias("_chunks"))
    return _stage_chunks_sql(df, text_col, budget, cost or length_cost, reason_col)


def _stage_chunks_sql(df: DataFrame, text_col: str = "text", budget: int = 510, cost: CostFn = length_cost,
                      reason_col: str = "fail_reason") -> DataFrame:
    """Document-level staging: ``_chunks`` (ARRAY of chunk texts) and the
    failure reason; the text column itself is dropped. Row-local: no shuffle.

    Lambdas read only their own variables: the word array reaches the slicing
    lambda through ``arrays_zip`` (``array_repeat`` copies references only),
    because a computed column read inside a lambda body is re-evaluated per
    element once Catalyst inlines it."""
    keep = [c for c in df.columns if c != text_col]
    t = F.col(text_col)
    s1 = df.select(*keep, t.isNull().alias("_null"), _words(t).alias("_w"))
    s2 = s1.select(*keep, "_null", "_w", cost(F.col("_w")).alias("_cost"))
    reason = (F.when(F.col("_null"), F.lit(REASON_NULL))
              .when(F.exists("_cost", lambda c: c > budget), F.lit(REASON_LONG_WORD)))
    s3 = s2.select(*keep, reason.alias(reason_col), "_w", _starts(F.col("_cost"), budget).alias("_st"))
    ends = F.concat(F.slice("_st", 2, F.greatest(F.size("_st") - 1, F.lit(0))), F.array(F.size("_w")))
    lens = F.zip_with(ends, "_st", lambda e, b: e - b)
    z = F.arrays_zip(F.col("_st").alias("s"), lens.alias("l"), F.array_repeat("_w", F.size("_st")).alias("ws"))
    chunks = F.transform(z, lambda r: F.array_join(F.slice(r["ws"], r["s"] + 1, r["l"]), " "))
    return s3.select(*keep, reason_col, F.when(F.col(reason_col).isNull() & (F.size("_w") > 0), chunks)
                     .otherwise(F.array().cast("array<string>")).alias("_chunks"))


def explode_chunks(staged: DataFrame, text_col: str = "text", reason_col: str = "fail_reason") -> DataFrame:
    """One row per chunk; a failed document keeps one row with NULL pos/text.

    ``posexplode_outer`` on purpose: for a plain ``explode`` Catalyst infers
    a ``size(arr) > 0`` filter below the generator, and that filter inlines
    the whole packing expression a second time."""
    keep = [c for c in staged.columns if c != "_chunks"]
    arr = F.when(F.col(reason_col).isNull(), F.col("_chunks")).otherwise(F.array(F.lit(None).cast("string")))
    out = staged.select(*keep, F.posexplode_outer(arr).alias("pos", text_col))
    out = out.where(F.col("pos").isNotNull() | F.col(reason_col).isNotNull())
    return out.withColumn("pos", F.when(F.col(reason_col).isNull(), F.col("pos").cast("int")))


def chunk_documents(df: DataFrame, text_col: str = "text", budget: int = 510, cost=None,
                    reason_col: str = "fail_reason", engine: str = "arrow") -> DataFrame:
    """One row per chunk ``(…, pos, text)``; a failing document yields one row
    with NULL pos/text and its reason instead (whole document fails, the
    others go on). Document columns (metadata) are carried to every chunk."""
    return explode_chunks(stage_chunks(df, text_col, budget, cost, reason_col, engine), text_col, reason_col)


def chunk_by_token_budget(df: DataFrame, text_col: str = "text", budget: int = 510, cost=None,
                          engine: str = "arrow") -> DataFrame:
    """Chunks of the documents that did not fail, with ``chunk_id``."""
    out = chunk_documents(df, text_col, budget, cost, engine=engine)
    return with_chunk_id(out.filter(F.col("pos").isNotNull()).drop("fail_reason"), text_col)


def with_chunk_id(df: DataFrame, text_col: str = "text", out: str = "chunk_id") -> DataFrame:
    """Chunk id = MD5 hex of the chunk text (same text, same id)."""
    return df.withColumn(out, md5_id(text_col))


def split_failures(chunked: DataFrame, file_col: str = "file", reason_col: str = "fail_reason"):
    """(ok chunk rows, failed(file, reason)) from :func:`chunk_documents`.

    Split on the generated ``pos`` (NULL only for failed documents): a
    filter on the reason itself would be pushed below the generator and
    re-run cleaning and costing inside the scan filter."""
    ok = chunked.filter(F.col("pos").isNotNull()).drop(reason_col)
    failed = chunked.filter(F.col("pos").isNull()).select(file_col, F.col(reason_col).alias("reason"))
    return ok, failed
