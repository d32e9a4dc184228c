"""Fine-tuning data preparation (SFT-1..9, SNK-6).

Randomness is a seeded hash of the row id (repeatable, independent of
partitioning). Nothing orders a whole table in one task: the exact split
finds its cut with bounded histograms, packing uses a two-level prefix sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.ids import md5_bucket32, seeded_key
from docloom.session import materialize
from docloom.functions.text import py_strip

# Prompt templates of the instruction data (inner lines carry
# four leading spaces, as in the original templates).
ALPACA_TEMPLATE = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n"
    "    ### Instruction:\n"
    "    {instruction}\n"
    "\n"
    "    ### Input:\n"
    "    {input}"
)
CHAT_SYSTEM_TEMPLATE = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n"
    "    INPUT:\n"
    "    {input}"
)


def shuffle_seeded(df: DataFrame, id_col: str, seed: int = 42, out: str = "ord") -> DataFrame:
    """Adds a repeatable random order key; sort by it (range-partitioned) to shuffle."""
    return df.withColumn(out, seeded_key(seed, id_col))


def _fill(template: str, **cols: Column) -> Column:
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(cols[rest[i + 1:j]].cast("string"), F.lit("None")))
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def _m(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def format_instruct(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(instruction, input, output) -> messages [user: template, assistant: output]."""
    user = _fill(ALPACA_TEMPLATE, instruction=F.col("instruction"), input=F.col("input"))
    return df.select(*keep, F.array(_m("user", user), _m("assistant", F.col("output"))).alias("messages"))


def format_chat(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(instruction, input, output) -> [system(with input), user, assistant]."""
    system = _fill(CHAT_SYSTEM_TEMPLATE, input=F.col("input"))
    return df.select(*keep, F.array(_m("system", system), _m("user", F.col("instruction")),
                                    _m("assistant", F.col("output"))).alias("messages"))


def train_test_split(df: DataFrame, id_col: str, frac: float = 0.01, seed: int = 42, mode: str = "exact") -> DataFrame:
    """Adds ``split`` in {train, test}.

    ``exact``: test = the ceil(frac * n) rows with the smallest seeded key.
    The cut key is found with two bounded histograms over key prefixes
    (65,536 cells each) and the distinct keys of the boundary cell, so no
    task ever sorts the table. Rows with the same id share a key and land on
    the same side.
    ``hash``: map-only, test when the 32-bit key bucket < frac * 2^32."""
    key = seeded_key(seed, id_col)
    if mode == "hash":
        return df.withColumn("split", F.when(md5_bucket32(key) < F.lit(int(frac * (1 << 32))), "test").otherwise("train"))
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    k = df.withColumn("_key", key)
    keys = materialize(k.select("_key"), "split-keys")    # the input runs once for the cut, then for the split
    n_test = math.ceil(frac * keys.count())
    cut = _kth_key(keys, n_test)
    split = F.when(F.lit(cut).isNotNull() & (F.col("_key") <= F.lit(cut)), "test").otherwise("train")
    return k.withColumn("split", split).drop("_key")


def _kth_key(k: DataFrame, m: int) -> str | None:
    """The m-th smallest ``_key`` (1-based), via prefix histograms."""
    if m <= 0:
        return None
    prefix = ""
    need = m
    scope = k
    for width in (4, 4):
        lo = len(prefix) + 1
        hist = (scope.groupBy(F.substring("_key", lo, width).alias("p")).count().orderBy("p").collect())  # <= 65,536 rows
        acc = 0
        for row in hist:
            if acc + row["count"] >= need:
                prefix += row["p"]
                need -= acc
                break
            acc += row["count"]
        scope = k.where(F.substring("_key", 1, len(prefix)) == prefix)
    # distinct keys of the boundary cell with their counts (about n / 2^32 keys; repeated ids collapse
    # map-side), then the cut is the first key whose running count reaches ``need``
    acc = 0
    for row in scope.groupBy("_key").count().orderBy("_key").collect():
        acc += row["count"]
        if acc >= need:
            return row["_key"]
    return None


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def chat_template(messages: str | Column = "messages", n: int | None = None, add_generation_prompt: bool = True) -> Column:
    """ChatML text of the first ``n`` messages (default: all before the last
    assistant message; ``n=2`` reproduces the original evaluation prompt,
    which includes the gold answer), plus the assistant header."""
    m = F.col(messages) if isinstance(messages, str) else messages
    if n is None:
        last_asst = F.aggregate(F.transform(m, lambda x, i: F.when(x["role"] == "assistant", i + 1).otherwise(0)),
                                F.lit(0), lambda a, v: F.greatest(a, v))
        take = F.when(last_asst > 0, last_asst - 1).otherwise(F.size(m))
        sel = F.slice(m, 1, take)
    else:
        sel = F.slice(m, 1, n)
    body = F.array_join(F.transform(sel, lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"),
                                                            x["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if add_generation_prompt else body


def token_count(text: Column) -> Column:
    """Stand-in token count (not a tokenizer): sum of ceil(chars/4) over words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(F.transform(words, lambda w: F.greatest(F.lit(1), F.ceil(F.length(w) / 4)).cast("bigint")),
                       F.lit(0).cast("bigint"), lambda a, x: a + x)


def pack_sequences(df: DataFrame, id_col: str, ord_col: str, n_col: str, block_len: int = 2048,
                   rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Concatenate samples' tokens in ``ord`` order and cut blocks of
    ``block_len``; the last partial block is dropped.

    Returns spans ``(block, id, from, to)`` (token offsets inside the sample,
    ``to`` exclusive). Offsets come from a two-level prefix sum: bucket
    totals (a small table) then a running sum inside each bucket, so no
    window runs over the whole table. ``ord`` must be a uniform hex key
    (:func:`shuffle_seeded`)."""
    base = df.select(id_col, ord_col, F.col(n_col).cast("bigint").alias("_n")).where(F.col("_n") > 0)
    n_rows = base.count()
    nb = max(1, math.ceil(n_rows / rows_per_bucket))
    b = base.withColumn("_b", (md5_free_bucket(F.col(ord_col)) * nb / F.lit(float(1 << 32))).cast("bigint"))
    totals = b.groupBy("_b").agg(F.sum("_n").alias("_t"))
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # over <= nb rows only
    offs = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_all), F.lit(0))).select("_b", "_off")
    grand = totals.agg(F.sum("_t")).first()[0] or 0
    full_blocks = grand // block_len
    w = Window.partitionBy("_b").orderBy(ord_col, id_col).rowsBetween(Window.unboundedPreceding, 0)
    s = (b.join(F.broadcast(offs), "_b")   # one row per bucket: bounded by n_rows / rows_per_bucket
         .withColumn("_end", F.col("_off") + F.sum("_n").over(w))
         .withColumn("_start", F.col("_end") - F.col("_n")))
    spans = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block_len),
                                                       F.floor((F.col("_end") - 1) / block_len))))
    spans = spans.where(F.col("block") < F.lit(full_blocks))
    lo = F.greatest(F.col("_start"), F.col("block") * block_len)
    hi = F.least(F.col("_end"), (F.col("block") + 1) * block_len)
    return spans.select(F.col("block").cast("bigint"), id_col, (lo - F.col("_start")).alias("from"),
                        (hi - F.col("_start")).alias("to"))


def md5_free_bucket(hex_key: Column) -> Column:
    """First 32 bits of an existing hex key as BIGINT."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("bigint")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """First n rows after the seeded shuffle (a top-n: TakeOrderedAndProject)."""
    return df.withColumn("_k", seeded_key(seed, id_col)).orderBy("_k").limit(n).drop("_k")


def extract_prediction(out: Column, prompt: Column, skip: int = 7) -> Column:
    """Generated text from character ``len(prompt) + skip`` on, stripped."""
    return py_strip(F.substr(out, F.length(prompt) + F.lit(skip + 1)))


def predictions_table(df: DataFrame, pred_col: str = "pred") -> DataFrame:
    """(id, pred) where id is the first message's content."""
    return df.select(F.element_at(F.col("messages"), 1)["content"].alias("id"), F.col(pred_col).alias("pred"))
