"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words: it hashes the words at the kept
positions and ignores the others, so a hit survives substitutions at ignored
positions. Every window of every text and of every benchmark item is hashed
under all masks; equal hashes are joined in Spark and name (text, item,
diagonal) triples, where the diagonal is the word offset of the item in the
text. Each triple is then verified: along the diagonal the text's words are
compared with the item's, and runs of words that mostly agree count as
overlap. A text is contaminated by an item if verified runs cover enough of
the item's words.

The masks miss nothing that the verification accepts: every run of at least
``SHORT`` equal words with gaps of at most ``GAP`` and a share of 0.6 equal
words keeps the positions of some mask, wherever its unequal words stand (a
test goes through all such runs). Texts are thus judged as if all diagonals
had been verified. Calls that ask for less than that need masks of their own.

An item of fewer than ``SHORT`` words is too short for runs with substitutions:
it is met whole and exactly, by a mask of its own length.

The windows of a text whose hash no benchmark item has can't join; where the
benchmark's seeds are few (rows, counted) they are sent to the tasks and drop
such windows before the join, else all windows are joined by shuffling. A
verification reads the words along its diagonals alone, not the whole text; a
batch of them is compared at once, and only pairs with enough equal words are
looked at one by one. So a phrase that many items share costs a comparison of a
few words an item and text.

Cases: null and empty texts have no words and are clean; items that are null or
without a word contaminate nothing; repeated rows and repeated items give the
same answers for each; rows of a null id are judged like others; other columns
are ignored; an empty table gives no rows, an empty benchmark leaves every text
clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import bounded, python_ready, row_key, stage

#: Kept positions of each mask, fixed values that together meet every run the verification accepts.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 4, 5), (0, 1, 5, 6), (0, 2, 4, 6), (0, 1, 3, 7), (0, 1, 4, 7), (0, 2, 5, 7), (0, 1, 8, 9))
SHORT = 6
GAP = 6
#: Masks of items that are shorter than that, by their words.
SHORT_MASKS = {n: tuple(range(n)) for n in range(1, SHORT)}
#: Most rows of benchmark seeds, and of items' words, that are sent to the tasks.
MOST_ROWS = 4_000_000


def _seeds(w: W.Words, masks) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every window of one item under every mask; a short item has its whole as a window."""
    n = len(w.h)
    if n < SHORT:
        return w.grams(SHORT_MASKS[n], 200 + n) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = [w.grams(m, 100 + i) for i, m in enumerate(masks)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _signed(x):
    return x.view(np.int64)


_HIT = pa.struct([("words", pa.int32()), ("h", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())),
                  ("toks", pa.list_(pa.int64()))])


def _hits_udf(masks, known, short: list[int]):
    """text -> (number of words, hashes and places of windows that ``known``
    may hold, and the hashes of all words of a text that has such windows)."""
    @F.arrow_udf("struct<words:int,h:array<bigint>,pos:array<int>,toks:array<bigint>>")
    def hits(text: pa.Array) -> pa.Array:
        if known is not None:
            have = known.value
            small = np.zeros(1 << 20, bool)
            small[have >> np.uint64(44)] = True
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            hs, ats = [], []
            for m, seed in [*((m, 100 + i) for i, m in enumerate(masks)), *((SHORT_MASKS[n], 200 + n) for n in short)]:
                h, at = w.grams(m, seed)
                if known is not None:
                    maybe = np.flatnonzero(small[h >> np.uint64(44)])
                    h, at = h[maybe], at[maybe]
                    if len(h) and len(have):
                        sure = have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h
                        h, at = h[sure], at[sure]
                hs.append(h)
                ats.append(at)
            h, at = np.concatenate(hs), np.concatenate(ats)
            doc = w.doc[at]
            order = np.argsort(doc, kind="stable")
            h, at, doc = h[order], at[order], doc[order]
            n = np.bincount(doc, minlength=w.n_texts)
            toks = W.lists(_signed(w.h[np.flatnonzero(n[w.doc] > 0)]), np.where(n > 0, w.counts(), 0), pa.int64())
            out.append(pa.StructArray.from_arrays(
                [pa.array(w.counts(), pa.int32()), W.lists(_signed(h), n, pa.int64()),
                 W.lists((at - w.first[doc]).astype(np.int32), n, pa.int32()), toks], fields=list(_HIT)))
        return pa.concat_arrays(out) if out else pa.array([], _HIT)

    return hits


def _item_udf(masks):
    """item text -> (its words' hashes, its seeds' hashes and places)."""
    kind = pa.struct([("toks", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32()))])

    @F.arrow_udf("struct<toks:array<bigint>,h:array<bigint>,pos:array<int>>")
    def item(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            w = W.Words(pa.array([t.as_py()], pa.string()))
            h, at = _seeds(w, masks)
            rows.append({"toks": _signed(w.h).tolist(), "h": _signed(h).tolist(), "pos": at.tolist()})
        return pa.array(rows, kind)

    return item


def runs(text: np.ndarray, item: np.ndarray, diagonal: int, least: int, agree: float) -> np.ndarray:
    """Which words of the item stand in a run, along the diagonal, that starts
    and ends with equal words, has ``least`` equal words and a share
    ``agree`` of equal words; mask over the item's words."""
    cover = np.zeros(len(item), bool)
    a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if b > a:
        cover[a:b] = _covered(text[a + diagonal:b + diagonal] == item[a:b], least, agree)
    return cover


def _covered(same: np.ndarray, least: int, agree: float) -> np.ndarray:
    """Of the equal words along a diagonal those that stand in a run."""
    cover = np.zeros(len(same), bool)
    at = np.flatnonzero(same)
    # greedy: lengthen a run while the share of equal words in it stays high enough
    i = 0
    while i < len(at):
        j = best = i
        while j + 1 < len(at) and (j + 2 - i) >= agree * (at[j + 1] - at[i] + 1) - 2 and at[j + 1] - at[j] <= GAP:
            j += 1
            if (j + 1 - i) >= agree * (at[j] - at[i] + 1):
                best = j
        if best + 1 - i >= least:
            cover[at[i]:at[best] + 1] |= same[at[i]:at[best] + 1]
        i = best + 1
    return cover


_SEEN = pa.struct([("covered", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _verify_udf(least: int, agree: float, enough: int, share: float):
    """(windows of the text along the diagonals, the diagonals, the item's
    words) -> words covered and their span in the text; a pair whose windows
    hold too few equal words is not looked at further (covered: 0)."""
    @F.arrow_udf("struct<covered:int,start:int,end:int>")
    def verify(windows: pa.Array, diagonals: pa.Array, item: pa.Array) -> pa.Array:
        # flat: every word of every window beside the item's word on the same place
        n_win = windows.value_lengths().to_numpy()
        pair = np.repeat(np.arange(len(windows)), n_win)
        flat = windows.flatten()
        n = flat.value_lengths().to_numpy().astype(np.int64)
        words = flat.flatten().to_numpy(zero_copy_only=False)
        d = diagonals.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        items = item.flatten().to_numpy(zero_copy_only=False)
        length = item.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(length) - length
        begin = np.cumsum(n) - n
        a = np.maximum(0, -d)                              # the item's word on which a window begins
        at = np.repeat(first[pair] + a - begin, n) + np.arange(len(words))
        same = words == items[at]
        total = np.add.reduceat(np.append(same, False).astype(np.int64), begin) * (n > 0) if len(n) else np.zeros(0, np.int64)
        equal = np.bincount(pair, total, len(windows))
        short = length < SHORT
        need = np.where(short, length, np.minimum(enough, share * length))
        rows = [(0, None, None)] * len(windows)
        which = np.searchsorted(pair, np.arange(len(windows) + 1))
        for i in np.flatnonzero((equal >= need - 1e-9) & (length > 0)):
            cover, lo, hi = np.zeros(length[i], bool), None, None
            for k in range(which[i], which[i + 1]):
                mine = same[begin[k]:begin[k] + n[k]]
                got = np.flatnonzero(mine if short[i] and mine.all() and n[k] == length[i] else _covered(mine, least, agree))
                if len(got):
                    cover[a[k] + got] = True
                    x, y = int(a[k] + got[0] + d[k]), int(a[k] + got[-1] + d[k] + 1)
                    lo, hi = x if lo is None else min(lo, x), y if hi is None else max(hi, y)
            rows[i] = (int(cover.sum()), lo, hi)
        return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in zip(*rows)], fields=list(_SEEN)) if rows else pa.array([], _SEEN)

    return verify


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", masks=MASKS, least: int = 6, agree: float = 0.6,
             enough: int = 13, share: float = 0.6, most_rows: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per row of ``docs``: (rk, id, n_words), where equal
    rows share rk. One row per contaminated (rk, item): (rk, item, n_item,
    covered, start, end), the span in words of the text. An item contaminates
    a text if verified runs cover ``enough`` of its words or the ``share`` of
    them, an item of fewer than ``SHORT`` words if it stands in it whole."""
    python_ready(docs)
    items = stage(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("t")).where("t is not null")
                  .distinct().select("item", _item_udf(masks)("t").alias("s")).select("item", "s.*")
                  .withColumn("nr", F.monotonically_increasing_id()), "items")
    seeds = stage(items.select("nr", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("nr", "s.h", F.col("s.pos").alias("at")), "seeds")
    short = sorted(r[0] for r in items.where((F.size("toks") > 0) & (F.size("toks") < SHORT)).select(F.size("toks")).distinct().collect())
    few = seeds.limit(most_rows + 1).count() <= most_rows
    # an item's words, a row each word, are as bounded as its seeds: a long item has more seeds than words
    known = None
    if few:
        got = seeds.select("h").distinct().toPandas()       # bounded: at most most_rows rows
        known = docs.sparkSession.sparkContext.broadcast(np.sort(got["h"].to_numpy(np.int64).view(np.uint64)))
    send = F.broadcast if few else (lambda df: df)
    base = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                 .select("id", row_key("id", "text").alias("rk"), _hits_udf(masks, known, short)("text").alias("s"))
                 .select("id", "rk", "s.*"), "seed-hits")
    hit = base.where(F.size("h") > 0).dropDuplicates(["rk"])
    diagonals = stage(hit.select("rk", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("rk", "s.h", "s.pos")
                      .join(send(seeds), "h").select("rk", "nr", (F.col("pos") - F.col("at")).alias("d")).distinct(), "diagonals")
    tokens = items.select("nr", "item", F.col("toks").alias("item_toks"))
    a = F.greatest(F.lit(0), -F.col("d"))
    along = F.slice("toks", F.col("d") + a + 1, F.greatest(F.lit(0), F.least(F.size("item_toks"), F.size("toks") - F.col("d")) - a))
    pairs = diagonals.join(hit.select("rk", "toks"), "rk").join(send(tokens), "nr").select(
        "rk", "nr", "d", along.alias("w")).groupBy("rk", "nr").agg(F.collect_list(F.struct("d", "w")).alias("ds"))   # one text's diagonals
    found = (pairs.join(send(tokens), "nr").select("rk", "item", F.size("item_toks").alias("n_item"), _verify_udf(least, agree, enough, share)(
        F.col("ds.w"), F.col("ds.d"), "item_toks").alias("v")).select("rk", "item", "n_item", "v.*")
        .where((F.col("covered") > 0) & F.when(F.col("n_item") < SHORT, F.col("covered") == F.col("n_item")).otherwise(
            (F.col("covered") >= enough) | (F.col("covered") >= F.col("n_item") * share))))
    return base.select("rk", "id", F.col("words").alias("n_words")), stage(found, "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per row of ``docs``: id, n_words, contaminated, n_items, items
    (distinct item ids, ascending, comma-joined) and covered (most words that
    one item covers)."""
    rows, found = overlaps(docs, benchmark, id_col=id_col, **kw)
    per = stage(found.groupBy("rk").agg(F.array_sort(F.collect_set("item")).alias("ids"), F.max("covered").alias("covered"),
                                        F.countDistinct("item").alias("n_items")), "contaminated-rows")
    return rows.join(per, "rk", "left").select(
        F.col("id").alias(id_col), "n_words", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("covered", F.lit(0)).alias("covered"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that an item contaminates."""
    _, found = overlaps(docs, benchmark, id_col, text_col, **kw)
    gone, _ = bounded(stage(found.select(F.col("rk").alias("_docloom_rk")).distinct(), "contaminated-keys"))
    return docs.withColumn("_docloom_rk", row_key(id_col, text_col)).join(gone, "_docloom_rk", "left_anti").select(*docs.columns)
