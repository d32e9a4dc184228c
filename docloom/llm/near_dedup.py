"""Near-duplicate documents by DartMinHash signatures and banded joins.

Each text is the set of its runs of five words, each of weight 1 however often
it is repeated, so that signatures (``dartminhash``) see the similarity that
links are judged by. Signatures are cut into bands; texts that share a band are
candidates; a candidate pair is linked if the plain Jaccard similarity of the
two sets, counted exactly, reaches the threshold. Classes are the connected
components of the links.

No pairs are expanded within a group of copies. Texts of equal word sequences
count as one node. In a band's bucket every node is compared with a few of the
bucket's nodes, the same for all; that joins nearly all that belongs together.
In buckets whose nodes then still stand in several components, the nodes
outside the largest one are compared with all others, in blocks of bounded
size whose tasks report the joined components alone. So every candidate pair
that could join two components is checked, and no table of pairs grows with
the square of a group.

Cases: a null text and a text without a word are classes of their own (an
empty set is similar to nothing), whatever their ids; texts of one to four
words have one run, all their words; rows of equal text fall into one class;
a null id is kept and never names a class unless the class has no other id;
other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import bounded, python_ready, row_key, stage
from docloom.llm.components import connected_components
from docloom.llm.dartminhash import bands as band_hashes
from docloom.llm.dartminhash import signatures

_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count) with each text's distinct shingles (48 bits of
    hash), ascending by doc; a text of fewer words has its whole sequence."""
    hashes, at = w.grams(range(size), seed=17)
    doc = w.doc[at]
    n = w.counts()
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        hashes = np.concatenate([hashes, w.digests((19,))[0][short]])
        doc = np.concatenate([doc, short])
    parts_doc, parts_sh, parts_n = [], [], []
    order = np.argsort(doc, kind="stable") if len(short) else None
    if order is not None:
        hashes, doc = hashes[order], doc[order]
    for lo in range(0, w.n_texts, 1 << 16):          # 16 bits of text index beside 48 of hash
        a, b = np.searchsorted(doc, [lo, lo + (1 << 16)])
        key = np.sort((doc[a:b] - lo).astype(np.uint64) << np.uint64(48) | hashes[a:b] >> np.uint64(16))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        parts_doc.append((key[first] >> np.uint64(48)).astype(np.int64) + lo)
        parts_sh.append(key[first] & _LOW48)
        parts_n.append(np.diff(np.append(first, len(key))))
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(parts_doc, np.int64), cat(parts_sh, np.uint64), cat(parts_n, np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sketch_udf(size: int, n_bands: int, rows: int):
    """text -> (n: distinct shingles, k1, k2: word sequence, bands)."""

    @F.arrow_udf("struct<n:int,k1:bigint,k2:bigint,bands:array<bigint>>")
    def sketch(text: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            doc, sh, _ = shingle_sets(w, size)
            n = np.bincount(doc, minlength=w.n_texts)
            sig = signatures(doc, sh, np.ones(len(sh)), w.n_texts, n_bands * rows)
            b = _signed(band_hashes(sig, n_bands))
            some = n > 0
            k1, k2 = w.digests()
            out.append(pa.StructArray.from_arrays(
                [pa.array(n, pa.int32()), pa.array(_signed(k1), pa.int64()), pa.array(_signed(k2), pa.int64()),
                 W.lists(b[some].reshape(-1), some * n_bands, pa.int64())], ["n", "k1", "k2", "bands"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(
            [("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]))

    return sketch


def _sets_udf(size: int):
    """text -> (k1, k2, shingles)."""

    @F.arrow_udf("struct<k1:bigint,k2:bigint,sh:array<bigint>>")
    def sets(text: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            doc, sh, _ = shingle_sets(w, size)
            k1, k2 = w.digests()
            out.append(pa.StructArray.from_arrays(
                [pa.array(_signed(k1), pa.int64()), pa.array(_signed(k2), pa.int64()),
                 W.lists(_signed(sh), np.bincount(doc, minlength=w.n_texts), pa.int64())], ["k1", "k2", "sh"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(
            [("k1", pa.int64()), ("k2", pa.int64()), ("sh", pa.list_(pa.int64()))]))

    return sets


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b, na, nb) the pairs of nodes whose exact similarity reaches the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), sets.select(
        F.col("node").alias("b"), F.col("sh").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    # the filter must not be pushed into the joins: the intersection is computed once a pair
    common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c"))
    return common.where(F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c")) - 1e-9).select("a", "b")


def _bridges(threshold: float):
    """A group holds a block of a bucket's nodes outside its largest component
    (``own``) and a block of others: the components that links join."""

    def bridges(pdf: pd.DataFrame) -> pd.DataFrame:
        n, comp, own = pdf["n"].to_numpy(), pdf["c"].to_numpy(), pdf["own"].to_numpy()
        _, code = np.unique(np.concatenate(pdf["sh"].tolist()), return_inverse=True)
        start = np.cumsum(n) - n
        mark = np.zeros(code.max() + 1, bool)
        found = set()
        for r in np.flatnonzero(own):
            mine = code[start[r]:start[r] + n[r]]
            mark[mine] = True
            common = np.add.reduceat(mark[code].astype(np.int64), start)
            mark[mine] = False
            near = (common >= threshold * (n + n[r] - common) - 1e-9) & (comp != comp[r])
            found |= {(min(c, comp[r]), max(c, comp[r])) for c in comp[near]}
        del code, mark
        W.release()
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return bridges


def _compare_across(placed: DataFrame, sets: DataFrame, threshold: float, block: int = 200_000) -> DataFrame:
    """(a, b) components joined by links between nodes of one bucket. ``placed``:
    (band, node, n, c) of buckets that hold several components."""
    per = placed.groupBy("band", "c").agg(F.sum("n").alias("w"))
    largest = per.groupBy("band").agg(F.max_by("c", F.struct("w", "c")).alias("g"), F.max("w").alias("wg"), F.sum("w").alias("w"))
    blocks = stage(largest.select("band", "g", F.ceil(F.col("wg") / block).cast("int").alias("ng"),
                                  F.ceil((F.col("w") - F.col("wg")) / block).cast("int").alias("no")), "open-blocks")
    rows = placed.join(blocks, "band").withColumn("own", F.col("c") != F.col("g"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64(F.lit("block"), "node"), F.when(F.col("own"), F.col("no")).otherwise(F.col("ng"))).cast("int"))
    # each of the blocks outside the largest component meets every block of it (j >= 0), and each other one of its kind (j < 0)
    with_largest = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("ng") - 1), lambda j: F.struct(
        F.col("x").alias("i"), j.alias("j"), F.lit(True).alias("own")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda i: F.struct(i.alias("i"), F.col("x").alias("j"), F.lit(False).alias("own"))))
    among = F.when(F.col("own"), F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda k: F.struct(
        F.least("x", k).alias("i"), (-1 - F.greatest("x", k)).alias("j"), (F.col("x") <= k).alias("own")))).otherwise(
        F.array().cast("array<struct<i:int,j:int,own:boolean>>"))
    tasks = rows.select("band", "node", "n", "c", F.explode(F.concat(with_largest, among)).alias("t")).select(
        "band", "t.i", "t.j", "t.own", "node", "n", "c")
    return (tasks.join(sets, "node").select("band", "i", "j", "own", "n", "c", "sh").groupBy("band", "i", "j")
            .applyInPandas(_bridges(threshold), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    threshold: float = 0.8, n_bands: int = 24, rows: int = 5, leaders: int = 4) -> DataFrame:
    """One row per row of ``docs``: (id, class_id, kept). ``class_id`` is the
    smallest id of the row's class, ``kept`` true where the id is the class
    id. With 24 bands of 5 rows a pair of similarity 0.8 becomes a candidate
    with probability 0.9999."""
    python_ready(docs)
    rows_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = _sketch_udf(size, n_bands, rows)
    base = stage(rows_.select("id", F.xxhash64("text").alias("rk"), sketch("text").alias("s"))
                 .select("id", "rk", "s.n", "s.k1", "s.k2", "s.bands"), "sketches")
    nodes = stage(base.where("n > 0").groupBy("k1", "k2").agg(
        F.min("id").alias("first_id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")

    in_band = nodes.select("node", "n", F.explode("bands").alias("band"))
    # nodes that come first in a few orders of their ids; an order is the id with some bits turned over
    turn = [0] + [int(x >> np.uint64(20)) for x in W.constants(leaders - 1, 71)]
    buckets = stage(in_band.groupBy("band").agg(F.count(F.lit(1)).alias("m"), *[
        F.min(F.col("node").bitwiseXOR(F.lit(x).cast("long"))).alias(f"l{i}") for i, x in enumerate(turn)]).where("m > 1").select(
        "band", F.array_distinct(F.array(*[F.col(f"l{i}").bitwiseXOR(F.lit(x).cast("long")) for i, x in enumerate(turn)])).alias("leaders")),
        "buckets")
    members = stage(in_band.join(buckets, "band").select("band", "leaders", F.col("node").alias("b"), F.col("n").alias("nb")),
                    "members")
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"))

    pairs = members.select(F.explode("leaders").alias("a"), "b", "nb").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stage(pairs.join(sizes, "a").join(sizes.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
                  .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9), "pairs")

    # texts of candidates alone: read again, one row per text
    wanted, small = bounded(stage(members.select(F.col("b").alias("node")).distinct().join(nodes, "node")
                                  .select("node", "rk", F.col("k1").alias("q1"), F.col("k2").alias("q2")), "wanted"))
    again = rows_.withColumn("rk", F.xxhash64("text")).join(
        wanted.select("rk") if not small else F.broadcast(wanted.select("rk")), "rk", "left_semi").dropDuplicates(["rk"])
    sets = stage(again.select(_sets_udf(size)("text").alias("s")).select("s.k1", "s.k2", "s.sh")
                 .join(wanted, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))).select("node", "sh"), "sets")

    links = stage(_similar(pairs, sets, threshold), "links")
    comps = stage(connected_components(links), "components")

    placed = members.join(comps.withColumnRenamed("node", "b"), "b", "left").select(
        "band", F.col("b").alias("node"), F.col("nb").alias("n"), F.coalesce("component", "b").alias("c"))
    open_ = stage(placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
                  .where("lo < hi").select("band"), "open")
    if not open_.isEmpty():
        joined = stage(_compare_across(stage(placed.join(open_, "band"), "open-members"), sets, threshold), "bridges")
        if not joined.isEmpty():
            comps = stage(connected_components(links.unionByName(joined)), "all-components")

    named = nodes.select("k1", "k2", "node", "first_id").join(comps, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    classes = stage(named.join(first, "component").select("k1", "k2", "class_id"), "classes")

    some = base.where("n > 0").select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "class_id")
    none = base.where("n = 0").select("id", F.col("id").alias("class_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "class_id", F.expr("id <=> class_id").alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of every class, that of the smallest id (null
    last); of rows equal in id and text one stays."""
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"))
    found = near_duplicates(docs.select(name.alias("_docloom_name"), F.col(text_col).alias("_docloom_text")), "_docloom_name", "_docloom_text", **kw)
    per = stage(found.select(F.col("_docloom_name.rk").alias("_docloom_rk"), "kept").groupBy("_docloom_rk").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("m")), "kept")
    gone, _ = bounded(per.where("not kept").select("_docloom_rk"))
    twice, _ = bounded(per.where("kept and m > 1").select("_docloom_rk"))
    rest = docs.withColumn("_docloom_rk", row_key(id_col, text_col)).join(gone, "_docloom_rk", "left_anti")
    if twice.isEmpty():
        return rest.select(*docs.columns)
    once = rest.join(twice, "_docloom_rk", "left_anti")
    return once.unionByName(rest.join(twice, "_docloom_rk", "left_semi").dropDuplicates(["_docloom_rk"])).select(*docs.columns)
