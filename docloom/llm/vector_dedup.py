"""Near-duplicate vectors by a forest of random-projection trees with spill.

Vectors are scaled to length one. A tree splits along a direction drawn at
random, of several the one along which its rows spread most, at the median of
the projections; vectors within a margin of the split go to both sides, so that
a pair near the threshold is seldom parted. The margin is a multiple of the
spread that such a pair's projections have, and less where rows lie so close
that more than an eighth of them would go both ways, so no cluster multiplies
its rows from level to level; where even a third of that margin is too much, the
rows are a dense cluster and stay one leaf. Several trees make a miss rarer still:
trees are added until pairs planted at the threshold (sampled vectors and
copies turned by that angle) share a leaf, up to ``MOST_TREES``.

Trees are fitted on a bounded sample; every vector is indexed. A leaf that has
far more rows than it should, as the sample was too small to split it, is split
again by a tree of its own, fitted in a task on a bounded sample of its rows,
until leaves are small or dense. Vectors are compared within leaves by cosine
in double precision.

A leaf of many rows (a dense cluster, that no split can part) is cut into
blocks of bounded size, and a task compares two blocks. Links are counted,
never listed: a pair that shares several leaves is counted in the first of
them alone. What a task finds connected it reports as one edge a row, from
the row to the smallest of its group; components are then joined in Spark.
Equal vectors are one node with a count.

Cases: vectors that are null, empty, all zero, or hold null or non-finite
components link with nothing and are their own component; vectors of
different lengths never link; equal vectors link (a count of other rows);
repeated rows are vectors of their own; a null id is kept, and a component is
named by its smallest non-null id; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, python_ready, stage
from docloom.llm.components import connected_components

SAMPLE = 50_000
LEAF = 48
BLOCK = 1_024
TREES, MOST_TREES = 4, 24
#: Most rows on both sides of a split, for each row that is split; least part of the margin that makes do.
SPILL, LEAST_MARGIN = 1.12, 0.3
#: Planted pairs, and the share of them that the trees have to find.
PLANTED, FOUND = 2_000, 0.995
#: A leaf of more rows than this multiple of ``leaf`` is split again, on so many of its rows.
OVERSIZE, REFIT = 8, 4_000


def usable(vec: str) -> Column:
    """True for a vector with a direction."""
    return F.coalesce((F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_tree(sample: np.ndarray, scale: float, threshold: float, leaf: int, spill: float, rng) -> dict:
    """A tree as arrays ``way`` (directions), ``cut``, ``margin``, ``child``
    (two for every inner node; a leaf's number, negative), ``root`` and its
    number of ``leaves``. ``scale``: vectors a sampled one stands for."""
    d = sample.shape[1]
    full = spill * math.sqrt((2 - 2 * threshold) / d)
    way, cut, margin, child, leaves, root = [], [], [], [], 0, 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, parent = todo.pop()
        split = None
        if len(rows) * scale > leaf and len(rows) >= 32:
            ways = rng.standard_normal((4, d))
            ways /= np.linalg.norm(ways, axis=1, keepdims=True)
            projected = sample[rows] @ ways.T
            best = int(np.ptp(np.quantile(projected, (0.25, 0.75), axis=0), axis=0).argmax())
            p = projected[:, best]
            t = float(np.median(p))
            gap = np.sort(np.abs(p - t))
            # what lies nearer than this would go both ways in too great a number
            m = min(full, float(gap[min(len(gap) - 1, int((SPILL - 1) * len(gap)))]))
            left, right = rows[p < t + m], rows[p > t - m]
            if m >= LEAST_MARGIN * full and max(len(left), len(right)) <= 0.8 * len(rows):
                split = (ways[best], t, m, left, right)
        if split is None:
            me = -leaves - 1
            leaves += 1
        else:
            me = len(way)
            way.append(split[0])
            cut.append(split[1])
            margin.append(split[2])
            child.append([0, 0])
            todo += [(split[3], (me, 0)), (split[4], (me, 1))]
        if parent is None:
            root = me
        else:
            child[parent[0]][parent[1]] = me
    return {"way": np.array(way).reshape(len(way), d), "cut": np.array(cut), "margin": np.array(margin),
            "child": np.array(child, np.int64).reshape(-1, 2), "root": root, "leaves": leaves}


def fit_forest(sample: np.ndarray, scale: float, threshold: float, trees: int, leaf: int, spill: float, seed: int,
               most: int = MOST_TREES) -> list[dict]:
    """At least ``trees`` trees, more while planted pairs are missed."""
    rng = np.random.default_rng(seed)
    one = sample[rng.choice(len(sample), min(PLANTED, len(sample)), replace=False)]
    turn = rng.standard_normal(one.shape)
    turn -= (turn * one).sum(axis=1, keepdims=True) * one
    size = np.linalg.norm(turn, axis=1, keepdims=True)
    two = threshold * one + math.sqrt(1 - threshold * threshold) * turn / np.where(size > 0, size, 1)
    forest, found = [], np.zeros(len(one), bool)
    while len(forest) < trees or len(forest) < most and found.mean() < FOUND:
        forest.append(fit_tree(sample, scale, threshold, leaf, spill, rng))
        row, at = leaves_of(np.concatenate([one, two]), forest[-1:])
        names = np.unique((row % len(one)) * forest[-1]["leaves"] + at, return_counts=True)
        found[names[0][names[1] > 1] // forest[-1]["leaves"]] = True
        if forest[-1]["leaves"] == 1 and len(forest) >= trees:
            break                                           # one dense cluster: all are compared with all
    return forest


def leaves_of(x: np.ndarray, forest: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each vector stands in, leaves numbered through all trees."""
    rows_out, leaf_out, first = [], [], 0
    for t in forest:
        todo = [(np.arange(len(x)), t["root"])]
        while todo:
            rows, node = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), first - node - 1))
                continue
            p = x[rows] @ t["way"][node]
            todo += [(rows[p < t["cut"][node] + t["margin"][node]], t["child"][node, 0]),
                     (rows[p > t["cut"][node] - t["margin"][node]], t["child"][node, 1])]
        first += t["leaves"]
    return np.concatenate(rows_out), np.concatenate(leaf_out)


def _matrix(vecs: pa.Array) -> np.ndarray:
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(vecs), -1))


def _index_udf(sent):
    @F.arrow_udf("array<bigint>")
    def index(vecs: pa.Array) -> pa.Array:
        if not len(vecs):
            return pa.array([], pa.list_(pa.int64()))
        row, leaf = leaves_of(_matrix(vecs), sent.value)
        order = np.lexsort((leaf, row))
        n = np.bincount(row, minlength=len(vecs))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(leaf[order], pa.int64()))

    return index


def _refit(threshold: float, leaf: int, spill: float, seed: int):
    """A sample of an oversized leaf's rows -> a tree of its own, pickled; none where it can't be split."""
    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf.sort_values("node")["vec"].to_numpy()).astype(np.float64))
        rng = np.random.default_rng([seed, int(pdf["leaf"].iloc[0]) & 0x7FFFFFFF])
        tree = fit_tree(x, float(pdf["rows"].iloc[0]) / len(x), threshold, leaf, spill, rng)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[:1], "tree": [pickle.dumps(tree)]}) if tree["leaves"] > 1 else pd.DataFrame(
            {"leaf": pdf["leaf"].iloc[:0], "tree": []})

    return refit


def _split(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """Rows of a leaf, a bounded number, to the leaves of its tree."""
    if not len(rows) or not len(trees):
        return pd.DataFrame({"node": rows["node"].iloc[:0], "leaf": rows["leaf"].iloc[:0], "sub": np.zeros(0, np.int64)})
    row, sub = leaves_of(unit(np.stack(rows["vec"].to_numpy()).astype(np.float64)), [pickle.loads(trees["tree"].iloc[0])])
    return pd.DataFrame({"node": rows["node"].to_numpy()[row], "leaf": rows["leaf"].to_numpy()[row], "sub": sub})


def _small_leaves(rows: DataFrame, nodes: DataFrame, threshold: float, leaf: int, spill: float, seed: int) -> DataFrame:
    """(node, leaf) with oversized leaves split again from their own rows, as long as that parts them."""
    done, level = None, 0
    while True:
        sizes = stage(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > OVERSIZE * leaf), "oversized")
        if sizes.isEmpty():
            break
        chosen = rows.join(sizes, "leaf").where(F.pmod(F.xxhash64(F.lit(seed + level), "node", "leaf"), F.lit(1 << 30))
                                                < F.least(F.lit(1.0), REFIT / F.col("rows")) * (1 << 30))
        trees = stage(chosen.join(nodes.select("node", "vec"), "node").groupBy("leaf").applyInPandas(
            _refit(threshold, leaf, spill, seed + level), "leaf bigint, tree binary"), "leaf-trees")
        if trees.isEmpty():
            break
        chunks = sizes.join(trees.select("leaf"), "leaf").withColumn("chunks", F.ceil(F.col("rows") / 20_000).cast("int"))
        mine = rows.join(chunks.select("leaf", "chunks"), "leaf").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        theirs = trees.join(chunks.select("leaf", "chunks"), "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        split = mine.join(nodes.select("node", "vec"), "node").select("leaf", "chunk", "node", "vec").groupBy("leaf", "chunk").cogroup(
            theirs.select("leaf", "chunk", "tree").groupBy("leaf", "chunk")).applyInPandas(_split, "node bigint, leaf bigint, sub bigint")
        rest = stage(rows.join(trees.select("leaf"), "leaf", "left_anti"), "settled")
        done = rest if done is None else done.unionByName(rest)
        rows = stage(split.select("node", F.xxhash64(F.lit(level), "leaf", "sub").alias("leaf")), "split-leaves")
        level += 1
    return rows if done is None else stage(done.unionByName(rows), "small-leaves")


def _compare(threshold: float):
    """A group is two blocks of a leaf (or one twice): links that no earlier
    leaf has, and the smallest node that each node is connected to here."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
        leaf, b1, b2 = (int(pdf[c].iloc[0]) for c in ("leaf", "b1", "b2"))
        block, node, copies = pdf["block"].to_numpy(), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if b1 != b2:                                      # pairs within a block are another task's
            near &= block[:, None] != block[None, :]
        some = np.flatnonzero(near.any(1))
        near = near[np.ix_(some, some)]
        node, copies = node[some], copies[some]
        earlier = [m[m < leaf] for m in pdf["leaves"].to_numpy()[some]]
        flat = np.concatenate(earlier) if len(earlier) else np.zeros(0, int)
        names, code = np.unique(flat, return_inverse=True)
        shared = np.zeros((len(some), len(names)), np.float32)
        shared[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), code] = 1
        counted = near & (shared @ shared.T == 0)
        links = counted @ copies.astype(np.int64) if len(some) else np.zeros(0, np.int64)
        root = np.arange(len(some))
        order = np.argsort(node)
        rank = np.empty(len(some), np.int64)
        rank[order] = np.arange(len(some))
        root = rank.copy()
        while True:                                       # smallest rank that edges lead to
            best = np.minimum(root, np.where(near, root[None, :], len(some)).min(1, initial=len(some)))
            best = np.minimum(best, root[order][best]) if len(some) else best
            if (best == root).all():
                break
            root = best
        return pd.DataFrame({"node": node, "links": links, "root": node[order][root] if len(some) else node})

    return compare


def _of_one_length(nodes: DataFrame, threshold: float, trees: int, leaf: int, block: int, sample: int, spill: float,
                   seed: int) -> DataFrame:
    """(node, links, root) rows of the nodes (node, vec, copies) that link."""
    spark = nodes.sparkSession
    n = nodes.count()
    share = min(1.0, sample / max(n, 1))
    taken = nodes.where(F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toPandas()
    if not len(taken):
        taken = nodes.limit(1).select("vec").toPandas()
    x = unit(np.stack(taken["vec"].to_numpy()).astype(np.float64))          # bounded by ``sample``
    sent = spark.sparkContext.broadcast(fit_forest(x, n / len(x), threshold, trees, leaf, spill, seed))
    placed = stage(nodes.select("node", F.explode(_index_udf(sent)("vec")).alias("leaf")), "leaves")
    settled = _small_leaves(placed, nodes, threshold, leaf, spill, seed)
    leaves = settled.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))          # bounded by trees and spill
    rows = stage(nodes.join(leaves, "node"), "placed").withColumn("leaf", F.explode("leaves"))
    sizes, _ = bounded(stage(rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "leaf-sizes"))
    rows = rows.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    pairs = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "b1", F.least("block", "o")).withColumn("b2", F.greatest("block", "o"))
    return stage(pairs.select("leaf", "b1", "b2", "block", "node", "copies", "vec", "leaves").groupBy("leaf", "b1", "b2")
                 .applyInPandas(_compare(threshold), "node bigint, links bigint, root bigint")
                 .groupBy("node", "root").agg(F.sum("links").alias("links")), "linked")


def vector_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                      trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, spill: float = 0.4,
                      seed: int = 5) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    python_ready(vectors)
    base = stage(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("ok", usable("vec"))
                 .select("id", "ok", F.when(F.col("ok"), F.col("vec")).alias("vec"),
                         F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit("again"), "vec").alias("k2")), "vectors")
    nodes = stage(base.where("ok").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
                                                          F.min("id").alias("first_id"))
                  .withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    lengths = [r[0] for r in nodes.select(F.size("vec")).distinct().orderBy(F.size("vec")).collect()]    # vector lengths
    found = None
    for d in lengths:
        one = _of_one_length(nodes.where(F.size("vec") == d).select("node", "vec", "copies"), threshold, trees, leaf, block,
                             sample, spill, seed)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node bigint, root bigint, links bigint")
    comps = stage(connected_components(found, "node", "root"), "vector-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("k1", "k2", "node", "copies", "first_id").join(comps, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    first = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component-ids")
    known = stage(named.join(first, "component").join(links, "node", "left").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    some = base.where("ok").select("id", "k1", "k2").join(known, ["k1", "k2"]).select("id", "n_links", "component_id")
    none = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "n_links", "component_id",
                                         F.expr("id <=> component_id").alias("kept"))
