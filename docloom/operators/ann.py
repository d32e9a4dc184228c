"""Approximate kNN (RET-2): inverted-file cells.

Cells are k-means centroids (``pyspark.ml`` KMeans). Each query probes its
``nprobe`` nearest cells; a cell's passages are scored against the queries
that probe it in numpy, and only the top k per query leave the task. A cell
larger than ``block_rows`` is split into hashed sub-blocks, the queries that
probe it into blocks of ``QUERY_BLOCK``, and a task compares one of each, so a
cell holding a third of the corpus is still many bounded tasks. Recall is measured against the exact
:func:`knn_topk`."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.knn import TILE, _matrix, _nothing, _tiled_topk
from docloom.session import materialize, scratch

MAX_CENTROID_BYTES = 64 << 20
QUERY_BLOCK = 4_096          # queries of one cell scored by one task


def cell_count(n_passages: int, dim: int) -> int:
    """About the square root of the passages, as far as the centroid table
    stays within ``MAX_CENTROID_BYTES``; decided before any fit."""
    return max(1, min(int(math.sqrt(n_passages)), MAX_CENTROID_BYTES // (8 * max(dim, 1))))


def fit_cells(passages: DataFrame, cells: int, vec: str = "embedding", seed: int = 7, max_iter: int = 10):
    """k-means centroids of all passages as a numpy matrix (cells x dim)."""
    data = passages.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="features").fit(data)
    return np.vstack(model.clusterCenters())


@dataclass
class CellIndex:
    """A fitted index: centroids and the passages with their cell, a table in
    the checkpoint folder partitioned by cell, so a search reads the probed
    cells alone. Fit once, search as often as wanted."""

    centroids: np.ndarray
    passages: DataFrame
    id_col: str
    vec: str


def build_index(passages: DataFrame, cells: int | None = None, p_id: str = "passage_id", vec: str = "embedding",
                seed: int = 7) -> CellIndex:
    """Index of every passage with a vector (ids and vectors only)."""
    spark = passages.sparkSession
    p = passages.select(F.col(p_id).alias("passage_id"), vec).where(F.col(vec).isNotNull())
    size = p.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    cent = fit_cells(p, cells or cell_count(size["n"], size["d"] or 1), vec, seed)
    path = scratch(spark, "cells")
    placed = p.withColumn("cell", F.element_at(_nearest_cells(spark, cent, 1)(F.col(vec)), 1))
    # a file or a few for each cell: a cell's rows meet in four tasks at most, which stream them to disk
    placed.repartition("cell", F.pmod(F.xxhash64("passage_id"), F.lit(4))).write.partitionBy("cell").parquet(path)
    return CellIndex(cent, spark.read.parquet(path), p_id, vec)


def _nearest_cells(spark, cent: np.ndarray, nprobe: int):
    bc = spark.sparkContext.broadcast(cent)

    @F.pandas_udf("array<int>")
    def cells(vs: pd.Series) -> pd.Series:
        c = bc.value
        if len(vs) == 0:
            return pd.Series([], dtype=object)
        Q = _matrix(vs)
        k = min(nprobe, c.shape[0])
        cc = (c * c).sum(1)[None, :]
        step = max(1, TILE // c.shape[0])          # bound the query x centroid tile
        out = []
        for s0 in range(0, Q.shape[0], step):
            q = Q[s0:s0 + step]
            d = (q * q).sum(1)[:, None] + cc - 2.0 * q @ c.T
            idx = np.argsort(d, axis=1, kind="stable")[:, :k]
            out += [list(map(int, r)) for r in idx]
        return pd.Series(out)

    return cells


def ann_topk(queries: DataFrame, passages: DataFrame, k: int = 20, cells: int | None = None, nprobe: int = 4,
             q_id: str = "query_id", p_id: str = "passage_id", vec: str = "embedding", block_rows: int = 50_000,
             carry: list[str] | None = None, seed: int = 7, index: CellIndex | None = None,
             exclude_self: bool = False) -> DataFrame:
    """Approximate k nearest passages (squared L2), same output as knn_topk.

    ``index``: one from :func:`build_index`, else it is built here. Where the
    probed cells hold fewer than k passages the query gets those alone; with
    ``nprobe`` at the number of cells the answer is exact. Columns in
    ``carry`` are joined to the final hits."""
    spark = queries.sparkSession
    carry = list(carry or [])
    index = index or build_index(passages, cells, p_id, vec, seed)
    cent, pc = index.centroids, index.passages
    sizes = pc.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    nsub = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("m") / block_rows)).cast("int").alias("nsub"))
    nsub = F.broadcast(nsub)            # one row per cell: bounded by ``cells``
    pc = pc.join(nsub, "cell").withColumn("sub", F.pmod(F.xxhash64("passage_id"), F.col("nsub")).cast("int"))
    q = queries.select(F.col(q_id).alias("query_id"), F.col(vec).alias("_qv")).where(F.col("_qv").isNotNull())
    qc = materialize(q.withColumn("cell", F.explode(_nearest_cells(spark, cent, nprobe)(F.col("_qv")))), "probes")
    # queries of one cell in blocks too: a task holds one block of queries and one of passages
    nq = F.broadcast(qc.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("nq")))
    qc = (qc.join(nq, "cell").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).join(nsub, "cell")
          .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("nsub") - 1))))
    pc = pc.join(nq, "cell").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    fields = [T.StructField("query_id", queries.schema[q_id].dataType),
              T.StructField("passage_id", passages.schema[p_id].dataType),
              T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    vec = index.vec

    def score(qpdf: pd.DataFrame, ppdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ppdf) == 0:
            return _nothing(schema)
        top = _tiled_topk(qpdf["query_id"].to_numpy(), _matrix(qpdf["_qv"]), ppdf, "passage_id", vec, [], k, "l2sq", exclude_self)
        return top[[f.name for f in fields]]

    hits = (qc.select("cell", "sub", "qb", "query_id", "_qv").groupBy("cell", "sub", "qb")
            .cogroup(pc.select("cell", "sub", "qb", "passage_id", vec).groupBy("cell", "sub", "qb"))
            .applyInPandas(score, schema))
    w = Window.partitionBy("query_id").orderBy("score", "passage_id")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "passage_id", "score", "rank")
    if carry:
        top = top.join(passages.select(F.col(p_id).alias("passage_id"), *carry), "passage_id")
    return top.select("query_id", "passage_id", "score", "rank", *carry)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k found by the approximate search, per query."""
    hit = exact.join(approx.select("query_id", "passage_id", F.lit(1).alias("_f")), ["query_id", "passage_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("_f", F.lit(0))).alias("recall"))
