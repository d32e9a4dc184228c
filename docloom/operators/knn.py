"""Exact k-nearest-neighbour search (RET-1) without materialising pairs.

Distances are computed in numpy tiles, in single precision with a bound on the
rounding; pairs within that bound of the k-th score so far are scored in double
precision. Of equal passages only the k least ids are compared, and only the
best k per query leave each task; the final cut is a ``row_number() <= k`` window, which Spark
plans as a partial ``WindowGroupLimit`` before the shuffle, so at most k
rows per query and map partition are shuffled.

Two physical paths, chosen by a size check of the query side:

* broadcast: the query matrix (checked against ``broadcast_bytes``) is
  broadcast; every passage partition keeps a running top-k per query.
  The passage table is never shuffled, which is what repeated searches of
  a large collection need.
* blocks: beyond the limit, and where the best k of every scanned split
  would be many rows, passages are written once and queries are hashed into
  blocks; a task holds a block of queries and streams all passages past it, so
  nothing is replicated and k rows per query are all that leaves it. The
  stage folder has to be reachable by pyarrow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize, ship_package, small_batches, stage_path
from docloom.sources.committed import filesystem

DEFAULT_BROADCAST_BYTES = 256 << 20
DEFAULT_BLOCK_BYTES = 64 << 20
BROADCAST_HITS = 1 << 18                    # hits that a scan task may give at most; more go by blocks
QUERY_BLOCKS, LEAST_QUERIES = 64, 2_048     # smaller query sides: as many blocks as this, if they are not tiny
SCORE_DECIMALS = 9
METRICS = ("l2sq", "cosine", "ip")


def _matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series])


def _first_copies(P: np.ndarray, code: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order, that can be among anyone's best k: of equal vectors the
    rows of the k least ids (``code``: the ids' places in order)."""
    if len(P) <= k or not P.shape[1]:
        return np.arange(len(P))
    _, vector, copies = np.unique(np.ascontiguousarray(P).view(f"V{P.shape[1] * P.itemsize}").ravel(), return_inverse=True, return_counts=True)
    if copies.max() <= k:
        return np.arange(len(P))
    order = np.lexsort((code, vector))
    v, c = vector[order], code[order]
    starts = np.append(True, v[1:] != v[:-1])
    nr = np.cumsum(starts | np.append(True, c[1:] != c[:-1]))           # distinct (vector, id) so far
    return np.sort(order[nr - nr[np.maximum.accumulate(np.where(starts, np.arange(len(v)), 0))] < k])


def _codes(ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lists of ids as places in their common order, nulls first."""
    code, _ = pd.factorize(np.concatenate([ids, other]), sort=True)
    return code[:len(ids)], code[len(ids):]


class _Near:
    """Distances as one matrix product, less what is the same for all passages
    of a query, and how far rounding may put them off; scores of pairs."""

    def __init__(self, Q: np.ndarray, P: np.ndarray, metric: str, kind: type):
        self.Q, self.P, self.metric, self.kind = Q, P, metric, kind
        qq, pp = (Q * Q).sum(1), (P * P).sum(1)
        self.qn, self.pn = np.sqrt(qq), np.sqrt(pp)
        with np.errstate(all="ignore"):
            if metric == "l2sq":
                left, right, self.shift = np.column_stack([-2.0 * Q, np.ones(len(Q))]), np.column_stack([P, pp]), -qq
                size = qq + pp[np.isfinite(pp)].max(initial=0.0)
            elif metric == "ip":
                left, right, self.shift = -Q, P, np.zeros(len(Q))
                size = qq + pp[np.isfinite(pp)].max(initial=0.0)
            elif metric == "cosine":
                left, right, self.shift = -Q / self.qn[:, None], P / self.pn[:, None], np.full(len(Q), -1.0)
                size = np.full(len(Q), 2.0)
            else:
                raise ValueError(f"unknown metric {metric!r}")
            self.left, self.right = left.astype(kind), right.astype(kind)
        self.slack = (2 * (Q.shape[1] + 8) if kind is np.float32 else 16 * (Q.shape[1] + 1)) * np.finfo(kind).eps * size

    def tile(self, ps: int, pe: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.left @ self.right[ps:pe].T

    def scores(self, qi: np.ndarray, pi: np.ndarray) -> np.ndarray:
        """Scores of pairs, squared distances from plain differences (the
        expanded square loses digits where vectors are long and close); a zero
        vector has no cosine and is no one's neighbour."""
        out = np.empty(len(qi))
        with np.errstate(all="ignore"):
            for i in range(0, len(qi), PAIRS):
                a, b = qi[i:i + PAIRS], pi[i:i + PAIRS]
                if self.metric == "l2sq":
                    d = self.Q[a] - self.P[b]
                    out[i:i + PAIRS] = np.einsum("ij,ij->i", d, d)
                    continue
                d = np.einsum("ij,ij->i", self.Q[a], self.P[b])
                out[i:i + PAIRS] = -d if self.metric == "ip" else 1.0 - d / (self.qn[a] * self.pn[b])
        return np.round(out, SCORE_DECIMALS)


def _best(Q, P, q_code, p_code, k: int, metric: str, exclude_self: bool, p_step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, passage, score) of the best k passages of every row of Q, ties
    by id: strips of passages are held against the k-th score so far, and only
    pairs that may be better are scored."""
    kind = np.float32 if max(np.abs(Q).max(initial=0.0), np.abs(P).max(initial=0.0)) < 1e15 else np.float64
    near, unit = _Near(Q, P, metric, kind), 10.0 ** -SCORE_DECIMALS
    bound = np.full(len(Q), np.inf)
    qi, pi, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for ps in range(0, len(P), p_step):
        while True:
            D = near.tile(ps, ps + p_step)
            limit = bound + near.shift + 2 * near.slack + unit
            if not np.isfinite(bound).all() and D.shape[1] > k:
                first = np.where(q_code[:, None] == p_code[None, ps:ps + p_step], np.inf, D) if exclude_self else D
                limit = np.fmin(limit, np.partition(first, k - 1, axis=1)[:, k - 1] + 2 * near.slack + unit)
            over = np.isfinite(D) & ~(D > limit[:, None].astype(D.dtype)) if not np.isfinite(limit).all() else D <= np.nextafter(
                limit.astype(D.dtype), np.asarray(np.inf, D.dtype))[:, None]
            hit = np.flatnonzero(over.ravel())
            if near.kind is np.float64 or len(hit) <= 16 * k * len(Q):
                break
            near = _Near(Q, P, metric, np.float64)                     # vectors too long, or too close, for single precision
        a, b = hit // D.shape[1], hit % D.shape[1] + ps
        if exclude_self:
            other = q_code[a] != p_code[b]
            a, b = a[other], b[other]
        if not len(a):
            continue
        t = near.scores(a, b)
        may = np.isfinite(t) & (t <= bound[a])
        qi, pi, s = np.concatenate([qi, a[may]]), np.concatenate([pi, b[may]]), np.concatenate([s, t[may]])
        order = np.lexsort((p_code[pi], s, qi))
        qi, pi, s = qi[order], pi[order], s[order]
        starts = np.searchsorted(qi, np.arange(len(Q)))
        keep = np.arange(len(qi)) - starts[qi] < k
        last = starts + k - 1
        full = (last < len(qi)) & (qi[np.minimum(last, len(qi) - 1)] == np.arange(len(Q))) if len(qi) else np.zeros(len(Q), bool)
        bound[full] = s[last[full]]
        qi, pi, s = qi[keep], pi[keep], s[keep]
    return qi, pi, s


TILE = 1 << 24   # distances per numpy tile at most
STRIP, QUERIES = 4_096, 1_024               # passages and queries of a tile, as far as ``tile`` allows
PAIRS = 1 << 16                             # pairs scored at once


def _tiled_topk(qids, Q, pdf: pd.DataFrame, pid: str, pvec: str, carry: list[str], k: int, metric: str,
                exclude_self: bool, tile: int = TILE) -> pd.DataFrame:
    """Best k passages of ``pdf`` for every query row of Q, ties by id."""
    qids, pids, P = np.asarray(qids), pdf[pid].to_numpy(), _matrix(pdf[pvec])
    q_code, p_code = _codes(qids, pids)
    if qids.dtype.kind == "f":
        q_code = np.where(q_code < 0, -2, q_code)                      # a missing number is not itself
    rows = _first_copies(P, p_code, k + exclude_self)
    P, p_code = P[rows], p_code[rows]
    p_step = max(1, min(len(rows), tile, max(STRIP, 8 * k)))
    q_step = max(1, min(tile // p_step, QUERIES))
    found = [(q + qs, p, s) for qs in range(0, len(Q), q_step) for q, p, s in [
        _best(Q[qs:qs + q_step], P, q_code[qs:qs + q_step], p_code, k, metric, exclude_self, p_step)]]
    qi, pi, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    at = rows[pi]
    out = pd.DataFrame({"query_id": qids[qi], "passage_id": pids[at], "score": s})
    for c in carry:
        out[c] = pdf[c].to_numpy()[at]
    return out


def _block_topk(qids, Q, pdf: pd.DataFrame, pid: str, pvec: str, carry: list[str], k: int, metric: str,
                exclude_self: bool) -> pd.DataFrame:
    """:func:`_tiled_topk` with all distances in one tile."""
    return _tiled_topk(qids, Q, pdf, pid, pvec, carry, k, metric, exclude_self, tile=max(1, len(pdf) * len(qids)))


def _merge_topk(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    df = pd.concat(frames, ignore_index=True)
    return df.sort_values(["query_id", "score", "passage_id"], kind="stable").groupby("query_id", sort=False, dropna=False).head(k)


SCAN_BYTES = 32 << 20                       # passage vectors of a scan that are compared and merged at once


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, joined to frames of at least ``rows`` rows (the last one: what is left)."""
    held, n = [], 0
    for pdf in batches:
        if len(pdf):
            held, n = [*held, pdf], n + len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _nothing(schema: T.StructType) -> pd.DataFrame:
    """No rows, of columns that Arrow takes for any type (an empty list makes
    numbers, and numbers cast to strings come in no chunk at all)."""
    return pd.DataFrame({f: pd.Series([], dtype=object) for f in schema.fieldNames()})


def _stored_tables(fs, files: list[str], columns: list[str], rows: int) -> Iterator[pa.Table]:
    """The rows of Parquet files, in tables of ``rows`` rows (the last one: what is left)."""
    held, n = [], 0
    for name in files:
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(min(rows, 8_192), columns=columns, use_threads=False):
                held, n = [*held, batch], n + batch.num_rows
                while n >= rows:
                    table = pa.Table.from_batches(held)
                    yield table.slice(0, rows)
                    held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def _part_files(path: str) -> tuple:
    """(file system, Parquet files in order) of a stage table."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    return fs, sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".parquet"))


def _out_schema(queries: DataFrame, passages: DataFrame, q_id: str, p_id: str, carry: list[str]) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema[q_id].dataType),
              T.StructField("passage_id", passages.schema[p_id].dataType),
              T.StructField("score", T.DoubleType())]
    fields += [T.StructField(c, passages.schema[c].dataType) for c in carry]
    return T.StructType(fields)


def knn_topk(queries: DataFrame, passages: DataFrame, k: int = 20, metric: str = "l2sq",
             q_id: str = "query_id", q_vec: str = "embedding", p_id: str = "passage_id",
             p_vec: str = "embedding", carry: list[str] | None = None, exclude_self: bool = False,
             broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, block_bytes: int = DEFAULT_BLOCK_BYTES,
             force_path: str | None = None) -> DataFrame:
    """k nearest passages per query, distance ascending, ties by passage id.

    Returns ``(query_id, passage_id, score, rank, *carry)``; ``score`` is the
    distance rounded to 9 decimals (l2sq: squared L2, cosine: 1 - cos,
    ip: minus the inner product; a zero vector has no cosine and is never a
    hit). Only ids and scores go through the top-k; passage columns named in
    ``carry`` (text, source, token ids, the vector itself) are joined to the
    final k hits.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    carry = list(carry or [])
    spark = queries.sparkSession
    q = queries.select(q_id, q_vec).where(F.col(q_vec).isNotNull())
    wanted, carry = carry, []
    p = passages.select(p_id, p_vec).where(F.col(p_vec).isNotNull())
    schema = _out_schema(queries, passages, q_id, p_id, carry)
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(q_vec)).alias("d")).first()
    n_q, dim = int(stats["n"]), int(stats["d"] or 0)
    q_bytes = n_q * max(dim, 1) * 8
    path = force_path or ("broadcast" if q_bytes <= broadcast_bytes and n_q * k <= BROADCAST_HITS else "blocks")

    if n_q == 0:
        hits = spark.createDataFrame([], schema)
    elif path == "broadcast":
        qpdf = q.toPandas()  # bounded by the size check above
        bc = spark.sparkContext.broadcast((qpdf[q_id].to_numpy(), _matrix(qpdf[q_vec])))

        def scan(batches):
            qids, Q = bc.value
            best = None
            for pdf in _gathered(batches, max(1, SCAN_BYTES // (8 * max(dim, 1)))):
                top = _tiled_topk(qids, Q, pdf, p_id, p_vec, carry, k, metric, exclude_self)
                best = top if best is None else _merge_topk([best, top], k)
            if best is not None and len(best):
                yield best[schema.fieldNames()]

        hits = p.mapInPandas(scan, schema)
    else:
        qb = max(1, math.ceil(q_bytes / block_bytes), min(QUERY_BLOCKS, n_q // LEAST_QUERIES))
        ship_package(spark)
        small_batches(spark)
        stored = stage_path(materialize(p, "knn-passages"))
        dealt = q.repartitionById(qb, F.pmod(F.xxhash64(q_id), F.lit(qb)).cast("int"))

        def stream(batches):
            queries = list(_gathered(batches, n_q + 1))
            if not queries:
                return
            qids, Q, best = queries[0][q_id].to_numpy(), _matrix(queries[0][q_vec]), None
            for table in _stored_tables(*_part_files(stored), [p_id, p_vec], max(1, SCAN_BYTES // (8 * max(dim, 1)))):
                top = _tiled_topk(qids, Q, table.to_pandas(), p_id, p_vec, carry, k, metric, exclude_self)
                best = top if best is None else _merge_topk([best, top], k)
            if best is not None and len(best):
                yield best[schema.fieldNames()]

        hits = dealt.mapInPandas(stream, schema)

    w = Window.partitionBy("query_id").orderBy("score", "passage_id")
    top = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "passage_id", "score", "rank")
    if wanted:
        top = top.join(passages.select(F.col(p_id).alias("passage_id"), *[c for c in wanted if c != "passage_id"]), "passage_id")
    return top.select("query_id", "passage_id", "score", "rank", *wanted)
