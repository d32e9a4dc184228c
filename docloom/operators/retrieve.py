"""Multi-hop retrieval, dedup, late-interaction rerank, source credit (RET-3..8).

Every per-query group here is bounded by k x hops rows, so the windows and
``collect_list`` calls below never gather an unbounded group.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import maxsim, mean_vectors
from docloom.operators.ann import ann_topk
from docloom.operators.coded import CodedIndex
from docloom.operators.knn import knn_topk
from docloom.session import materialize

Rewriter = Callable[[DataFrame, DataFrame, str], DataFrame]


def search(queries: DataFrame, passages: DataFrame, k: int, carry: list[str], index=None, vec: str = "embedding", **kw) -> DataFrame:
    """One search of ``passages`` for (query_id, vec): exact, or in a stored
    ``index`` of them (a ``CellIndex`` or ``CodedIndex``, squared L2) with its
    own settings, e.g. ``nprobe``. Columns in ``carry`` are joined to the hits."""
    if index is None:
        return knn_topk(queries, passages, k=k, q_vec=vec, p_vec=vec, carry=carry, **kw)
    if kw.pop("metric", "l2sq") != "l2sq":
        raise ValueError("an index holds squared L2 distances")
    p_id = kw.pop("p_id", "passage_id")
    if not isinstance(index, CodedIndex):
        return ann_topk(queries, passages, k=k, p_id=p_id, vec=vec, carry=carry, index=index, **kw)
    hits = index.topk(queries, k, q_vec=vec, **kw)
    carried = passages.select(F.col(p_id).alias("passage_id"), *[c for c in carry if c != "passage_id"])
    return hits.join(carried, "passage_id").select("query_id", "passage_id", "score", "rank", *carry)


def rocchio_rewriter(questions: DataFrame, hits: DataFrame, vec: str = "embedding") -> DataFrame:
    """Deterministic stand-in for the LM query rewriter: the next query is
    the mean of the question vector and every passage vector retrieved so
    far (repeats included), summed in (hop, rank) order."""
    got = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("hop", "rank", F.col(vec).alias("v")))).alias("_h"))
    q = questions.select("query_id", F.col(vec).cast("array<double>").alias("_q"))
    return (q.join(got, "query_id", "left")
            .select("query_id", mean_vectors(F.concat(F.array("_q"), F.coalesce(
                F.transform("_h", lambda s: s["v"].cast("array<double>")),
                F.array().cast("array<array<double>>")))).alias(vec)))


def multi_hop_retrieve(questions: DataFrame, passages: DataFrame, max_hops: int = 2, k: int = 20,
                       metric: str = "l2sq", rewriter: Rewriter | None = None, carry: list[str] | None = None,
                       p_id: str = "passage_id", vec: str = "embedding", **knn_kw) -> DataFrame:
    """For hop 1..max_hops: make a query from the question and everything
    retrieved so far, retrieve k, append. Hops depend on each other, so each
    hop's hits are checkpointed (lineage cut, executor-loss safe). ``index``
    and its settings go to :func:`search`.

    ``questions``: (query_id, embedding). Output: (query_id, hop, rank,
    passage_id, score, embedding, *carry)."""
    rewriter = rewriter or rocchio_rewriter
    carry = [c for c in (carry or []) if c != vec]
    q0 = questions.select("query_id", vec)
    cur = q0
    hits = None
    for hop in range(1, max_hops + 1):
        h = search(cur, passages, k, [vec] + carry, vec=vec, metric=metric, p_id=p_id, **knn_kw)
        h = materialize(h.withColumn("hop", F.lit(hop)))
        hits = h if hits is None else hits.unionByName(h)
        if hop < max_hops:
            cur = materialize(rewriter(q0, hits, vec))
    return hits.select("query_id", "hop", "rank", "passage_id", "score", vec, *carry)


#: (questions(query_id, question), hits so far or None, hop) -> (query_id, query)
TextRewriter = Callable[[DataFrame, "DataFrame | None", int], DataFrame]


def multi_hop_search(questions: DataFrame, passages: DataFrame, rewrite: TextRewriter,
                     embed: Callable[[DataFrame], DataFrame], max_hops: int = 2, k: int = 20, metric: str = "l2sq",
                     carry: tuple[str, ...] = ("text", "source"), **knn_kw) -> tuple[DataFrame, DataFrame]:
    """Retrieval whose every hop, the first too, is searched with a text that
    ``rewrite`` makes from the question and all passages found so far.

    ``embed``: (query_id, query) -> (query_id, embedding). Returns the hits
    (query_id, hop, rank, passage_id, score, *carry; repeats included) and the
    last hop's queries (query_id, query). Queries and hits are written after
    every hop, so a model behind ``rewrite`` runs once for each."""
    hits = queries = None
    for hop in range(1, max_hops + 1):
        queries = materialize(rewrite(questions, hits, hop).select("query_id", "query"), "queries")
        found = search(embed(queries), passages, k, list(carry), metric=metric, **knn_kw)
        found = materialize(found.withColumn("hop", F.lit(hop)), "hop")
        hits = found if hits is None else hits.unionByName(found)
    return hits.select("query_id", "hop", "rank", "passage_id", "score", *carry), queries


def dedup_first(hits: DataFrame, key: str = "passage_id") -> DataFrame:
    """Drop repeated passages per query, keeping the first by (hop, rank).

    A min over a struct combines on the map side (a sort aggregate), so even
    a passage repeated across many rows is reduced before the shuffle."""
    others = [c for c in hits.columns if c not in ("query_id", key, "hop", "rank")]
    first = hits.groupBy("query_id", key).agg(F.min(F.struct("hop", "rank", *others)).alias("_f"))
    return first.select("query_id", key, *[F.col(f"_f.{c}").alias(c) for c in ["hop", "rank"] + others])


def context_positions(hits: DataFrame) -> DataFrame:
    """1-based position of each deduplicated passage in (hop, rank) order."""
    w = Window.partitionBy("query_id").orderBy("hop", "rank")
    return hits.withColumn("ctx_pos", F.row_number().over(w))


def rerank(hits: DataFrame, score: Column, k: int = 10, out: str = "rerank_score") -> DataFrame:
    """Keep the best k per query by ``score`` (descending; ties by passage id)."""
    w = Window.partitionBy("query_id").orderBy(F.col(out).desc(), F.col("passage_id"))
    return (hits.withColumn(out, score).withColumn("rerank_pos", F.row_number().over(w))
            .where(F.col("rerank_pos") <= k))


def rerank_maxsim(hits: DataFrame, q_tokens: str = "q_toks", p_tokens: str = "p_toks", k: int = 10) -> DataFrame:
    """ColBERT-style MaxSim over token-vector matrices carried on the hits."""
    return rerank(hits, F.round(maxsim(q_tokens, p_tokens), 6), k)


def overlap_maxsim(q_buckets: Column, p_buckets: Column) -> Column:
    """MaxSim when every token vector is the one-hot of its hash bucket:
    the number of query tokens whose bucket occurs in the passage."""
    pairs = F.arrays_zip(q_buckets.alias("b"), F.array_repeat(p_buckets, F.size(q_buckets)).alias("p"))
    return F.size(F.filter(pairs, lambda z: F.array_contains(z["p"], z["b"]))).cast("double")


def attach_source(reranked: DataFrame, deduped: DataFrame, mode: str = "by_id", source_col: str = "source") -> DataFrame:
    """Give each reranked passage a source.

    ``by_id`` (default): the passage's own source.
    ``positional`` (parity): the i-th reranked passage gets the source of the
    i-th passage of the deduplicated, un-reranked list (mis-credits after a
    reorder, as the original zip does)."""
    if mode == "by_id":
        if source_col in reranked.columns:
            return reranked
        return reranked.join(deduped.select("query_id", "passage_id", source_col), ["query_id", "passage_id"], "left")
    if mode == "positional":
        pos = context_positions(deduped).select("query_id", F.col("ctx_pos").alias("rerank_pos"),
                                                F.col(source_col).alias("_src"))
        base = reranked.drop(source_col) if source_col in reranked.columns else reranked
        return base.join(pos, ["query_id", "rerank_pos"], "inner").withColumnRenamed("_src", source_col)
    raise ValueError(f"unknown mode {mode!r}")


def assemble_context(hits: DataFrame, text_col: str = "text", order: tuple[str, ...] = ("hop", "rank"),
                     out: str = "contexts") -> DataFrame:
    """Ordered list of passage texts per query (bounded: k x hops)."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(text_col).alias("_t"))))
    return hits.groupBy("query_id").agg(F.transform(parts, lambda s: s["_t"]).alias(out))
