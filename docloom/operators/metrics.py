"""Retrieval and answer metrics (MET-1..4), definitions after the RAGAS paper.

Every metric is a per-query (or per-answer) aggregate; groups are bounded by
the retrieved k or the statements of one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import dot, norm


def context_precision(hits: DataFrame, k: int | None = None) -> DataFrame:
    """hits(query_id, rank, relevant 0/1) -> (query_id, context_precision) =
    sum_k precision@k * rel_k / sum_k rel_k (0 when nothing is relevant)."""
    h = hits if k is None else hits.where(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_prec", F.sum("relevant").over(w) / F.col("rank"))
    agg = h.groupBy("query_id").agg(F.sum(F.col("_prec") * F.col("relevant")).alias("_num"),
                                    F.sum("relevant").alias("_den"))
    return agg.select("query_id", F.round(F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0), 9)
                      .alias("context_precision"))


def context_recall(statements: DataFrame, key: str = "query_id") -> DataFrame:
    """statements(key, supported bool) -> share of supported statements."""
    return statements.groupBy(key).agg(F.round(F.avg(F.col("supported").cast("double")), 9).alias("context_recall"))


def answer_relevancy(pairs: DataFrame, key: str = "query_id", q_vec: str = "q_vec", g_vec: str = "g_vec") -> DataFrame:
    """pairs(key, q_vec, g_vec) -> mean cosine of the question vector and the
    vectors of questions generated back from the answer."""
    cos = dot(q_vec, g_vec) / (norm(q_vec) * norm(g_vec))
    return pairs.groupBy(key).agg(F.round(F.avg(cos), 9).alias("answer_relevancy"))


def faithfulness(verdicts: DataFrame, key: str = "answer_id") -> DataFrame:
    """verdicts(key, supported bool) -> supported / all statements of an answer."""
    return verdicts.groupBy(key).agg(F.round(F.avg(F.col("supported").cast("double")), 9).alias("faithfulness"))
