"""Registered queries: one per operator of the inventory, each reading the
whole driver tables (or data Spark derives from them).

Array-valued results are flattened into scalar rows (``posexplode``) or
joined strings so the oracle comparison is type-stable.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as TX
from docloom.operators import clean as CL
from docloom.operators.chunk import chunk_documents, with_chunk_id
from docloom.operators.embed import cls_pool, query_prefix, with_hash_embedding
from docloom.operators.knn import knn_topk
from docloom.plans.ingest import build_passages
from docloom.plans.rag import rag_retrieve
from docloom.session import materialize, read_table
from docloom.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EXTRA_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            EXTRA_ORACLES[name] = sql
        return fn
    return deco


def _clean_docs(spark, sf) -> DataFrame:
    return CL.clean_text(read_table(spark, sf, "documents", ["doc_id", "source", "text"]))


def _explode_vec(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    # outer form: a plain explode makes Catalyst re-inline the vector expression in an inferred filter
    return df.select(id_col, F.posexplode_outer(vec).alias("idx", "_v")).where(F.col("idx").isNotNull()).select(
        id_col, F.col("idx").cast("int").alias("idx"), F.round(F.col("_v").cast("double"), 6).alias("value"))


# ---------------------------------------------------------------- 2.2 documents
@register("doc_id")
def q_doc_id(spark, sf):
    return CL.with_doc_id(FX.corpus(spark, sf)).select("file", "doc_id")


@register("source_label")
def q_source_label(spark, sf):
    c = FX.corpus(spark, sf)
    return c.select("file", TX.source_label("file", "suffix").alias("source_suffix"),
                    TX.source_label("file", "charset").alias("source_charset"))


@register("file_stem")
def q_file_stem(spark, sf):
    return CL.with_file_stem(FX.corpus(spark, sf)).select("file", "stem")


@register("assemble_elements")
def q_assemble_elements(spark, sf):
    return CL.assemble_elements(FX.elements(spark, sf), "doc", "pos", "text")


@register("clean_whitespace")
def q_clean_whitespace(spark, sf):
    return _clean_docs(spark, sf).select("doc_id", "text")


@register("text_after_marker")
def q_text_after_marker(spark, sf):
    d = _clean_docs(spark, sf)
    return CL.text_after_marker(d, "text", r"(?i)les?\s?:").select("doc_id", "text", "matched")


@register("copy_metadata")
def q_copy_metadata(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "source"])
    return CL.copy_metadata(d, "source", "filename")


# ---------------------------------------------------------------- 2.3 chunking
@register("chunk_by_token_budget")
def q_chunk(spark, sf):
    ch = chunk_documents(_clean_docs(spark, sf).select("doc_id", "text"))
    return ch.where(F.col("pos").isNotNull()).select("doc_id", "pos", "text")


@register("chunk_id")
def q_chunk_id(spark, sf):
    ch = chunk_documents(_clean_docs(spark, sf).select("doc_id", "text"))
    return with_chunk_id(ch.where(F.col("pos").isNotNull())).select("doc_id", "pos", "chunk_id")


@register("chunk_metadata")
def q_chunk_metadata(spark, sf):
    ch = chunk_documents(_clean_docs(spark, sf))
    return (ch.where(F.col("pos").isNotNull()).groupBy("source")
            .agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs")))


# ---------------------------------------------------------------- 2.4 embedding
@register("embed_texts")
def q_embed(spark, sf):
    d = _clean_docs(spark, sf)
    return _explode_vec(with_hash_embedding(d.select("doc_id", "text")), "doc_id", "embedding")


@register("cls_pool")
def q_cls_pool(spark, sf):
    t = FX.token_matrices(spark, sf)
    return _explode_vec(t.select("id", cls_pool("toks").alias("v")), "id", "v")


@register("query_prefix")
def q_query_prefix(spark, sf):
    q = FX.questions(spark, sf)
    return q.select("query_id", query_prefix("question").alias("query"))


# ---------------------------------------------------------------- 2.5 retrieval
@register("knn_topk")
def q_knn(spark, sf):
    v = FX.vectors(spark, sf)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    return knn_topk(q, v, k=20, metric="l2sq").select("query_id", "passage_id", "rank", "score")


def _passages(spark, sf) -> DataFrame:
    return materialize(build_passages(FX.corpus(spark, sf)))


@register("rag_retrieve")
def q_rag(spark, sf):
    return rag_retrieve(FX.questions(spark, sf), _passages(spark, sf), k=20, hops=2, rerank_k=10)


# the other query groups register themselves on import
from docloom.plans import q_retrieval, q_generation, q_chat_sft, q_eval, q_stream, q_answers, q_index  # noqa: E402,F401
