"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run as run_pipeline
from docloom.llm.common import table
from docloom.llm.decontaminate import contamination
from docloom.llm.divergence import divergence
from docloom.llm.html import main_text
from docloom.llm.langid import identify
from docloom.llm.licenses import license_scan
from docloom.llm.mixing import mix
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.oracles import ORACLES
from docloom.llm.secrets import secrets
from docloom.llm.sharding import shard_report
from docloom.llm.substring_dedup import report
from docloom.llm.toxicity import score_documents
from docloom.llm.vector_codes import compress
from docloom.llm.vector_dedup import vector_duplicates

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = dict(ORACLES)


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op2_secret_scan(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))


@query
def op3_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


@query
def op7_embedding_near_dedup(spark, sf_dir):
    return vector_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_substring_dedup(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark, sf_dir):
    pages = main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op10_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


@query
def op12_sharding(spark, sf_dir):
    return shard_report(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


LLM_QUERIES["pipeline"] = run_pipeline
if ORACLE_SQL is not None:
    LLM_ORACLES["pipeline"] = ORACLE_SQL
