"""Fixture shapes derived from the driver tables with Spark (see FIXTURES.md).

Each function reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.vectors import cut_tokens
from docloom.session import read_table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) with file = 'pdf-<source>-<doc_id>.pdf'."""
    return corpus_of(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def corpus_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.lit("pdf-"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"),
                       "text")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, pos, text) from conversation turns."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return c.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("pos"), "text")


def vectors(spark: SparkSession, sf_dir: str, id_name: str = "passage_id") -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(F.col("vec_id").alias(id_name), "embedding", "label")


def token_matrices(spark: SparkSession, sf_dir: str, n_tokens: int = 4) -> DataFrame:
    """(id, toks ARRAY<ARRAY<FLOAT>>): each embedding cut into n_tokens rows."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("id"), cut_tokens("embedding", n_tokens).alias("toks"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, sender, message, type): user->you, assistant->bot,
    other roles kept as they are (and rejected by validation)."""
    c = read_table(spark, sf_dir, "conversations")
    sender = (F.when(F.col("role") == "user", "you").when(F.col("role") == "assistant", "bot")
              .otherwise(F.col("role")))
    return c.select("conv_id", "turn", sender.alias("sender"), F.col("text").alias("message"),
                    F.lit("stream").alias("type"))


def instruction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, instruction, input, output): a user turn, the system turn
    right before it (else ''), and the assistant turn right after it.
    Equi-joins on (conv_id, turn) keep a long conversation spread over tasks."""
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("output"))
    s = c.where(F.col("role") == "system").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                  F.col("text").alias("input"))
    j = u.join(a, ["conv_id", "turn"], "inner").join(s, ["conv_id", "turn"], "left")
    return j.select(F.concat_ws(":", "conv_id", "turn").alias("sample_id"), "instruction",
                    F.coalesce("input", F.lit("")).alias("input"), "output")
