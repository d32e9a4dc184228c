"""The training-data pipeline: documents in, a mix of clean documents out.

Each stage works on all that the one before kept and is written as a table
that the next one reads. ``run`` applies all stages to ``documents``.

Cases: every stage keeps null and empty texts (they hold nothing to reject;
null and wordless texts are no duplicates), documents of a null id or source,
and works on empty tables; of rows that are equal in id and text near
duplicates leave one; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import stage, table
from docloom.llm.decontaminate import without_contaminated
from docloom.llm.mixing import mix
from docloom.llm.near_dedup import without_near_duplicates
from docloom.llm.secrets import redact
from docloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the smallest id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, its length is counted anew."""
    return redact(docs, length_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with at least one copy, with the words that it takes of them."""
    return mix(docs, keep=("source",)).where("copies > 0").select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("source_mixing", source_mixing)]

#: Fitting a classifier and probabilistic signatures can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


