"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import BATCH_BYTES, BATCH_ROWS, materialize, ship_package, small_batches

#: Most rows that an operator broadcasts; beyond, it joins by shuffling.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and reread:
    cuts the lineage, survives lost executors, and lets Spark split a skewed
    join against an aggregated side."""
    return materialize(df, name)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted),
    else as it is; and whether it is broadcast."""
    small = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if small else df), small


def row_key(*cols: str) -> Column:
    """128 bits that name a row by its values: equal rows share it. Null and
    empty differ."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string"), F.lit("\x1f")))
             for c in cols]
    return F.md5(F.concat(*parts))


def python_ready(df: DataFrame) -> DataFrame:
    """Call before a plan with Python functions: workers can import the
    package, and Arrow batches are small from now on (:func:`small_batches`)."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df


__all__ = ["BROADCAST_ROWS", "bounded", "materialize", "python_ready", "row_key", "stage", "table"]
