"""Document preparation: ids, labels, element assembly, cleaning (DOC-1..7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ids import md5_id


def with_doc_id(df: DataFrame, file_col: str = "file", out: str = "doc_id") -> DataFrame:
    """Document id = MD5 hex of the file name (not of the content)."""
    return df.withColumn(out, md5_id(file_col))


def with_source_label(df: DataFrame, file_col: str = "file", out: str = "source", mode: str = "suffix") -> DataFrame:
    return df.withColumn(out, T.source_label(file_col, mode))


def with_file_stem(df: DataFrame, file_col: str = "file", out: str = "stem") -> DataFrame:
    return df.withColumn(out, T.file_stem(file_col))


def assemble_elements(df: DataFrame, key: str = "doc", order: str = "pos", text: str = "text",
                      sep: str = "\n") -> DataFrame:
    """Join a document's extracted elements in order with newlines.

    One output value per document, so the group is bounded by the output
    itself; the sort is on (order) inside that group only.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias(text))


def clean_text(df: DataFrame, text_col: str = "text", out: str | None = None) -> DataFrame:
    return df.withColumn(out or text_col, T.clean_whitespace(text_col))


def copy_metadata(df: DataFrame, src: str = "source", dst: str = "filename") -> DataFrame:
    return df.withColumn(dst, F.col(src))


def text_after_marker(df: DataFrame, text_col: str = "text", pattern: str = T.DEFAULT_MARKER,
                      matched_col: str = "matched") -> DataFrame:
    """Keep the text after the first marker match; rows without a match keep
    their text and get ``matched = false`` (the report of uncleaned files)."""
    after, matched = T.text_after_marker(text_col, pattern)
    return df.withColumn(matched_col, matched).withColumn(text_col, after)


def prepare_corpus(corpus: DataFrame, file_col: str = "file", text_col: str = "text",
                   label_mode: str = "suffix") -> DataFrame:
    """(file, text) -> (doc_id, file, source, stem, text) with cleaned text."""
    return (corpus
            .withColumn("doc_id", md5_id(file_col))
            .withColumn("source", T.source_label(file_col, label_mode))
            .withColumn("stem", T.file_stem(file_col))
            .withColumn(text_col, T.clean_whitespace(text_col))
            .select("doc_id", file_col, "source", "stem", text_col))
