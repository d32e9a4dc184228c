"""Batch ingestion: corpus -> clean -> chunk -> embed -> collection (entry point 1).

One lazy plan up to the document-level staging frame, which is
checkpointed once so the chunk rows, the failure list and the report are
all read from it instead of recomputing the corpus scan and packing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import collection as coll
from docloom.operators.chunk import explode_chunks, split_failures, stage_chunks, with_chunk_id
from docloom.operators.clean import prepare_corpus
from docloom.operators.embed import embed_texts
from docloom.session import materialize


@dataclass
class IngestResult:
    inserted: int
    report: DataFrame
    failed: DataFrame


def chunk_corpus(corpus: DataFrame, budget: int = 510, cost=None, label_mode: str = "suffix") -> DataFrame:
    """(file, text) -> document-level staging frame (doc_id, file, source, stem, fail_reason, _chunks)."""
    return stage_chunks(prepare_corpus(corpus, label_mode=label_mode), "text", budget, cost)


def unique_chunks(staged: DataFrame) -> DataFrame:
    """Unique chunks: the least (doc_id, pos) per chunk id."""
    ok, _ = split_failures(explode_chunks(staged))
    return coll.first_per_chunk(with_chunk_id(ok.select("doc_id", "source", "pos", "text")))


def passages_from_staged(staged: DataFrame, dim: int = 64, embedder=None) -> DataFrame:
    """Unique chunks (least (doc_id, pos) per chunk id) with embeddings."""
    return embed_texts(unique_chunks(staged), "text", "embedding", dim, embedder)


def build_passages(corpus: DataFrame, budget: int = 510, dim: int = 64, label_mode: str = "suffix",
                   embedder=None, cost=None) -> DataFrame:
    """(file, text) corpus -> passages(passage_id, doc_id, pos, text, source, embedding)."""
    p = passages_from_staged(chunk_corpus(corpus, budget, cost, label_mode), dim, embedder)
    return p.withColumnRenamed("chunk_id", "passage_id")


EMBED_FAILED = "embedding failed"


def good_and_failed(staged: DataFrame, dim: int = 64, embedder=None) -> tuple[DataFrame, DataFrame]:
    """Collection rows of the documents that went through all steps, and
    (file, reason) of those that didn't: a document fails as a whole, whether
    it can't be chunked or one of its chunks can't be embedded. A chunk that a
    good document shares with a failed one stays."""
    failed = staged.where(F.col("fail_reason").isNotNull()).select("file", F.col("fail_reason").alias("reason"))
    chunks = passages_from_staged(staged, dim, embedder)
    if embedder is None:                                    # the built-in embedder has a vector for every text
        return chunks, failed
    chunks = materialize(chunks, "embedded")
    bad = chunks.where(F.col("embedding").isNull()).select("chunk_id")
    if bad.isEmpty():
        return chunks, failed
    ok, _ = split_failures(explode_chunks(staged))
    cut = with_chunk_id(ok)
    lost = cut.join(bad, "chunk_id", "left_semi").select("file").distinct()
    whole = coll.first_per_chunk(cut.join(lost, "file", "left_anti").select("chunk_id", "doc_id", "pos", "text", "source"))
    return (whole.join(chunks.select("chunk_id", "embedding"), "chunk_id"),
            failed.unionByName(lost.select("file", F.lit(EMBED_FAILED).alias("reason"))))


def rows_to_add(staged: DataFrame, dim: int = 64, embedder=None):
    """(collection rows, failures, ``embed`` of :func:`collection_add`). The
    built-in embedder can't fail, so only chunks that are new are embedded."""
    if embedder is not None:
        chunks, failed = good_and_failed(staged, dim, embedder)
        return coll.to_collection_rows(chunks), failed, None
    failed = staged.where(F.col("fail_reason").isNotNull()).select("file", F.col("fail_reason").alias("reason"))
    return coll.to_collection_rows(unique_chunks(staged)), failed, lambda new: embed_texts(new, "text", "embedding", dim)


def ingest(corpus: DataFrame, root: str, name: str, quarantine: str | None = None, budget: int = 510,
           dim: int = 64, label_mode: str = "suffix", embedder=None, cost=None) -> IngestResult:
    """Plug points: ``embedder`` (see :func:`embed_texts`) and ``cost`` (see :func:`stage_chunks`)."""
    spark = corpus.sparkSession
    coll.open_collection(spark, root, name)
    staged = materialize(chunk_corpus(corpus, budget, cost, label_mode))
    rows, failed, embed = rows_to_add(staged, dim, embedder)
    inserted = coll.collection_add(spark, root, name, rows, embed=embed)
    if quarantine:
        coll.append_failures(failed, quarantine)
    return IngestResult(inserted, coll.ingest_report(staged), failed)
