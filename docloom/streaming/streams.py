"""Streaming operators (STR-1..3).

Each micro-batch reuses the batch operators in ``foreachBatch``. Writes go
to a part or folder named by the stream's own label, kept in its checkpoint,
and the batch id: a batch replayed after a failure finds its part done or
rewrites the same folder (idempotent), while a stream with another checkpoint
writes beside it and never over it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import collection as coll
from docloom.plans.ingest import chunk_corpus, rows_to_add
from docloom.plans.rag import answer_events, rag_answer, rag_retrieve
from docloom.session import materialize, stage_scope

CORPUS_SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("text", T.StringType())])


def stream_label(spark: SparkSession, checkpoint: str) -> str:
    """The stream's label: made once, kept in the checkpoint folder."""
    path = os.path.join(checkpoint, "docloom-label")
    if not coll._exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "label string").write.mode("ignore").parquet(path)
    return spark.read.parquet(path).first()[0]


def stream_ingest(spark: SparkSession, source_dir: str, root: str, name: str, checkpoint: str,
                  schema: T.StructType = CORPUS_SCHEMA, budget: int = 510, dim: int = 64, fmt: str = "parquet",
                  quarantine: str | None = None, embedder=None, cost=None):
    """Arriving corpus files are cleaned, chunked, embedded and added to the
    collection; documents that fail go to ``quarantine`` (file, reason), a
    part per batch. Runs until the folder is drained (availableNow)."""
    coll.open_collection(spark, root, name)
    label = stream_label(spark, checkpoint)
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        part = f"stream-{label}-{batch_id}"
        with stage_scope(spark):
            staged = materialize(chunk_corpus(batch, budget, cost), "stream-staged")
            rows, failed, embed = rows_to_add(staged, dim, embedder)
            if quarantine:
                coll.append_failures(failed, quarantine, part)
            coll.collection_add(spark, root, name, rows, part=part, retry=True, embed=embed)

    q = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_dedup(df: DataFrame, id_col: str, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """One row per id within the watermark delay (bounded state). A
    TIMESTAMP_NTZ event time is cast to TIMESTAMP first (watermarks need it)."""
    ts = F.col(event_time)
    if isinstance(df.schema[event_time].dataType, T.TimestampNTZType):
        df = df.withColumn(event_time, ts.cast("timestamp"))
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_col])


def stream_rag_query(spark: SparkSession, questions_dir: str, passages: DataFrame, sink_dir: str, checkpoint: str,
                     schema: T.StructType | None = None, **rag_kw):
    """Each arriving batch of questions is retrieved for (RET-8); the micro-batch
    is the broadcast side of the kNN. Results land in a folder per batch."""
    label = stream_label(spark, checkpoint)
    schema = schema or T.StructType([T.StructField("query_id", T.LongType()), T.StructField("question", T.StringType())])
    src = spark.readStream.schema(schema).parquet(questions_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        with stage_scope(spark):
            out = rag_retrieve(batch, passages, **rag_kw)
            out.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={label}-{batch_id}"))

    q = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stream_answers(spark: SparkSession, questions_dir: str, passages: DataFrame, sink_dir: str, checkpoint: str,
                   schema: T.StructType | None = None, link_base: str = "", encode_links: bool = False, **answer_kw):
    """Each arriving batch of questions is answered (:func:`rag_answer`) and
    written as chat messages (CHT-2), a folder per batch."""
    label = stream_label(spark, checkpoint)
    schema = schema or T.StructType([T.StructField("query_id", T.LongType()), T.StructField("question", T.StringType())])
    src = spark.readStream.schema(schema).parquet(questions_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        with stage_scope(spark):
            answers, ranked = rag_answer(materialize(batch, "questions"), passages, **answer_kw)
            answer_events(answers, ranked, link_base, encode_links).write.mode("overwrite").parquet(
                os.path.join(sink_dir, f"batch_id={label}-{batch_id}"))

    q = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
