"""Registered queries: streaming forms (run to completion with availableNow)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import collection as coll
from docloom.plans.oracles import _rag_sql
from docloom.plans.registry import EXTRA_ORACLES, _passages, register
from docloom.plans.sqlparts import passages_ctes
from docloom.session import read_table, scratch
from docloom.sources import fixtures as FX
from docloom.streaming.history import drain_history
from docloom.streaming.streams import stream_dedup, stream_ingest, stream_rag_query


@register("stream_ingest", f"WITH {passages_ctes()} SELECT passage_id AS chunk_id, text FROM psg")
def q_stream_ingest(spark, sf):
    base = scratch(spark, "stream-ingest")
    src = os.path.join(base, "incoming")
    FX.corpus(spark, sf).repartition(4).write.parquet(src)          # the corpus arrives as several files
    stream_ingest(spark, src, os.path.join(base, "collections"), "docs", os.path.join(base, "ckpt"))
    return coll.open_collection(spark, os.path.join(base, "collections"), "docs").select("chunk_id", "text")


@register("stream_dedup", "SELECT DISTINCT event_id, event_type FROM events")
def q_stream_dedup(spark, sf):
    base = scratch(spark, "stream-dedup")
    ev = read_table(spark, sf, "events")
    files = 4
    for i in range(2):            # the same events delivered twice, each delivery in event-time order
        ev.repartitionByRange(files, "ts").write.parquet(os.path.join(base, "incoming", f"copy={i}"))
    schema = ev.schema.add("copy", T.IntegerType())
    # one micro-batch per delivery: the replayed copy meets the state (or is behind the watermark)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(os.path.join(base, "incoming"))
    q = (stream_dedup(src, "event_id", "ts", "1 hour").select("event_id", "event_type")
         .writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


@register("stream_rag_query", _rag_sql())
def q_stream_rag(spark, sf):
    base = scratch(spark, "stream-rag")
    src = os.path.join(base, "incoming")
    FX.questions(spark, sf).repartition(2).write.parquet(src)
    stream_rag_query(spark, src, _passages(spark, sf), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    return spark.read.parquet(os.path.join(base, "out")).drop("batch_id")


@register("stream_history", EXTRA_ORACLES["chat_history_pairs"])
def q_stream_history(spark, sf):
    """The history of conversations whose turns arrive in several files, in no order."""
    base = scratch(spark, "stream-history")
    src = os.path.join(base, "incoming")
    turns = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    turns.repartition(3, F.xxhash64("conv_id", "turn")).write.parquet(src)
    drain_history(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files=1)
    return spark.read.parquet(os.path.join(base, "out"))
