"""Chat history over a stream of turns, with state per conversation (CHT-3).

Turns may arrive in any order and in any number of micro-batches: a
conversation's state holds the user and assistant turns that still wait for
their partner, an entry a turn, and whether the greeting has been given. State
is dropped once a conversation has been silent for ``idle_ms`` (a timer on
processing time), so it is bounded by the conversations of that time and their
unanswered turns. It lives in RocksDB and is checkpointed, so a restarted
stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GREETING = "Hello, I am your research assistant."
IDLE_MS = 24 * 3600 * 1000
TURNS_SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HISTORY_SCHEMA = "conv_id bigint, idx bigint, question string, answer string"
#: What a run that ends needs: state with timers is kept by RocksDB, and timers alone start no batch.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class History(StatefulProcessor):
    """Pairs a user turn with the assistant turn right after it."""

    def __init__(self, greeting: str, idle_ms: int):
        self.greeting, self.idle_ms = greeting, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.greeted = handle.getValueState("greeted", "yes boolean")
        self.asked = handle.getMapState("asked", "turn bigint", "text string")
        self.said = handle.getMapState("said", "turn bigint", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if not self.greeted.exists():
            self.greeted.update((True,))
            out.append((key[0], 0, "", self.greeting))
        for pdf in rows:
            for turn, role, text in zip(pdf["turn"], pdf["role"], pdf["text"]):
                turn = int(turn)
                if role == "user":
                    mine, other, at = self.asked, self.said, turn + 1
                elif role == "assistant" and text is not None:
                    mine, other, at = self.said, self.asked, turn - 1
                else:
                    continue
                if other.containsKey((at,)):
                    found = other.getValue((at,))[0]
                    other.removeKey((at,))
                    question, answer, first = (text, found, turn) if role == "user" else (found, text, at)
                    out.append((key[0], first + 1, question, answer))
                else:
                    mine.updateValue((turn,), (text,))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "idx", "question", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.greeted, self.asked, self.said):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_history(turns: DataFrame, greeting: str = GREETING, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream (conv_id, turn, role, text) -> the rows of ``chat_history_pairs``
    as they become known: the greeting when a conversation is first seen, a
    pair when both of its turns have arrived. A conversation that comes back
    after ``idle_ms`` of silence is a new one. A null answer counts as none.
    The query that runs it needs RocksDB state (``SETTINGS``)."""
    rows = turns.select(turns["conv_id"].cast("bigint"), turns["turn"].cast("bigint"), "role", "text")
    return rows.groupBy("conv_id").transformWithStateInPandas(History(greeting, idle_ms), HISTORY_SCHEMA, "append", "ProcessingTime")


@contextmanager
def _settings(spark: SparkSession, **values):
    """Settings of the session for the time of a run."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain_history(spark: SparkSession, turns_dir: str, out_dir: str, checkpoint: str, greeting: str = GREETING,
                  idle_ms: int = IDLE_MS, max_files: int | None = None) -> None:
    """Run :func:`stream_history` over what has arrived in a folder of Parquet
    files, append its rows to ``out_dir``, and stop. Started again on its
    checkpoint it goes on where it was. A run that is to end makes no batches
    without data: timers would ask for one after the other."""
    src = spark.readStream.schema(TURNS_SCHEMA)
    src = src.option("maxFilesPerTrigger", max_files) if max_files else src
    with _settings(spark, **SETTINGS):
        q = (stream_history(src.parquet(turns_dir), greeting, idle_ms).writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
