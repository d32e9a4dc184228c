"""Chat history with state per conversation."""

import os

import pytest

from docloom.operators.chat import chat_history_pairs
from docloom.streaming import history as H

TURNS = H.TURNS_SCHEMA
ROWS = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q3"), (1, 4, "user", "q4"), (1, 5, "assistant", "a4"),
        (2, 0, "user", "only a question"), (3, 0, "assistant", "only an answer"), (4, 0, "user", None), (4, 1, "assistant", "a"), (5, 0, "user", "q"),
        (5, 1, "assistant", None)]


def run(spark, scratch, **kw):
    H.drain_history(spark, os.path.join(scratch, "in"), os.path.join(scratch, "out"), os.path.join(scratch, "ck"), max_files=1, **kw)
    return sorted(map(tuple, spark.read.schema(H.HISTORY_SCHEMA).parquet(os.path.join(scratch, "out")).collect()), key=repr)


def deliver(spark, scratch, rows):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(os.path.join(scratch, "in"))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_history_of_turns_in_any_order_and_after_a_restart(spark, scratch):
    want = sorted(map(tuple, chat_history_pairs(spark.createDataFrame(ROWS, TURNS)).collect()), key=repr)
    deliver(spark, scratch, ROWS[2::3])
    deliver(spark, scratch, ROWS[0::3])
    first = run(spark, scratch)
    assert set(first) < set(want)
    deliver(spark, scratch, ROWS[1::3])                         # the stream is started again on its checkpoint
    assert run(spark, scratch) == want


def test_a_silent_conversation_is_forgotten(spark, scratch):
    deliver(spark, scratch, [(1, 0, "user", "q")])
    deliver(spark, scratch, [(2, 0, "user", "another conversation")])
    assert run(spark, scratch, idle_ms=1) == [(1, 0, "", H.GREETING), (2, 0, "", H.GREETING)]
    deliver(spark, scratch, [(3, 0, "user", "time passes")])
    run(spark, scratch, idle_ms=1)
    deliver(spark, scratch, [(1, 1, "assistant", "a late answer")])
    got = run(spark, scratch, idle_ms=1)
    assert got.count((1, 0, "", H.GREETING)) == 2 and not any(r[3] == "a late answer" for r in got)
