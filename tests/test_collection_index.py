"""Committed tables (visible at once or not at all) and the collection's index."""

import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import collection as coll
from docloom.sources import committed as CT

ROWS = "chunk_id string, doc_id string, pos int, text string, embedding array<float>, source string"


def rows_of(spark, ids, doc="d"):
    """Collection rows of chunk ids md5(i), spread over a few partitions."""
    df = ids if hasattr(ids, "columns") else spark.createDataFrame([(int(i),) for i in ids], "id bigint")
    return coll.to_collection_rows(df.select(F.md5(F.col("id").cast("string")).alias("chunk_id"), F.lit(doc).alias("doc_id"),
                                             F.lit(0).alias("pos"), F.col("id").cast("string").alias("text"),
                                             F.array(F.lit(1.0)).alias("embedding"), F.lit("s").alias("source")))


def failing(spark, ok_rows):
    """Rows whose third partition fails after some rows have been written."""
    def run(batches):
        for b in batches:
            if "13" in b["text"].to_pylist():
                raise RuntimeError("executor lost")
            yield b

    return spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("text")).mapInArrow(run, "text string")


def test_a_failed_write_leaves_nothing(spark, scratch):
    path = f"{scratch}/t"
    CT.write_part(spark.range(3).select(F.col("id").cast("string").alias("text")), path, "first")
    with pytest.raises(Exception, match="executor lost|aborted"):
        CT.write_part(failing(spark, 10), path, "second")
    assert CT.read_table(spark, path).count() == 3
    assert [c["part"] for c in CT.visible(path)] == ["first"] and not os.path.exists(f"{path}/commits/second.json")
    CT.vacuum(path)
    assert len(os.listdir(f"{path}/data")) == 1
    CT.write_part(spark.range(5).select(F.col("id").cast("string").alias("text")), path, "second")     # the label is free
    assert CT.read_table(spark, path).count() == 8


def test_a_failed_add_leaves_the_collection_as_it_was(spark, scratch):
    assert coll.collection_add(spark, scratch, "c", rows_of(spark, range(10))) == 10
    bad = rows_of(spark, range(5, 30)).withColumn("text", F.when(F.col("text") == "29", F.raise_error(F.lit("executor lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="executor lost"):
        coll.collection_add(spark, scratch, "c", bad)
    assert coll.open_collection(spark, scratch, "c").count() == 10
    assert coll.collection_add(spark, scratch, "c", rows_of(spark, range(5, 30))) == 20


def test_readers_see_the_old_state_until_the_commit(spark, scratch):
    path, go, seen = f"{scratch}/t", f"{scratch}/go", []
    CT.write_part(spark.range(2), path, "old")
    before = CT.read_table(spark, path)

    def slow(batches):
        for b in batches:
            yield b
        for _ in range(600):                                # the rows are written, the part isn't committed
            if os.path.exists(go):
                return
            time.sleep(0.1)

    def read():
        while not any(f.endswith(".parquet") for d in os.listdir(f"{path}/data") if d.startswith("new-") for f in os.listdir(f"{path}/data/{d}")):
            time.sleep(0.05)
        seen.append(CT.read_table(spark, path).count())
        open(go, "w").close()

    reader = threading.Thread(target=read)
    reader.start()
    CT.write_part(spark.range(0, 8, 1, 2).mapInArrow(slow, "id bigint"), path, "new")
    reader.join()
    assert seen == [2] and before.count() == 2 and CT.read_table(spark, path).count() == 10


def test_a_stored_label_is_refused_by_the_commit_itself(spark, scratch):
    CT.write_part(spark.range(2), f"{scratch}/t", "x")
    with pytest.raises(Exception, match="stored already"):
        CT.write_part(spark.range(3), f"{scratch}/t", "x")
    assert CT.read_table(spark, f"{scratch}/t").count() == 2 and len(os.listdir(f"{scratch}/t/data")) == 1
    with pytest.raises(ValueError, match="label"):
        CT.write_part(spark.range(3), f"{scratch}/t", "../x")


def test_publish_once(spark, scratch):
    coll.publish_testset(spark.range(2), f"{scratch}/p")
    with pytest.raises(FileExistsError):
        coll.publish_testset(spark.range(3), f"{scratch}/p")
    assert CT.read_table(spark, f"{scratch}/p").count() == 2


def test_failures_of_one_batch_are_kept_once(spark, scratch):
    for _ in range(2):
        coll.append_failures(spark.createDataFrame([("a", "r")], "file string, reason string"), f"{scratch}/q", "batch-1")
    coll.append_failures(spark.createDataFrame([], "file string, reason string"), f"{scratch}/q", "batch-2")
    assert CT.read_table(spark, f"{scratch}/q").collect() == [("a", "r")]


def test_bloom_filters_hold_what_they_hold():
    rng = np.random.default_rng(0)
    keys = rng.integers(-2**63, 2**63 - 1, 20_000)
    bloom = CT.bloom_of(keys)
    assert CT.in_bloom(bloom, keys).all()
    assert CT.in_bloom(bloom, rng.integers(-2**63, 2**63 - 1, 20_000)).mean() < 0.01
    assert not CT.in_bloom(CT.bloom_of(keys[:0]), keys).any()


def test_file_numbers_cover_all_files_evenly(spark):
    r = spark.range(20_000).select(CT.file_of(F.xxhash64("id"), F.lit(7)).alias("f")).groupBy("f").count().collect()
    assert sorted(x.f for x in r) == list(range(7)) and min(x["count"] for x in r) > 2500


def test_overlapping_batches_on_both_paths(spark, scratch):
    """Parts smaller than the batch are read whole, larger ones through their filters."""
    add = lambda ids, **kw: coll.collection_add(spark, scratch, "c", rows_of(spark, ids), file_rows=50, fan=100, **kw)
    assert add(range(1000)) == 1000
    assert add(range(950, 1050)) == 50                     # 100 ids against 20 files of 1,000
    assert add(range(1040, 1100)) == 50                    # against one smaller part and a larger one
    assert add(range(0, 3000, 2)) == 950                   # larger than any part
    assert add(range(3000)) == 3000 - 2050
    got = coll.open_collection(spark, scratch, "c").groupBy("chunk_id").count().collect()
    assert len(got) == 3000 and all(r["count"] == 1 for r in got)
    files = [len(c["files"]) for c in CT.visible(f"{scratch}/c")]
    assert sorted(files) == [1, 1, 19, 19, 20]             # write tasks grow with the rows


def test_an_add_to_a_million_chunks_reads_few_files(spark, scratch):
    big = spark.range(1_000_000)
    assert coll.collection_add(spark, scratch, "c", rows_of(spark, big), file_rows=2_000) == 1_000_000
    path = f"{scratch}/c"
    n_files = len(CT.visible(path)[0]["files"])
    assert n_files == 500
    fresh = rows_of(spark, range(2_000_000, 2_000_100))
    assert len(coll.files_to_read(path, fresh.select("chunk_id"), 100)) < 0.05 * n_files
    known = rows_of(spark, range(10))                       # ids that are there: their files, and hardly any other
    read = coll.files_to_read(path, known.select("chunk_id"), 10)
    assert 1 <= len(read) <= 15
    assert {r.chunk_id for r in known.collect()} <= {r.chunk_id for r in spark.read.parquet(*read).select("chunk_id").collect()}
    assert coll.collection_add(spark, scratch, "c", rows_of(spark, [*range(999_995, 1_000_005)]), file_rows=2_000) == 5


def test_small_parts_are_merged_and_vacuumed(spark, scratch):
    for i in range(9):
        assert coll.collection_add(spark, scratch, "c", rows_of(spark, range(10 * i, 10 * i + 15)), part=f"p{i}", file_rows=20, fan=3) \
            == (15 if i == 0 else 10)
    path = f"{scratch}/c"
    parts = CT.visible(path)
    assert len(parts) <= 5 and sum(c["rows"] for c in parts) == 95
    kept = coll.open_collection(spark, scratch, "c")
    assert kept.select("chunk_id").distinct().count() == kept.count() == 95
    hidden = len(CT.commits(path)) - len(parts)
    assert hidden >= 8 and CT.vacuum(path) == hidden
    assert [c["part"] for c in CT.commits(path)] == [c["part"] for c in parts]
    assert coll.open_collection(spark, scratch, "c").count() == 95
    # a merged and forgotten batch that comes again finds its ids stored
    assert coll.collection_add(spark, scratch, "c", rows_of(spark, range(15)), part="p0", retry=True, file_rows=20, fan=3) == 0


def test_a_commit_names_what_it_holds(spark, scratch):
    coll.collection_add(spark, scratch, "c", rows_of(spark, range(30)), part="p", file_rows=10)
    with open(f"{scratch}/c/commits/p.json") as f:
        c = json.load(f)
    assert c["rows"] == 30 and c["n"] == 3 and {f[0] for f in c["files"]} <= {0, 1, 2}
    for number, names in CT.data_files(f"{scratch}/c", c).items():
        of = CT.file_of(F.xxhash64("chunk_id"), F.lit(3))
        assert [r[0] for r in spark.read.parquet(*names).select(of).distinct().collect()] == [number]
