"""Findings of round 4: searches in blocks whose numbers meet, readers and joins whose tasks read what others wrote."""

import gzip
import os
import time
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import coded as C
from docloom.operators.knn import knn_topk
from docloom.sources import corpus as CP


@contextmanager
def dealt_out(spark):
    """Every key in a partition of its own, as far as 31 go."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def named(spark):
    x = np.random.default_rng(3).standard_normal((300, 8)).astype(np.float32)
    return spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "passage_id string, embedding array<float>").cache()


def listed(df):
    return sorted(map(tuple, df.select("query_id", "passage_id", "score", "rank").collect()))


def test_a_search_in_blocks_finds_what_a_scan_finds(spark, named, scratch):
    q = named.where(F.col("passage_id") < "p2").withColumnRenamed("passage_id", "query_id")
    exact = listed(knn_topk(q, named, k=4, force_path="broadcast"))
    with dealt_out(spark):
        assert listed(knn_topk(q, named, k=4, force_path="blocks", block_bytes=4_000)) == exact
        index = C.build_coded_index(named, f"{scratch}/ix", leaves=5)
        got = C.coded_topk(q, index, 4, nprobe=99, rerank=300, block_rows=100)
        assert listed(got) == exact


def test_a_corpus_is_listed_and_read_by_tasks(spark, scratch):
    files = {"a.txt": b"one\ntwo", "deep/er/b c%41+.txt": b"x\n", "deep/\u00e9.txt": b"caf\xc3\xa9", "raw.bin": b"\xff\xfe", "z.txt.gz": gzip.compress(b"packed"),
             "none.txt": b"", "_left.txt": b"no", ".out": b"no", "_away/c.txt": b"no", "_kept=1/d.txt": b"yes", "e._COPYING_": b"no"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{scratch}/c/{name}"), exist_ok=True)
        with open(f"{scratch}/c/{name}", "wb") as f:
            f.write(data)
    for i in range(300):
        os.makedirs(f"{scratch}/c/file=n%3A{i}")
        with open(f"{scratch}/c/file=n%3A{i}/part-0.txt", "w") as f:
            f.write(f"text {i}\n")
    hexed = F.hex(F.col("text").cast("binary"))
    for at in (f"{scratch}/c", f"file://{scratch}/c"):
        got = CP.scan_text_corpus(spark, at)
        assert len(got.inputFiles()) < 20                           # of the listing; no file of the corpus is known to the driver
        want = spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("u"), F.col("value").alias("text"))
        assert sorted(map(tuple, got.select("file", hexed).collect())) == sorted(
            map(tuple, want.select(CP._percent_decode(F.col("u")), hexed).collect()))
    named = dict(map(tuple, CP.scan_text_corpus(spark, f"{scratch}/c", name_dir="file").where("file <> ''").collect()))
    assert named == {f"n:{i}": f"text {i}" for i in range(300)}


def test_a_corpus_that_tasks_can_not_list_goes_through_spark(spark, scratch):
    os.makedirs(f"{scratch}/p")
    for name in ("a.txt", "b.txt", "c.bin"):
        with open(f"{scratch}/p/{name}", "w") as f:
            f.write(name)
    assert sorted(r.file for r in CP.scan_text_corpus(spark, f"{scratch}/p/*.txt").collect()) == ["a.txt", "b.txt"]
    assert [tuple(r) for r in CP.scan_text_corpus(spark, f"{scratch}/p/c.bin").collect()] == [("c.bin", "c.bin")]
    assert CP.scan_text_corpus(spark, f"{scratch}/p", recursive=False).count() == 3
    os.makedirs(f"{scratch}/none")
    assert CP.scan_text_corpus(spark, f"{scratch}/none").count() == 0


def test_sets_of_a_block_join_are_shuffled_once(spark, monkeypatch):
    from docloom.operators import set_join as S
    from docloom.operators import testset as TS
    monkeypatch.setattr(S, "LEAST_SETS", 20)
    rows = spark.createDataFrame([(i, " ".join(f"w{i // 4}x{j}" for j in range(6 + i % 4))) for i in range(400)], "id bigint, text string")
    sets = S.numbered_sets(TS._keyed_sets(rows, "id", "text"), 0.6)
    near = S.near_sets(sets, 0.6, "rep")
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()        # blocks are read, not copied for each pair
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if i // 4 == j // 4 and (6 + i % 4) / (6 + j % 4) >= 0.6 - 1e-9}
    assert {tuple(sorted((r.a, r.b))) for r in near.collect()} == want and near.count() == len(want)


def test_a_stage_leaves_no_shuffle_files(spark, tmp_path):
    from docloom.session import materialize, release, stage_path
    kept = []
    real = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return sum(x.isShuffle() for x in (real.getAllBlocks().apply(i) for i in range(real.getAllBlocks().size())))

    before = shuffled()
    for _ in range(3):
        kept.append(materialize(spark.range(1000).repartition(5, "id"), "shuffled"))
    for _ in range(100):                                            # files go a moment after the job
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and kept[-1].count() == 1000
    release(kept[0])
    assert not os.path.exists(stage_path(kept[0]).removeprefix("file:")) and os.path.exists(stage_path(kept[1]).removeprefix("file:"))


def test_searches_of_many_queries_shuffle_no_passages(spark, named, scratch):
    """Both searches of ann_coded_recall: the hits' window is the one shuffle beside the queries' own."""
    q = named.withColumnRenamed("passage_id", "query_id")
    exact = knn_topk(q, named, k=3, force_path="blocks", block_bytes=4_000)
    index = C.build_coded_index(named, f"{scratch}/ix", leaves=9)
    for hits in (exact, C.coded_topk(q, index, 3, nprobe=5, block_rows=40)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "vec" not in plan and plan.count("MapInPandas") == 1
        rows = hits.collect()
        assert len(rows) == 900 and all(r.score == 0 for r in rows if r["rank"] == 1) and len({r.query_id for r in rows}) == 300


def test_decoded_vectors_rank_as_codes_do(spark, named, scratch):
    m = C.build_coded_index(named, f"{scratch}/ix", leaves=9, parts=4).model
    x = np.array([r.embedding for r in named.collect()], float)
    leaf = m.leaf(x)
    codes, q = m.code(x, leaf), x[:7] + 0.1
    want = sum(((q[:, None, a:b] - m.leaves[leaf][None, :, a:b] - book[codes[:, k]][None]) ** 2).sum(2)
               for k, (book, a, b) in enumerate(zip(m.books, m.cuts, m.cuts[1:])))
    assert np.allclose(((q[:, None] - m.decoded(leaf, codes)[None]) ** 2).sum(2), want)


def test_graph_lists_are_filled_by_slices_and_pairs_are_few(spark, named, monkeypatch):
    from docloom.operators import neighbor_graph as N
    written = {}
    real = N.materialize

    def counted(df, name="stage"):
        out = real(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    rows = lambda g: sorted(map(tuple, g.collect()))
    whole, compared = N.neighbor_graph(named, k=4)
    whole, once = rows(whole), dict(written)
    assert sum(once["start-pairs"]) <= 4 * (300 * 4) + 1              # of each starting block a vector's 4 nearest alone
    written.clear()
    monkeypatch.setattr(N, "SLICE", 70)
    sliced, again = N.neighbor_graph(named, k=4)
    assert rows(sliced) == whole and again == compared
    assert len(written["start-pairs"]) == 5 and len(written["pairs"]) == 5 * len(once["pairs"])
    assert {r[0] for r in whole} == {f"p{i}" for i in range(300)}
