"""Faults that showed on larger tables, on rows of their own."""

import numpy as np
import pandas as pd

from docloom.operators import knn as K
from docloom.operators.embed import with_hash_embedding


def test_texts_without_terms_have_a_vector_of_the_same_length(spark):
    df = spark.createDataFrame([(1, "-- ?"), (2, ""), (3, "two words"), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in with_hash_embedding(df).collect()}
    assert got[1] == got[2] == [0.0] * 64 and len(got[3]) == 64 and got[4] is None
    hits = K.knn_topk(with_hash_embedding(df.where("id = 3")).withColumnRenamed("id", "query_id"),
                      with_hash_embedding(df).withColumnRenamed("id", "passage_id"), k=3)
    assert [r.passage_id for r in hits.orderBy("rank").collect()] == [3, 1, 2]


def test_knn_ties_after_rounding_go_by_id():
    vecs = np.zeros((40, 3), np.float32)
    vecs[:, 0] = np.arange(40, 0, -1) * 1e-8                        # all squared distances round to 0
    pdf = pd.DataFrame({"passage_id": np.arange(40), "embedding": list(vecs)})
    got = K._tiled_topk(np.array([39]), vecs[39:].astype(float), pdf, "passage_id", "embedding", [], 5, "l2sq", False)
    assert sorted(got["passage_id"]) == [0, 1, 2, 3, 4]


def test_knn_scores_few_pairs_of_equal_vectors(monkeypatch):
    pdf = pd.DataFrame({"passage_id": np.arange(6000), "embedding": [np.array([1.0, 2.0], np.float32)] * 6000})
    scored = []
    real = K._Near.scores
    monkeypatch.setattr(K._Near, "scores", lambda self, qi, pi: scored.append(len(qi)) or real(self, qi, pi))
    got = K._tiled_topk(np.arange(50), np.tile([1.0, 2.0], (50, 1)), pdf, "passage_id", "embedding", [], 4, "l2sq", True)
    assert sum(scored) <= 50 * 5 and len(got) == 200
    assert sorted(got[got["query_id"] == 2]["passage_id"]) == [0, 1, 3, 4]


def test_corpus_of_many_files_needs_no_renames_by_the_driver(spark, scratch, monkeypatch):
    from docloom.sources import corpus as C
    rows = [("a+b %41 c:x=1/[y].pdf", "one\ntwo"), ("plain.pdf", ""), ("é", "last"), (None, "nameless")]
    df = spark.createDataFrame(rows, "file string, text string")
    C.write_text_corpus(df, f"{scratch}/here")
    df.repartition("file").write.partitionBy("file").text(f"{scratch}/there")
    read = lambda d: sorted(map(tuple, C.scan_text_corpus(spark, f"{scratch}/{d}", name_dir="file").collect()))
    assert read("here") == read("there") and rows[0] in read("here") and len(read("here")) == 4


def test_search_of_every_code_writes_no_candidates(spark, monkeypatch):
    from docloom.operators import coded as CO
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)], "passage_id long, embedding array<float>")
    index = CO.build_coded_index(v)
    written = []
    real = CO.materialize
    monkeypatch.setattr(CO, "materialize", lambda df, name="stage": written.append(name) or real(df, name))
    q = v.withColumnRenamed("passage_id", "query_id")
    got = CO.coded_topk(q, index, 5, nprobe=len(index.model.leaves), rerank=300, block_rows=100)
    cols = ("query_id", "passage_id", "rank", "score")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, K.knn_topk(q, v, k=5).select(*cols).collect()))
    assert "candidates" not in written


def test_near_sets_in_small_blocks_with_few_numbered_words(spark, monkeypatch):
    import random

    from docloom.operators import set_join as SJ
    from docloom.operators import testset as TS
    rng = random.Random(5)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(25)], rng.randint(1, 12))) for _ in range(120)]
    sets = [frozenset(x.split()) for x in texts]
    want, rep = [], {}
    for i, s in enumerate(sets):
        if s in rep:
            want.append((rep[s], i))
        rep.setdefault(s, i)
    want += [(i, j) for a, i in rep.items() for b, j in rep.items() if i < j and len(a & b) >= 0.55 * len(a | b) - 1e-9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    written = []
    real = TS.materialize
    for name in (TS, SJ):
        monkeypatch.setattr(name, "materialize", lambda d, name="stage": written.append(name) or real(d, name))
    for settings in ({"LEAST_SETS": 10, "LEAST_TOKENS": 40}, {"NUMBERED": 4, "LEAST_SETS": 10, "HASH_BITS": 10}):
        for k, v in settings.items():
            monkeypatch.setattr(SJ, k, v)
        got = TS.question_near_dups(df, "id", "text", 0.55).select("id_a", "id_b").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert "candidates" not in written


def test_keyphrases_of_rarer_terms_and_repeated_ids(spark, monkeypatch):
    from docloom.operators import testset as TS
    df = spark.createDataFrame([(1, "a b b c"), (1, "c d"), (2, "a c"), (None, "e e"), (None, "e a"), (3, "!"), (4, None)], "doc_id int, text string")
    rows = lambda: sorted((tuple(r) for r in TS.keyphrases(df).collect()), key=repr)
    want = rows()
    assert [(r[0], r[2]) for r in want if r[1] == 1] == [(1, "b"), (2, "c"), (None, "e")] and sum(r[2] is None for r in want) == 2
    monkeypatch.setattr(TS, "COMMON_TERMS", 1)
    assert rows() == want


def test_tables_of_many_rows_a_split_are_spread(spark, monkeypatch):
    from docloom import session
    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    assert session.spread(spark.range(0, 1000, numPartitions=16)).rdd.getNumPartitions() == 100
    assert session.spread(spark.range(0, 1000, numPartitions=1)).rdd.getNumPartitions() == 100


def test_only_new_chunks_are_embedded(spark, scratch):
    from pyspark.sql import functions as F

    from docloom.operators import collection as coll
    seen = []

    def embed(new):
        seen.append(sorted(r.text for r in new.select("text").collect()))
        return with_hash_embedding(new)

    def batch(*texts):
        df = spark.createDataFrame([(str(i), x, "s") for i, x in enumerate(texts)], "doc_id string, text string, source string")
        return coll.to_collection_rows(df.select(F.md5("text").alias("chunk_id"), "doc_id", F.lit(0).alias("pos"), "text", "source"))

    assert coll.collection_add(spark, scratch, "c", batch("x", "y"), embed=embed) == 2
    assert coll.collection_add(spark, scratch, "c", batch("y", "z"), embed=embed) == 1
    assert seen == [["x", "y"], ["z"]]
    assert all(len(r.embedding) == 64 for r in coll.open_collection(spark, scratch, "c").collect())


def test_chunking_sends_small_batches_to_python(spark):
    from docloom.operators.chunk import chunk_documents
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        chunk_documents(spark.createDataFrame([(1, "a b")], "doc_id int, text string"))
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, was)


def test_payloads_are_written_once(spark, monkeypatch):
    from docloom.operators import generation as G
    written = []
    real = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name="stage": written.append(name) or real(df, name))
    req = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "request_id int, payload string")
    cache = spark.createDataFrame([], "key string, response string")
    out = G.cached_generate(req, cache, lambda todo: todo.selectExpr("key", "upper(payload) as response"))
    assert sorted((r.request_id, r.response) for r in out.collect()) == [(1, "P"), (2, "P"), (3, None)]
    assert written.count("requests") == 1


def test_search_of_some_leaves_writes_no_candidates(spark, monkeypatch):
    from docloom.operators import coded as CO
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(400)], "passage_id long, embedding array<float>")
    index = CO.build_coded_index(v)
    assert len(index.model.leaves) > 1
    written = []
    real = CO.materialize
    monkeypatch.setattr(CO, "materialize", lambda df, name="stage": written.append(name) or real(df, name))
    q = v.withColumnRenamed("passage_id", "query_id")
    exact = {(r.query_id, r.passage_id): r.score for r in K.knn_topk(q, v, k=400, exclude_self=True).collect()}
    monkeypatch.setattr(CO, "QUERY_BLOCK", 50)
    got = CO.coded_topk(q, index, 5, nprobe=len(index.model.leaves) - 1, rerank=60, exclude_self=True, block_rows=100).collect()
    assert len(got) == 2000 and all(abs(exact[r.query_id, r.passage_id] - r.score) < 1e-9 for r in got)
    best = {}
    for (a, b), s in exact.items():
        best.setdefault(a, []).append((s, b))
    top = {(a, b) for a, rows in best.items() for _, b in sorted(rows)[:5]}
    assert len(top & {(r.query_id, r.passage_id) for r in got}) >= 0.8 * 2000
    assert "candidates" not in written
