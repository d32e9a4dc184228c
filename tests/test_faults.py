"""Faults that must not come back: lost rows, wrong names, hidden failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.operators import collection as coll
from docloom.operators import generation as G
from docloom.operators.ann import CellIndex, ann_topk, build_index, cell_count
from docloom.operators.embed import model_embedder
from docloom.operators.knn import knn_topk
from docloom.operators.testset import keyphrases, question_near_dups
from docloom.plans.ingest import EMBED_FAILED, ingest
from docloom.plans.rag import rag_answer
from docloom.sources.committed import read_table
from docloom.sources.corpus import scan_text_corpus
from docloom.streaming.streams import stream_ingest


def corpus(spark, names):
    return spark.createDataFrame([(n, f"text of {n} with some words") for n in names], "file string, text string")


def test_streams_with_other_checkpoints_never_overwrite(spark, scratch):
    for part, names in (("a", ["1.pdf", "2.pdf"]), ("b", ["3.pdf"])):
        corpus(spark, names).write.parquet(os.path.join(scratch, f"in-{part}"))
        stream_ingest(spark, os.path.join(scratch, f"in-{part}"), scratch, "c", os.path.join(scratch, f"ck-{part}"))
    assert coll.open_collection(spark, scratch, "c").count() == 3
    corpus(spark, ["4.pdf"]).write.mode("append").parquet(os.path.join(scratch, "in-a"))
    stream_ingest(spark, os.path.join(scratch, "in-a"), scratch, "c", os.path.join(scratch, "ck-a"))     # the first goes on
    assert coll.open_collection(spark, scratch, "c").count() == 4


def test_stage_tables_of_a_micro_batch_are_deleted(spark, scratch):
    stages = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "docloom-stages")
    corpus(spark, ["1.pdf"]).write.parquet(os.path.join(scratch, "in"))
    before = set(os.listdir(stages)) if os.path.isdir(stages) else set()
    stream_ingest(spark, os.path.join(scratch, "in"), scratch, "c", os.path.join(scratch, "ck"))
    assert coll.open_collection(spark, scratch, "c").count() == 1
    assert set(os.listdir(stages)) <= before


def test_a_stored_part_is_refused_unless_retried(spark, scratch):
    rows = lambda *names: coll.to_collection_rows(spark.createDataFrame(
        [(n * 8, n, 0, n, [1.0], "s") for n in names], "chunk_id string, doc_id string, pos int, text string, embedding array<float>, source string"))
    assert coll.collection_add(spark, scratch, "c", rows("a", "b"), part="x") == 2
    with pytest.raises(ValueError, match="stored already"):
        coll.collection_add(spark, scratch, "c", rows("c"), part="x")
    assert coll.collection_add(spark, scratch, "c", rows("a", "b"), part="x", retry=True) == 2
    assert coll.collection_add(spark, scratch, "c", rows("b", "c")) == 1
    assert coll.open_collection(spark, scratch, "c").count() == 3


def test_embedding_failures_are_reported_by_document(spark, scratch):
    def failing_model():                                   # defined here: workers can't import this module
        def embed(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("out of range")
            return np.ones((len(texts), 4))
        return embed

    c = corpus(spark, ["good.pdf", "bad.pdf", "fine.pdf"]).unionByName(spark.createDataFrame([("none.pdf", None)], "file string, text string"))
    r = ingest(c, scratch, "c", quarantine=os.path.join(scratch, "q"), embedder=model_embedder(failing_model, keep_going=True))
    assert r.inserted == 2
    assert {(x.file, x.reason) for x in r.failed.collect()} == {("bad.pdf", EMBED_FAILED), ("none.pdf", "null text")}
    c.write.parquet(os.path.join(scratch, "in"))
    stream_ingest(spark, os.path.join(scratch, "in"), scratch, "s", os.path.join(scratch, "ck"), quarantine=os.path.join(scratch, "sq"),
                  embedder=model_embedder(failing_model, keep_going=True))
    assert coll.open_collection(spark, scratch, "s").count() == 2
    assert read_table(spark, os.path.join(scratch, "sq")).count() == 2


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())


@pytest.mark.parametrize("name", ["lettre du 3 mai.txt", "50%.txt", "a+b.txt", "a%20b.txt", "é.txt"])
def test_file_names_come_back(spark, scratch, name):
    os.makedirs(os.path.join(scratch, "f"))
    with open(os.path.join(scratch, "f", name), "w") as f:
        f.write("x\n")
    assert [tuple(r) for r in scan_text_corpus(spark, os.path.join(scratch, "f")).collect()] == [(name, "x\n")]


def test_named_folders_and_final_newlines_come_back(spark, scratch):
    rows = [("a+b.pdf", "one\n"), ("a b.pdf", "two"), ("a:b%41/c.pdf", "\n"), ("50%.pdf", "x\n\n")]
    path = os.path.join(scratch, "n")
    spark.createDataFrame(rows, "file string, text string").repartition("file").write.partitionBy("file").text(path)
    assert sorted(map(tuple, scan_text_corpus(spark, path, name_dir="file").collect())) == sorted(rows)


def test_cosine_keeps_valid_hits_among_zero_vectors_and_l2_keeps_digits(spark):
    zero, one = [0.0, 0.0], [1.0, 1.0]
    p = spark.createDataFrame([(i, one if i in (3, 7) else zero) for i in range(10)], "passage_id int, embedding array<double>")
    q = spark.createDataFrame([(0, one), (1, zero)], "query_id int, embedding array<double>")
    for path in ("broadcast", "blocks"):
        got = [(r.query_id, r.passage_id) for r in knn_topk(q, p, k=3, metric="cosine", force_path=path).collect()]
        assert sorted(got) == [(0, 3), (0, 7)]
    far = spark.createDataFrame([(i, [1e5, 1e5 + i * 5e-4]) for i in range(6)], "passage_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1e5, 1e5])], "query_id int, embedding array<double>")
    got = [(r.passage_id, r.score) for r in knn_topk(q, far, k=3).orderBy("rank").collect()]
    assert [g[0] for g in got] == [0, 1, 2] and got[1][1] == pytest.approx(2.5e-7, abs=2e-9)


def test_near_duplicates_at_an_exact_threshold(spark):
    a = " ".join(f"w{i}" for i in range(100))
    b = " ".join(f"w{i}" for i in range(55))
    df = spark.createDataFrame([(1, a), (2, b)], "id int, text string")
    assert [tuple(r) for r in question_near_dups(df, t=0.55).collect()] == [(1, 2, 0.55)]


def test_texts_without_terms_are_flagged(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, "..."), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.too_few for r in keyphrases(df).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_alias_keys_payload_types_and_short_replies(spark):
    spark.conf.unset("spark.sql.mapKeyDedupPolicy")
    df = spark.createDataFrame([(1, 'say "hi"', {"max_new_tokens": "9", "n": "2", "seed": "x"}), (2, None, None)],
                               "request_id int, prompt string, params map<string,string>")
    req = {r.request_id: r.payload for r in G.build_requests(df).collect()}
    assert req[1] == ('{"inputs":"say \\"hi\\"","parameters":{"best_of":2,"details":true,"do_sample":true,"max_new_tokens":9,'
                      '"num_return_sequences":2,"seed":"x","stop":["\\n","\\n\\n"],"temperature":0.1,"top_p":0.97}}')
    assert '"max_new_tokens":75' in req[2] and '"do_sample":false' in req[2]

    class Short:
        def __call__(self, prompts, params):
            return ["one"] if len(prompts) == 1 else prompts[:-1]

    reqs = G.build_requests(df)
    out = G.batch_generate(reqs.coalesce(1), Short, retries=0).collect()
    assert all(r.raw is None and "replies" in r.error for r in out)


def test_misses_are_generated_once_and_failures_not_cached(spark, scratch):
    ran = spark.sparkContext.accumulator(0)

    def generate(todo):
        def run(batches):
            for b in batches:
                ran.add(len(b))
                b["response"] = [None if p == "bad" else f"r:{p}" for p in b["payload"]]
                yield b[["key", "response"]]
        return todo.mapInPandas(run, "key string, response string")

    path = os.path.join(scratch, "cache")
    spark.createDataFrame([], "key string, response string").write.parquet(path)
    req = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "a")], "request_id int, payload string")
    first = G.cached_generate(req, spark.read.parquet(path), generate)
    assert first.count() == 3 and first.where("response is null").count() == 1
    G.append_cache(first, path)
    assert ran.value == 2
    assert spark.read.parquet(path).count() == 1
    second = {r.request_id: r.from_cache for r in G.cached_generate(req, spark.read.parquet(path), generate).collect()}
    assert second == {1: True, 2: False, 3: True}


def test_an_index_is_fitted_once_and_sized_before_the_fit(spark):
    assert cell_count(10 ** 12, 1024) * 1024 * 8 <= 64 << 20 and cell_count(100, 8) == 10
    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "passage_id int, embedding array<double>")
    index = build_index(v, cells=9)
    assert isinstance(index, CellIndex) and index.passages.count() == 300
    q = v.select(F.col("passage_id").alias("query_id"), "embedding").limit(20)
    exact = sorted((r.query_id, r.passage_id, r.rank) for r in knn_topk(q, v, k=5).collect())
    got = sorted((r.query_id, r.passage_id, r.rank) for r in ann_topk(q, v, k=5, nprobe=9, index=index, carry=["embedding"]).collect())
    assert got == exact


def test_answers_use_the_given_embedder_reranker_and_rewriter(spark):
    p = spark.createDataFrame([(f"p{i}", [float(i), 0.0], f"text {i}", f"s{i}") for i in range(6)],
                              "passage_id string, embedding array<float>, text string, source string")
    q = spark.createDataFrame([(1, "which?")], "query_id bigint, question string")
    seen = []

    def rewrite(questions, hits, hop):
        seen.append((hop, None if hits is None else sorted(r.text for r in hits.collect())))
        return questions.select("query_id", F.concat("question", F.lit(f" hop {hop}")).alias("query"))

    answers, ranked = rag_answer(q, p, rewrite=rewrite, embedder=lambda c: F.array(F.length(c) * 0.0 + 4, F.lit(0.0)),
                                 reranker=lambda query, text: F.when(query.contains("hop 2") & text.contains("3"), 2.0).otherwise(1.0), k=2, rerank_k=2)
    assert [h for h, _ in seen] == [1, 2] and seen[0][1] is None and seen[1][1] == ["text 3", "text 4"]
    assert [r.source for r in ranked.orderBy("rank").collect()] == ["s3", "s4"]
    assert answers.first().answer.startswith("stub:")
