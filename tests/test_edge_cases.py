"""Literal-row tests for the edge cases listed in FIXTURES.md."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as TX
from docloom.operators import chat as CH
from docloom.operators import collection as coll
from docloom.operators import generation as G
from docloom.operators import retrieve as R
from docloom.operators import sft as S
from docloom.operators import testset as TS
from docloom.operators.chunk import chunk_documents, pack_words, split_failures
from docloom.operators.knn import knn_topk


def test_source_label_and_stem(spark):
    df = spark.createDataFrame([("INSSN-pdf.pdf",), ("fdp-letter.pdf",), ("a.b.pdf",)], "file string")
    rows = df.select(TX.source_label("file", "charset").alias("c"), TX.source_label("file", "suffix").alias("s"),
                     TX.file_stem("file").alias("stem")).collect()
    assert [r.c for r in rows] == ["INSSN-", "-letter", "a.b"]
    assert [r.s for r in rows] == ["INSSN-pdf", "fdp-letter", "a.b"]
    assert rows[2].stem == "a"


def test_clean_whitespace(spark):
    df = spark.createDataFrame([("a \n  b  ",), ("x y",), ("\t z \r",)], "t string")
    assert [r[0] for r in df.select(TX.clean_whitespace("t")).collect()] == ["a b", "x y", "z"]


def test_chunk_edge_cases(spark):
    long_word = "x" * 2100
    df = spark.createDataFrame([(1, ""), (2, None), (3, "ok " + long_word), (4, "fine words here")],
                               "doc_id int, text string")
    for engine in ("arrow", "sql"):
        ch = chunk_documents(df, budget=510, engine=engine).withColumn("file", F.col("doc_id").cast("string"))
        ok, failed = split_failures(ch)
        assert sorted((r.doc_id, r.pos, r.text) for r in ok.collect()) == [(4, 0, "fine words here")]
        assert sorted((r.file, r.reason) for r in failed.collect()) == [("2", "null text"), ("3", "word over token budget")]


def test_pack_words_matches_greedy():
    import random
    rnd = random.Random(3)
    for _ in range(200):
        words = ["w" * rnd.randint(1, 40) for _ in range(rnd.randint(1, 300))]
        budget = rnd.randint(10, 60)
        got, reason = pack_words(" ".join(words), budget)
        assert reason is None
        exp, cur, used = [], [], 0
        for w in words:                                   # plain greedy, one word at a time
            c = max(1, -(-len(w) // 4))
            if cur and used + c > budget:
                exp.append(" ".join(cur)); cur, used = [], 0
            cur.append(w); used += c
        exp.append(" ".join(cur))
        assert got == exp


def test_collection_add_rules(spark, scratch):
    rows = spark.createDataFrame(
        [("same text", "d2", 0, [0.1, 0.2], "b"), ("same text", "d1", 3, [0.3, 0.4], "a"), ("other", "d1", 1, [0.5, 0.6], "a")],
        "text string, doc_id string, pos int, embedding array<float>, source string").withColumn("chunk_id", F.md5("text"))
    crow = coll.to_collection_rows(rows)
    assert coll.collection_add(spark, scratch, "c", crow) == 2
    assert coll.collection_add(spark, scratch, "c", crow) == 0           # second ingest inserts nothing
    coll.open_collection(spark, scratch, "c")                             # re-open keeps the rows
    got = {r.text: r.metadata["source"] for r in coll.open_collection(spark, scratch, "c").collect()}
    assert got == {"same text": "a", "other": "a"}                       # least (doc_id, pos) won


def _hits(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "p1", 0.1, "s1"), (1, 1, 2, "p2", 0.2, "s2"), (1, 2, 1, "p2", 0.05, "s2"), (1, 2, 2, "p3", 0.3, "s3")],
        "query_id int, hop int, rank int, passage_id string, score double, source string")


def test_dedup_first_keeps_earliest_hop(spark):
    d = {r.passage_id: (r.hop, r.rank) for r in R.dedup_first(_hits(spark)).collect()}
    assert d == {"p1": (1, 1), "p2": (1, 2), "p3": (2, 2)}


def test_attach_source_modes(spark):
    dd = R.dedup_first(_hits(spark))
    score = F.when(F.col("passage_id") == "p3", 3.0).when(F.col("passage_id") == "p1", 2.0).otherwise(1.0)
    rr = R.rerank(dd, score, k=10)
    by_id = {r.passage_id: r.source for r in R.attach_source(rr, dd, "by_id").collect()}
    pos = {r.passage_id: r.source for r in R.attach_source(rr, dd, "positional").collect()}
    assert by_id == {"p1": "s1", "p2": "s2", "p3": "s3"}
    assert pos == {"p3": "s1", "p1": "s2", "p2": "s3"}                   # zipped by position: mis-credited


def test_knn_small_corpus_and_paths_agree(spark):
    import random
    rnd = random.Random(1)
    vecs = [(i, [rnd.random() for _ in range(8)]) for i in range(60)]
    p = spark.createDataFrame(vecs, "passage_id long, embedding array<double>")
    q = spark.createDataFrame(vecs[:7], "query_id long, embedding array<double>")
    a = knn_topk(q, p, k=100, force_path="broadcast").collect()
    assert len(a) == 7 * 60                                              # k above the corpus size: all passages
    for metric in ("l2sq", "cosine", "ip"):
        b1 = sorted(tuple(r) for r in knn_topk(q, p, k=5, metric=metric, force_path="broadcast").collect())
        b2 = sorted(tuple(r) for r in knn_topk(q, p, k=5, metric=metric, force_path="blocks", block_bytes=512).collect())
        assert b1 == b2


def test_knn_tiles_merge_exactly():
    import numpy as np
    import pandas as pd
    from docloom.operators import knn as K
    rng = np.random.default_rng(5)
    P = rng.random((50, 4))
    pdf = pd.DataFrame({"passage_id": np.arange(50), "embedding": list(P), "text": [f"t{i}" for i in range(50)]})
    Q = P[:9]
    qids = np.arange(9)
    key = lambda df: sorted(map(tuple, df[["query_id", "passage_id", "score", "text"]].values.tolist()))
    whole = K._merge_topk([K._block_topk(qids, Q, pdf, "passage_id", "embedding", ["text"], 7, "l2sq", True)], 7)
    for tile in (12, 49, 60):                   # many query and passage tiles
        tiled = K._tiled_topk(qids, Q, pdf, "passage_id", "embedding", ["text"], 7, "l2sq", True, tile=tile)
        assert key(tiled) == key(whole)


def test_parse_fenced_json(spark):
    replies = ['```json\n{"verdict": "1"}\n```', '```{"verdict": 1}```', '```json\n{"verdict": "-1"}```',
               '```json\n{"verdict": "clarté"}\n```', '```json\n{"verdict": 1, ']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, reply string")
    got = [(r.verdict, r.json_ok) for r in G.parse_fenced_json(df, "reply", int_fields=("verdict",)).orderBy("id").collect()]
    assert got == [(1, True), (1, True), (-1, True), (None, True), (None, False)]


def test_select_contexts_ignores_out_of_range(spark):
    df = spark.createDataFrame([(["c1", "c2"], [1, 9])], "contexts array<string>, idx array<int>")
    assert df.select(TS.select_contexts("contexts", "idx")).first()[0] == ["c1"]


def test_build_requests_temperature_floor_and_sampling(spark):
    df = spark.createDataFrame([(1, "p", {"temperature": "0.01", "n": "2"})], "request_id int, prompt string, params map<string,string>")
    p = G.build_requests(df, "prompt", "params").first().parameters
    assert float(p["temperature"]) == 0.1 and p["do_sample"] == "true" and p["details"] == "true"
    assert p["num_return_sequences"] == "2" and p["best_of"] == "2" and "n" not in p
    msg = spark.createDataFrame([(1, [("user", "hello"), ("assistant", "x")])],
                                "request_id int, prompt array<struct<role:string,content:string>>")
    assert G.build_requests(msg, "prompt", None).first().inputs == "hello"


def test_parse_completions(spark):
    raw = json.dumps({"generated_text": "PROMPT answer", "details": {"best_of_sequences": [{"generated_text": "b"}]}})
    df = spark.createDataFrame([(1, raw, "PROMPT"), (2, "{broken", "x")], "request_id int, raw string, prompt string")
    got = sorted((r.request_id, r.choice, r.text, r.error) for r in G.parse_completions(df, "raw", "prompt", True).collect())
    assert got == [(1, 0, " answer", None), (1, 1, "b", None), (2, None, None, "invalid JSON response")]


def test_validate_messages(spark):
    df = spark.createDataFrame([("system", "m", "stream"), ("bot", "m", "done"), ("you", "m", "start")],
                               "sender string, message string, type string")
    ok, bad = CH.split_valid(df)
    assert ok.count() == 1 and bad.count() == 2


def test_chat_event_expand_error_without_reply(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a\nb"), (1, 2, "user", "q2")],
                                  "conv_id long, turn long, role string, text string")
    src = spark.createDataFrame([(1, 0, 1, "doc A")], "conv_id long, turn long, rank int, source string")
    ev = CH.chat_event_expand(turns, src, "https://x/?q=").orderBy("turn", "seq").collect()
    first = [(e.sender, e.type, e.message) for e in ev if e.turn == 0]
    assert first == [("you", "stream", "q1"), ("bot", "start", ""), ("bot", "stream", "a<br>b"), ("bot", "end", ""),
                     ("bot", "sources", "doc A")]
    second = [(e.sender, e.type) for e in ev if e.turn == 2]
    assert second == [("you", "stream"), ("bot", "start"), ("bot", "error")]


def test_pack_sequences_spans(spark):
    df = spark.createDataFrame([("a", "1", 5), ("b", "2", 25), ("c", "3", 4)], "id string, ord string, n long")
    spans = sorted(tuple(r) for r in S.pack_sequences(df, "id", "ord", "n", block_len=10).collect())
    # tokens: a 0-5, b 5-30, c 30-34 ; blocks of 10, last partial block (30-34) dropped
    assert spans == [(0, "a", 0, 5), (0, "b", 0, 5), (1, "b", 5, 15), (2, "b", 15, 25)]


def test_exact_split_single_row(spark):
    df = spark.createDataFrame([("only",)], "id string")
    assert [r.split for r in S.train_test_split(df, "id", 0.01, 42, "exact").collect()] == ["test"]


def test_exact_split_is_exact(spark):
    df = spark.range(0, 1234).select(F.col("id").cast("string").alias("id"))
    out = S.train_test_split(df, "id", 0.05, 7, "exact")
    assert out.where("split = 'test'").count() == 62
    keys = sorted((r.k, r.split) for r in out.select(F.md5(F.concat(F.lit("7:"), "id")).alias("k"), "split").collect())
    assert all(s == "test" for _, s in keys[:62]) and all(s == "train" for _, s in keys[62:])


def test_near_dups_against_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat sat on a mat", "the cat sat on the mat", "dogs bark loudly at night",
             "dogs bark loudly at night today", "completely different words here", "the cat sat on the mat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted(tuple(r) for r in TS.question_near_dups(df, "id", "text", 0.7).collect())
    strings = sorted(tuple(r) for r in TS.question_near_dups(df, "id", "text", 0.7, hash_payload=False).collect())
    assert got == strings
    sets = [set(t.split()) for t in texts]
    reps = {}
    for i, s in enumerate(sets):
        reps.setdefault(frozenset(s), i)
    exp = [(reps[frozenset(s)], i, 1.0) for i, s in enumerate(sets) if reps[frozenset(s)] != i]
    rl = sorted(set(reps.values()))
    for x in rl:
        for y in rl:
            if x < y:
                j = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
                if j >= 0.7:
                    exp.append((x, y, round(j, 6)))
    assert got == sorted(exp)


def test_quotas_largest_remainder():
    assert TS.quotas(10, TS.DEFAULT_SHARES) == [("simple", 4), ("reasoning", 2), ("multi_context", 2), ("conditional", 2)]
    assert sum(n for _, n in TS.quotas(7, TS.DEFAULT_SHARES)) == 7


def test_response_cache_round_trip(spark, scratch):
    import os
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "request_id int, payload string")
    cache_path = os.path.join(scratch, "cache")
    spark.createDataFrame([], "key string, response string").write.parquet(cache_path)
    calls = []

    def gen(todo):
        calls.append(todo.count())
        return todo.select("key", F.concat(F.lit("r:"), "payload").alias("response"))

    first = G.cached_generate(req, spark.read.parquet(cache_path), gen)
    assert sorted((r.request_id, r.response, r.from_cache) for r in first.collect()) == \
        [(1, "r:a", False), (2, "r:b", False), (3, "r:a", False)]
    G.append_cache(first, cache_path)
    second = G.cached_generate(req, spark.read.parquet(cache_path), gen)
    assert all(r.from_cache for r in second.collect())
    assert calls[0] == 2                      # identical requests were generated once


def test_spread_only_when_input_is_narrow(spark):
    from docloom.session import spread
    wide = spark.range(0, 1000, numPartitions=spark.sparkContext.defaultParallelism * 4)
    assert spread(wide) is wide                                         # enough splits already: no shuffle added
    narrow = spark.range(0, 1000, numPartitions=1)
    assert spread(narrow).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_text_after_marker_default(spark):
    from docloom.operators.clean import text_after_marker
    df = spark.createDataFrame([("Lettre. Objet : inspection du site\nSuite",), ("pas de marqueur",)], "text string")
    got = [(r.text, r.matched) for r in text_after_marker(df).collect()]
    assert got == [("inspection du site\nSuite", True), ("pas de marqueur", False)]


def test_chat_history_pairs(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2")],
                                  "conv_id long, turn long, role string, text string")
    got = sorted((r.idx, r.question, r.answer) for r in CH.chat_history_pairs(turns, greeting="hi").collect())
    assert got == [(0, "", "hi"), (1, "q1", "a1")]


def test_local_backend_sampling_follows_the_call(spark):
    df = spark.createDataFrame([(1, "p", {"n": "1"}), (2, "p", {"temperature": "0.5"}), (3, "p", {"n": "3", "model": "m"})],
                               "request_id int, prompt string, params map<string,string>")
    # defaults ask for a high temperature, but only the call's own settings decide sampling
    out = {r.request_id: r.parameters for r in
           G.build_requests(df, "prompt", "params", defaults={"temperature": "0.9", "max_tokens": "10"}, backend="local").collect()}
    assert "do_sample" not in out[1] and out[1]["temperature"] == "0.9" and out[1]["max_new_tokens"] == "10"
    assert out[2]["do_sample"] == "true" and out[2]["temperature"] == "0.5"
    assert out[3]["do_sample"] == "true" and out[3]["num_return_sequences"] == "3" and "model" not in out[3]


def test_pack_sequences_two_level_prefix_sum_matches_one_bucket(spark):
    import random
    rnd = random.Random(11)
    rows = [(f"s{i}", None, rnd.randint(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, ord string, n long").withColumn("ord", F.md5("id"))
    one = sorted(tuple(r) for r in S.pack_sequences(df, "id", "ord", "n", 256, rows_per_bucket=10_000).collect())
    many = sorted(tuple(r) for r in S.pack_sequences(df, "id", "ord", "n", 256, rows_per_bucket=7).collect())
    assert one == many and len(one) > 0
    total = sum(n for _, _, n in rows)
    assert sum(t - f for _, _, f, t in one) == (total // 256) * 256           # full blocks, no gap or overlap
