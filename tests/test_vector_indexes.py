"""Coded index, neighbour graph, components, duplicate classes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import coded as C
from docloom.operators.ann import build_index, recall_at_k
from docloom.operators.components import components
from docloom.operators.knn import knn_topk
from docloom.operators.neighbor_graph import neighbor_graph
from docloom.operators.retrieve import search
from docloom.operators.testset import multi_context_pairs, question_dup_classes
from docloom.sources import committed as CT

SCHEMA = "passage_id bigint, embedding array<float>"


def clustered(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d)) * 3
    return (centres[np.arange(n) % 20] + rng.standard_normal((n, d))).astype(np.float32)


@pytest.fixture(scope="module")
def passages(spark):
    x = clustered(1200)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, x[0].tolist()), (5001, None)]       # an equal vector, none
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def asked(passages, share=10):
    return passages.where(F.pmod("passage_id", F.lit(share)) == 0).select(F.col("passage_id").alias("query_id"), "embedding")


def test_coded_search_is_exact_in_scores_and_finds_most(spark, passages, scratch):
    index = C.build_coded_index(passages, f"{scratch}/ix", leaves=30)
    assert 20 <= len(index.model.leaves) <= 36 and len(index.model.books) == 8
    q = asked(passages)
    exact = knn_topk(q, passages, k=10)
    got = index.topk(q, 10, nprobe=6)
    assert recall_at_k(got, exact).agg(F.avg("recall")).first()[0] >= 0.9
    wrong = got.join(exact.withColumnRenamed("score", "s"), ["query_id", "passage_id"]).where("abs(score - s) > 1e-9")
    assert wrong.count() == 0
    everything = sorted(map(tuple, C.coded_topk(q, index, 10, nprobe=99, rerank=2000, block_rows=7).select("query_id", "passage_id", "score", "rank").collect()))
    assert everything == sorted(map(tuple, exact.select("query_id", "passage_id", "score", "rank").collect()))
    one = C.coded_topk(q, index, 1, nprobe=99, rerank=2000, exclude_self=True)
    assert one.where("query_id = passage_id").count() == 0 and one.where("query_id = 0").first().passage_id == 5000


def test_a_search_opens_the_probed_cells_alone(spark, passages, scratch):
    index = C.build_coded_index(passages, f"{scratch}/ix", leaves=30)
    files = C._files(index, set(range(len(index.model.top))))
    near = index.model.probes(clustered(1200)[:1].astype(float), 3)[0]
    assert 0 < len(C._files(index, {int(index.model.leaf_top[x]) for x in near})) < len(files)


def test_inserts_without_a_refit(spark, passages, scratch):
    first, rest = passages.where("passage_id % 3 <> 0"), passages.where("passage_id % 3 = 0")
    C.build_coded_index(first, f"{scratch}/ix", leaves=25)
    index = C.open_coded_index(spark, f"{scratch}/ix")
    before = index.model.leaves.copy()
    n = rest.where("embedding is not null").count()
    assert C.insert(index, rest, part="rest") == n
    assert C.insert(index, rest, part="rest") == n and CT.read_table(spark, index.vectors).count() == 1201       # the same batch again
    assert (index.model.leaves == before).all()
    q = asked(passages)
    got = C.coded_topk(q, index, 5, nprobe=99, rerank=2000).select("query_id", "passage_id", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn_topk(q, passages, k=5).select("query_id", "passage_id", "rank").collect()))


def test_odd_tables_and_searches(spark, passages, scratch):
    none = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="there are none"):
        C.build_coded_index(none, f"{scratch}/none")
    index = C.build_coded_index(passages.where("passage_id < 3"), f"{scratch}/three", parts=3)
    assert index.topk(none.withColumnRenamed("passage_id", "query_id"), 5).count() == 0
    got = index.topk(asked(passages, 300), 5).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {3}                     # fewer passages than asked for


def test_search_takes_any_index(spark, passages, scratch):
    docs = passages.withColumn("text", F.col("passage_id").cast("string"))
    q = asked(passages, 100)
    rows = lambda df: sorted((r.query_id, r.passage_id, r["rank"], r.text) for r in df.collect())
    exact = rows(search(q, docs, 4, ["text"]))
    assert rows(search(q, docs, 4, ["text"], index=C.build_coded_index(docs, f"{scratch}/a", leaves=9), nprobe=99, rerank=2000)) == exact
    assert rows(search(q, docs, 4, ["text"], index=build_index(docs, cells=9), nprobe=9)) == exact
    with pytest.raises(ValueError, match="squared L2"):
        search(q, docs, 4, [], index=build_index(docs, cells=2), metric="cosine")


def test_lloyd_centroids():
    x = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)) * 9, [[5.0, 0.0]]])
    assert len(C.lloyd(x, 10)) == 3 and len(C.lloyd(x[:1], 4)) == 1         # no more than distinct rows
    c = C.lloyd(clustered(2000, 4).astype(float), 20)
    assert len(np.unique(C._nearest(clustered(2000, 4).astype(float), c))) == 20


def test_graph_finds_nearest_and_compares_few(spark, passages):
    graph, compared = neighbor_graph(passages, k=10)
    n = 1201
    assert compared < 0.6 * n * (n - 1) / 2
    exact = {r.query_id: r.score for r in knn_topk(passages.withColumnRenamed("passage_id", "query_id"), passages, k=1, exclude_self=True).collect()}
    rows = graph.collect()
    near = {r.id: r for r in rows if r["rank"] == 1}
    assert set(near) == set(exact) and np.mean([near[i].score <= exact[i] + 1e-9 for i in exact]) >= 0.9
    assert near[0].neighbor == 5000 and near[0].score == 0
    assert all(r.id != r.neighbor for r in rows) and max(r["rank"] for r in rows) == 10
    x = {i: v for i, v in enumerate(clustered(1200).astype(float))} | {5000: clustered(1200)[0].astype(float)}
    assert all(abs(((x[r.id] - x[r.neighbor]) ** 2).sum() - r.score) < 1e-6 for r in rows[:200])
    pairs = multi_context_pairs(passages, graph=True, k=10)
    assert pairs.columns == ["context1", "context2", "score"] and pairs.count() == n


def test_graph_of_few_or_equal_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    assert neighbor_graph(one)[0].count() == 0 and neighbor_graph(one.limit(0))[0].count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], SCHEMA)
    graph, compared = neighbor_graph(same, k=5)
    assert graph.where("rank = 1 and score = 0").count() == 300 and compared < 300 * 299 / 2


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(900, i) for i in range(100, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 1)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges + edges[:9], "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 140), 900]}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_classes(texts, t):
    sets = {i: frozenset(x.lower().split()) for i, x in texts.items() if x}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    members = {}
    for i in texts:
        members.setdefault(top(i), []).append(i)
    return {i: (c, len(m), max(1, len({sets.get(x, x) for x in m}))) for c, m in members.items() for i in m}


@pytest.mark.parametrize("t", [0.8, 0.5])
def test_duplicate_classes_against_brute_force(spark, t):
    rng = random.Random(int(t * 10))
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.sample(words, rng.randint(1, 12))) for i in range(150)}
    template = [f"t{i}" for i in range(20)]
    texts |= {200 + i: " ".join(template + [f"name{i}"]) for i in range(100)}               # a template in a third of all rows
    texts |= {400 + i: " ".join(template[: 20 - i] + [f"x{j}" for j in range(i)]) for i in range(12)}      # a chain away from it
    texts |= {500: None, 501: "", 502: "!!!", 503: texts[3], 504: texts[3].upper()}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string").repartition(4)
    want = brute_classes({i: (x if x and x != "!!!" else "") for i, x in texts.items()}, t)
    assert {r.id: (r.class_id, r.n_rows, r.n_texts) for r in question_dup_classes(df, "id", "text", t).collect()} == want


def test_a_template_costs_rows_in_proportion(spark, monkeypatch):
    from docloom.operators import testset as TS
    made = {}
    write = TS.materialize
    monkeypatch.setattr(TS, "materialize", lambda df, name="stage": made.setdefault(name, []).append(write(df, name)) or made[name][-1])
    rows = {}
    for n in (200, 800):
        made.clear()
        df = spark.range(n).select("id", F.concat(F.lit("one two three four five six seven eight nine ten name"), F.col("id")).alias("text"))
        got = TS.question_dup_classes(df, "id", "text", 0.8)
        assert got.select("class_id", "n_rows").distinct().collect() == [(0, n)]
        rows[n] = max(d.count() for ds in made.values() for d in ds)
    assert rows[800] <= 4.5 * rows[200]
