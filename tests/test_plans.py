"""Plan assertions: the optimizer does the work we rely on at scale."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from docloom.operators.knn import knn_topk
from docloom.plans.registry import QUERIES
from docloom.session import read_table
from docloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_queries_do_not_read_vectors_and_push_filters(spark):
    d = read_table(spark, SF, "documents", spread_rows=False).where(F.col("lang") == "fr").select("doc_id", "text")
    p = _plan(d)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    labels = _plan(FX.vectors(spark, SF).where("label = 1").select("passage_id"))
    assert "embedding" not in labels.split("ReadSchema:")[1].split("\n")[0] and "EqualTo(label,1)" in labels


def test_only_ids_and_scores_go_through_the_top_k(spark):
    v = FX.vectors(spark, SF).withColumn("text", F.lit("t"))
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    p = _plan(knn_topk(q, v, k=5, carry=["text", "embedding"]))
    window = p[p.index("WindowGroupLimit"):]
    exchange = window[window.index("Exchange"):]
    assert "Exchange hashpartitioning(query_id" in exchange
    below = exchange.split("MapInPandas")[0]
    assert "embedding" not in below and "text" not in below

def test_knn_has_partial_topk_and_no_pair_join(spark):
    v = FX.vectors(spark, SF)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    p = _plan(knn_topk(q, v, k=5))
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_registered_query_plans_a_cartesian_product(spark):
    skip = {"collection_add", "write_clean_text", "stream_ingest", "stream_dedup", "stream_rag_query"}
    for name, fn in E.queries().items():
        if name in skip or name not in QUERIES:
            continue
        p = _plan(fn(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_row_local_text_operators_do_not_shuffle(spark):
    from docloom.operators.chunk import explode_chunks, stage_chunks
    from docloom.operators.clean import clean_text
    from docloom.operators.embed import with_hash_embedding
    d = clean_text(read_table(spark, SF, "documents", ["doc_id", "text"], spread_rows=False))
    for df in (explode_chunks(stage_chunks(d)), explode_chunks(stage_chunks(d, engine="sql")), with_hash_embedding(d)):
        p = _plan(df)
        assert "Exchange" not in p, p[:2000]


def test_flagship_has_one_exchange_after_the_hops(spark):
    p = _plan(E.queries()["rag_retrieve"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1
