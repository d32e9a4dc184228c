"""Registered queries: retrieval stages, sinks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import collection as coll
from docloom.operators import metrics as MET
from docloom.operators.ann import ann_topk
from docloom.operators.knn import knn_topk
from docloom.operators.retrieve import (assemble_context, attach_source, dedup_first, multi_hop_retrieve,
                                        rerank_maxsim)
from docloom.plans.ingest import chunk_corpus, passages_from_staged, rows_to_add
from docloom.plans.rag import retrieve_hits
from docloom.plans.registry import _passages, register
from docloom.plans.sqlparts import FILE, chunk_ctes, clean, hops_ctes, l2sq, maxsim, passages_ctes, suffix_label
from docloom.session import materialize, read_table, scratch
from docloom.sources import committed as CT
from docloom.sources import fixtures as FX


VEC = "vq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings), vp AS (SELECT vec_id AS passage_id, embedding, 'label-' || label AS source FROM embeddings)"


def _vec_hits(spark, sf) -> DataFrame:
    v = FX.vectors(spark, sf).withColumn("source", F.concat(F.lit("label-"), F.col("label").cast("string")))
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    return multi_hop_retrieve(q, v, max_hops=2, k=20, carry=["source"])


@register("multi_hop_retrieve", f"WITH {VEC}, {hops_ctes('vq', 'vp')} SELECT query_id, hop, rank, passage_id, score FROM h_all")
def q_multi_hop(spark, sf):
    return _vec_hits(spark, sf).select("query_id", "hop", F.col("rank").cast("int").alias("rank"), "passage_id", "score")


DEDUP_SQL = f"""WITH {VEC}, {hops_ctes('vq', 'vp')},
dd AS (SELECT * FROM h_all QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY hop, rank) = 1)"""


@register("dedup_first", DEDUP_SQL + " SELECT query_id, passage_id, hop, rank FROM dd")
def q_dedup(spark, sf):
    return dedup_first(_vec_hits(spark, sf).drop("embedding")).select(
        "query_id", "passage_id", "hop", F.col("rank").cast("int").alias("rank"))


def _reranked(spark, sf):
    hits = dedup_first(_vec_hits(spark, sf).drop("embedding"))
    toks = FX.token_matrices(spark, sf)
    j = (hits.join(toks.select(F.col("id").alias("query_id"), F.col("toks").alias("q_toks")), "query_id")
         .join(toks.select(F.col("id").alias("passage_id"), F.col("toks").alias("p_toks")), "passage_id"))
    return hits, rerank_maxsim(j, "q_toks", "p_toks", k=10)


RERANK_SQL = DEDUP_SQL + f""",
rr AS (SELECT dd.query_id, dd.passage_id, dd.hop, dd.rank, p.source, round({maxsim('q.v', 'p.embedding')}, 6) AS rerank_score
       FROM dd JOIN vq q USING (query_id) JOIN vp p USING (passage_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, passage_id) AS rerank_pos FROM rr)"""


@register("rerank_maxsim", RERANK_SQL + " SELECT query_id, CAST(rerank_pos AS INTEGER) AS rerank_pos, passage_id, rerank_score FROM rk WHERE rerank_pos <= 10")
def q_rerank(spark, sf):
    _, rr = _reranked(spark, sf)
    return rr.select("query_id", F.col("rerank_pos").cast("int").alias("rerank_pos"), "passage_id", "rerank_score")


@register("attach_source", RERANK_SQL + """,
pos AS (SELECT dd.query_id, p.source, row_number() OVER (PARTITION BY dd.query_id ORDER BY dd.hop, dd.rank) AS ctx_pos
        FROM dd JOIN vp p USING (passage_id))
SELECT rk.query_id, CAST(rk.rerank_pos AS INTEGER) AS rerank_pos, rk.passage_id, rk.source AS source_by_id, pos.source AS source_positional
FROM rk JOIN pos ON pos.query_id = rk.query_id AND pos.ctx_pos = rk.rerank_pos WHERE rk.rerank_pos <= 10""")
def q_attach_source(spark, sf):
    hits, rr = _reranked(spark, sf)
    by_id = attach_source(rr, hits, "by_id").select("query_id", "rerank_pos", "passage_id", F.col("source").alias("source_by_id"))
    pos = attach_source(rr, hits, "positional").select("query_id", "rerank_pos", F.col("source").alias("source_positional"))
    return by_id.join(pos, ["query_id", "rerank_pos"]).select(
        "query_id", F.col("rerank_pos").cast("int").alias("rerank_pos"), "passage_id", "source_by_id", "source_positional")


def _assemble_sql() -> str:
    from docloom.plans.sqlparts import embed_ctes
    return f"""WITH {passages_ctes()},
qb AS (SELECT item_id AS query_id, 'query: ' || text AS qtext FROM benchmark),
{embed_ctes('qb', 'query_id', 'qtext', 'qe')},
q0 AS (SELECT query_id, embedding AS v FROM qe_vec),
{hops_ctes('q0', 'psg')},
dd AS (SELECT * FROM h_all QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY hop, rank) = 1)
SELECT dd.query_id, CAST(row_number() OVER (PARTITION BY dd.query_id ORDER BY hop, rank) AS INTEGER) AS ctx_pos, p.text
FROM dd JOIN psg p USING (passage_id)"""


@register("assemble_context", _assemble_sql())
def q_assemble_context(spark, sf):
    hits = dedup_first(retrieve_hits(FX.questions(spark, sf), _passages(spark, sf)).drop("embedding"))
    ctx = assemble_context(hits, "text")
    return ctx.select("query_id", F.posexplode_outer("contexts").alias("p", "text")).where(F.col("p").isNotNull()) \
        .select("query_id", (F.col("p") + 1).cast("int").alias("ctx_pos"), "text")


@register("ann_topk")
def q_ann(spark, sf):
    v = FX.vectors(spark, sf)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    return ann_topk(q, v, k=20, nprobe=4).select("query_id", "passage_id", "rank", "score")


# ---------------------------------------------------------------- sinks
CD = f"cd AS (SELECT {FILE} AS file, md5({FILE}) AS doc_id, {suffix_label(FILE)} AS source, split_part({FILE}, '.', 1) AS stem, {clean('text')} AS text FROM documents)"


@register("scan_text_corpus", f"SELECT {FILE} AS file, text FROM documents WHERE text IS NOT NULL")
def q_scan_text_corpus(spark, sf):
    from docloom.sources.corpus import scan_text_corpus, write_text_corpus
    path = scratch(spark, "text-corpus")
    # one text file per document (a folder per file name), as a corpus folder on shared storage
    write_text_corpus(FX.corpus(spark, sf).where(F.col("text").isNotNull()), path)
    return scan_text_corpus(spark, path, name_dir="file")


@register("write_clean_text", f"WITH {CD} SELECT stem, text FROM cd")
def q_write_clean_text(spark, sf):
    from docloom.operators.clean import prepare_corpus
    path = scratch(spark, "clean-text")
    coll.write_clean_text(prepare_corpus(FX.corpus(spark, sf)), path)
    return spark.read.parquet(path)


#: Deliveries that overlap: most documents come two or three times, in another company each time.
DELIVERIES = (("first", "lang <> 'es'"), ("second", "lang <> 'fr'"), ("third", "true"))
CHUNKS_SQL = f"""WITH cdl AS (SELECT md5({FILE}) AS doc_id, {suffix_label(FILE)} AS source, lang, {clean('text')} AS text FROM documents),
{chunk_ctes('cdl', 'doc_id, source, lang')},
dl AS (SELECT *, md5(text) AS chunk_id, CASE WHEN lang <> 'es' THEN 1 WHEN lang <> 'fr' THEN 2 ELSE 3 END AS came FROM ck_out)"""


def _deliver(spark, sf, root, **kw) -> list[tuple]:
    """Ingest the deliveries, and the last one again; (batch, inserted, total) of each."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "source", "lang"])
    coll.open_collection(spark, root, "docs")
    out = []
    for batch, which in (*DELIVERIES, ("again", "true")):
        coll.open_collection(spark, root, "docs")          # a second open must not lose anything
        staged = materialize(chunk_corpus(FX.corpus_of(docs.where(which))))
        rows, _, embed = rows_to_add(staged)
        n = coll.collection_add(spark, root, "docs", rows, embed=embed, **kw)
        out.append((batch, n, coll.open_collection(spark, root, "docs").count()))
    return out


@register("collection_add", CHUNKS_SQL + """, u AS (SELECT chunk_id, min(came) AS came FROM dl GROUP BY chunk_id),
o AS (SELECT * FROM (VALUES ('first', 1), ('second', 2), ('third', 3), ('again', 4)) v(batch, i))
SELECT batch, count(*) FILTER (came = i) AS inserted, count(*) FILTER (came <= i) AS total FROM o, u GROUP BY batch, i""")
def q_collection_add(spark, sf):
    return spark.createDataFrame(_deliver(spark, sf, scratch(spark, "collections")), "batch string, inserted bigint, total bigint")


@register("collection_merged", CHUNKS_SQL + """
SELECT chunk_id, text, source FROM dl QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY came, doc_id, pos) = 1""")
def q_collection_merged(spark, sf):
    """The collection after its parts have been merged and what they replace has been deleted."""
    root = scratch(spark, "collections")
    _deliver(spark, sf, root, file_rows=500, fan=2)
    CT.vacuum(f"{root}/docs")
    return coll.open_collection(spark, root, "docs").select("chunk_id", "text", F.col("metadata")["source"].alias("source"))


@register("collection_rows", f"""WITH {passages_ctes()}
SELECT passage_id AS chunk_id, text, source, doc_id, CAST(pos AS INTEGER) AS pos FROM psg""")
def q_collection_rows(spark, sf):
    rows = coll.to_collection_rows(passages_from_staged(chunk_corpus(FX.corpus(spark, sf))))
    return coll.first_per_chunk(rows).select("chunk_id", "text", F.col("metadata")["source"].alias("source"), "doc_id", "pos")


@register("failed_documents", f"""WITH {CD},
w AS (SELECT file, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM cd)
SELECT file, 'word over token budget' AS reason FROM w WHERE list_max(list_transform(ws, lambda x: greatest(1, ceil(length(x) / 4))::INTEGER)) > 4""")
def q_failed(spark, sf):
    staged = chunk_corpus(FX.corpus(spark, sf), budget=4)
    return staged.where(F.col("fail_reason").isNotNull()).select("file", F.col("fail_reason").alias("reason"))


@register("ingest_report", f"""WITH {CD},
w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM cd),
bad AS (SELECT count(*) AS n FROM w WHERE list_max(list_transform(ws, lambda x: greatest(1, ceil(length(x) / 4))::INTEGER)) > 510),
{chunk_ctes('cd', 'doc_id, source')}
SELECT (SELECT count(*) FROM documents) AS files_seen, (SELECT n FROM bad) AS files_failed, (SELECT count(*) FROM ck_out) AS chunks_written""")
def q_ingest_report(spark, sf):
    return coll.ingest_report(chunk_corpus(FX.corpus(spark, sf)))


# ---------------------------------------------------------------- metrics
def _label_hits(spark, sf):
    v = FX.vectors(spark, sf)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    hits = knn_topk(q, v, k=10, exclude_self=True)
    lab = v.select("passage_id", "label")
    return (hits.join(lab, "passage_id").join(lab.withColumnRenamed("passage_id", "query_id").withColumnRenamed("label", "qlabel"), "query_id")
            .withColumn("relevant", (F.col("label") == F.col("qlabel")).cast("int")))


LABEL_HITS_SQL = f"""WITH d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score,
         CAST(a.label = b.label AS INTEGER) AS relevant
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM d QUALIFY rank <= 10),
pr AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rank AS prec FROM h)"""


@register("context_precision", LABEL_HITS_SQL + """
SELECT query_id, round(CASE WHEN sum(relevant) > 0 THEN sum(prec * relevant) / sum(relevant) ELSE 0.0 END, 9) AS context_precision
FROM pr GROUP BY query_id""")
def q_context_precision(spark, sf):
    return MET.context_precision(_label_hits(spark, sf))


LAB_DOCS = "ld AS (SELECT d.source, d.doc_id, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"


@register("context_recall", f"WITH {LAB_DOCS} SELECT source AS query_id, round(avg(CAST(quality = 1 AS DOUBLE)), 9) AS context_recall FROM ld GROUP BY source")
def q_context_recall(spark, sf):
    ld = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents", ["doc_id", "source"]), "doc_id")
    return MET.context_recall(ld.select(F.col("source").alias("query_id"), (F.col("quality") == 1).alias("supported")))


@register("faithfulness", f"WITH {LAB_DOCS} SELECT source AS answer_id, round(avg(CAST(toxic = 0 AS DOUBLE)), 9) AS faithfulness FROM ld GROUP BY source")
def q_faithfulness(spark, sf):
    ld = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents", ["doc_id", "source"]), "doc_id")
    return MET.faithfulness(ld.select(F.col("source").alias("answer_id"), (F.col("toxic") == 0).alias("supported")))


@register("answer_relevancy", f"""WITH d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score, a.embedding AS qv, b.embedding AS gv
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
h AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= 3)
SELECT query_id, round(avg(list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(gv[i] AS DOUBLE)))
   / (sqrt(list_sum(list_transform(qv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(gv, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))), 9) AS answer_relevancy
FROM h GROUP BY query_id""")
def q_answer_relevancy(spark, sf):
    v = FX.vectors(spark, sf)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    hits = knn_topk(q, v, k=3, exclude_self=True, carry=["embedding"]).withColumnRenamed("embedding", "g_vec")
    pairs = hits.join(q.withColumnRenamed("embedding", "q_vec"), "query_id")
    return MET.answer_relevancy(pairs)
