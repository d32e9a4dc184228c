"""Registered queries: evaluation-set construction."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docloom.operators import testset as TS
from docloom.operators.collection import publish_testset
from docloom.operators.chunk import chunk_documents
from docloom.operators.clean import clean_text
from docloom.plans.q_generation import VERDICT_SQL, _verdict_replies
from docloom.operators.knn import knn_topk
from docloom.operators.retrieve import assemble_context
from docloom.plans.rag import embed_questions
from docloom.plans.registry import _passages, register
from docloom.plans.sqlparts import chunk_ctes, clean, embed_ctes, l2sq, passages_ctes
from docloom.session import read_table, scratch
from docloom.sources import fixtures as FX
from docloom.sources.committed import read_table as read_committed

TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"

KEYPHRASE_SQL = f"""t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT doc_id, term, round(tf * ln((SELECT count(*) FROM documents) / df), 9) AS score FROM tf JOIN dfq USING (term)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 5)"""


@register("keyphrases", f"""WITH {KEYPHRASE_SQL}
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, score, count(*) OVER (PARTITION BY doc_id) < 3 AS too_few FROM top""")
def q_keyphrases(spark, sf):
    return TS.keyphrases(read_table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text", 5)


def _score_replies(spark, sf):
    lab = read_table(spark, sf, "labels")
    body = F.concat(F.lit('{"clarity": '), (F.col("quality") + 1).cast("string"), F.lit(', "depth": "2", "structure": '),
                    F.when(F.col("toxic") == 1, F.lit('"clarté"')).otherwise(F.lit("3")), F.lit(', "relevance": '),
                    F.when(F.col("quality") == 0, F.lit("4")).otherwise(F.lit('"1"')), F.lit("}"))
    return lab.select("doc_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))


SCORE_SQL = """sr AS (SELECT doc_id, '```json' || chr(10) || '{"clarity": ' || CAST(quality + 1 AS VARCHAR) || ', "depth": "2", "structure": '
   || CASE WHEN toxic = 1 THEN '"clarté"' ELSE '3' END || ', "relevance": ' || CASE WHEN quality = 0 THEN '4' ELSE '"1"' END || '}'
   || chr(10) || '```' AS reply FROM labels),
sp AS (SELECT doc_id, regexp_extract(reply, '(?s)(\\{.*\\})', 1) AS j FROM sr),
sv AS (SELECT doc_id, list_transform(['clarity', 'depth', 'structure', 'relevance'],
   lambda f: CASE WHEN TRY_CAST(json_extract_string(j, '$.' || f) AS INTEGER) BETWEEN 1 AND 3 THEN TRY_CAST(json_extract_string(j, '$.' || f) AS INTEGER) END) AS v FROM sp)"""


@register("context_score_filter", f"""WITH {SCORE_SQL}
SELECT doc_id, v[1] AS clarity, v[2] AS depth, v[3] AS structure, v[4] AS relevance,
  CASE WHEN len(list_filter(v, lambda x: x IS NOT NULL)) > 0 THEN list_sum(list_filter(v, lambda x: x IS NOT NULL)) / len(list_filter(v, lambda x: x IS NOT NULL)) END AS score,
  coalesce(list_sum(list_filter(v, lambda x: x IS NOT NULL)) / len(list_filter(v, lambda x: x IS NOT NULL)) >= 2.0, false) AS keep
FROM sv""")
def q_score_filter(spark, sf):
    out = TS.context_score_filter(_score_replies(spark, sf), "reply", 2.0)
    return out.select("doc_id", *TS.SCORE_FIELDS, "score", "keep")


@register("question_verdict_filter", f"""WITH {VERDICT_SQL}
SELECT doc_id, CASE WHEN json_ok THEN TRY_CAST(json_extract_string(j, '$.verdict') AS INTEGER) END AS verdict,
  coalesce(json_ok AND TRY_CAST(json_extract_string(j, '$.verdict') AS INTEGER) = 1, false) AS keep,
  CASE WHEN NOT coalesce(json_ok AND TRY_CAST(json_extract_string(j, '$.verdict') AS INTEGER) = 1, false) AND json_ok
       THEN json_extract_string(j, '$.feedback') END AS feedback FROM pj""")
def q_verdict_filter(spark, sf):
    return TS.question_verdict_filter(_verdict_replies(spark, sf), "reply").select("doc_id", "verdict", "keep", "feedback")


@register("evolution_elimination", """WITH p AS (SELECT conv_id, turn, '```json' || chr(10) || '{"reason": "r", "verdict": ' || CAST(length(text) % 2 AS VARCHAR) || '}' || chr(10) || '```' AS reply FROM conversations)
SELECT conv_id, turn, length(reply) % 2 AS x FROM p WHERE NOT coalesce(TRY_CAST(json_extract_string(regexp_extract(reply, '(?s)(\\{.*\\})', 1), '$.verdict') AS INTEGER) = 1, false)""")
def q_elimination(spark, sf):
    c = read_table(spark, sf, "conversations")
    pairs = c.select("conv_id", "turn", F.concat(F.lit('```json\n{"reason": "r", "verdict": '),
                                                 F.pmod(F.length("text"), F.lit(2)).cast("string"), F.lit("}\n```")).alias("reply"))
    return TS.evolution_elimination(pairs, "reply").select("conv_id", "turn", F.pmod(F.length("reply"), F.lit(2)).alias("x"))


@register("question_near_dups", """WITH w AS (SELECT doc_id AS id,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))) AS ws FROM documents),
s AS (SELECT id, ws, array_to_string(ws, chr(1)) AS sk FROM w WHERE len(ws) > 0),
reps AS (SELECT sk, min(id) AS rep, first(ws) AS ws FROM s GROUP BY sk),
pr AS (SELECT a.rep AS x, b.rep AS y, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) AS na, len(b.ws) AS nb FROM reps a JOIN reps b
       ON a.sk < b.sk AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws))),
near AS (SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, round(i / (na + nb - i), 6) AS jaccard FROM pr WHERE i / (na + nb - i) >= 0.8),
copies AS (SELECT r.rep AS id_a, s.id AS id_b, 1.0 AS jaccard FROM s JOIN reps r USING (sk) WHERE s.id <> r.rep)
SELECT * FROM near UNION ALL SELECT * FROM copies""")
def q_near_dups(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return TS.question_near_dups(d.withColumnRenamed("doc_id", "id"), "id", "text", 0.8)


@register("question_dup_classes", """WITH RECURSIVE w AS (SELECT doc_id AS id,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))) AS ws FROM documents),
s AS (SELECT id, ws, array_to_string(ws, chr(1)) AS sk FROM w WHERE len(ws) > 0),
reps AS (SELECT sk, min(id) AS rep, first(ws) AS ws, count(*) AS m FROM s GROUP BY sk),
pr AS (SELECT a.rep AS x, b.rep AS y FROM reps a JOIN reps b ON a.sk <> b.sk AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws))
   WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9),
r AS (SELECT rep AS node, rep AS seen FROM reps UNION SELECT r.node, pr.y FROM r JOIN pr ON pr.x = r.seen),
c AS (SELECT node AS rep, min(seen) AS class_id FROM r GROUP BY node),
k AS (SELECT class_id, sum(m)::BIGINT AS n_rows, count(*) AS n_texts FROM c JOIN reps USING (rep) GROUP BY class_id)
SELECT s.id, c.class_id, k.n_rows, k.n_texts FROM s JOIN reps ON reps.sk = s.sk JOIN c ON c.rep = reps.rep JOIN k ON k.class_id = c.class_id
UNION ALL SELECT id, id, 1, 1 FROM w WHERE ws IS NULL OR len(ws) = 0""")
def q_dup_classes(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return TS.question_dup_classes(d.withColumnRenamed("doc_id", "id"), "id", "text", 0.8)


@register("select_contexts", """WITH u AS (SELECT * FROM conversations WHERE role = 'user'),
ctx AS (SELECT u.conv_id, u.turn, list_filter([u.text, b.text, c.text], lambda x: x IS NOT NULL) AS contexts, [1 + u.turn % 3, 9, 0] AS idx
  FROM u LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn + 1
         LEFT JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 2)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(idx, lambda i: CASE WHEN i >= 1 AND i <= len(contexts) THEN contexts[i] END),
   lambda x: x IS NOT NULL), chr(1)) AS selected FROM ctx""")
def q_select_contexts(spark, sf):
    c = read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("t0"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t1"))
    d = c.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("t2"))
    ctx = (u.join(b, ["conv_id", "turn"], "left").join(d, ["conv_id", "turn"], "left")
           .select("conv_id", "turn", F.filter(F.array("t0", "t1", "t2"), lambda x: x.isNotNull()).alias("contexts"),
                   F.array(1 + F.pmod("turn", F.lit(3)), F.lit(9), F.lit(0)).cast("array<int>").alias("idx")))
    return ctx.select("conv_id", "turn", F.array_join(TS.select_contexts("contexts", "idx"), "\u0001").alias("selected"))


@register("answer_verdict", """WITH r AS (SELECT doc_id, '```json' || chr(10) || '{"answer": "answer-' || CAST(doc_id AS VARCHAR) || '", "verdict": "'
   || CASE WHEN quality = 1 THEN '1' ELSE '-1' END || '"}' || chr(10) || '```' AS reply FROM labels)
SELECT doc_id, TRY_CAST(json_extract_string(regexp_extract(reply, '(?s)(\\{.*\\})', 1), '$.verdict') AS INTEGER) AS verdict,
  CASE WHEN TRY_CAST(json_extract_string(regexp_extract(reply, '(?s)(\\{.*\\})', 1), '$.verdict') AS INTEGER) = 1
       THEN json_extract_string(regexp_extract(reply, '(?s)(\\{.*\\})', 1), '$.answer') END AS answer FROM r""")
def q_answer_verdict(spark, sf):
    lab = read_table(spark, sf, "labels")
    reply = F.concat(F.lit('```json\n{"answer": "answer-'), F.col("doc_id").cast("string"), F.lit('", "verdict": "'),
                     F.when(F.col("quality") == 1, F.lit("1")).otherwise(F.lit("-1")), F.lit('"}\n```'))
    return TS.answer_verdict(lab.select("doc_id", reply.alias("reply")), "reply").select("doc_id", "verdict", "answer")


QUOTA_SQL = """qt AS (SELECT item_id, text, row_number() OVER (ORDER BY md5('42:' || CAST(item_id AS VARCHAR))) AS slot FROM benchmark
   QUALIFY slot <= 10),
qq AS (SELECT *, CASE WHEN slot <= 4 THEN 'simple' WHEN slot <= 6 THEN 'reasoning' WHEN slot <= 8 THEN 'multi_context' ELSE 'conditional' END AS evolution_type FROM qt)"""


@register("evolution_quota", f"WITH {QUOTA_SQL} SELECT item_id, CAST(slot AS INTEGER) AS slot, evolution_type FROM qq")
def q_quota(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return TS.evolution_quota(b, "item_id", 10).select("item_id", F.col("slot").cast("int").alias("slot"), "evolution_type")


@register("multi_context_pairs", f"""SELECT a.vec_id AS context1, b.vec_id AS context2, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score
FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score, b.vec_id) = 1""")
def q_mc_pairs(spark, sf):
    return TS.multi_context_pairs(FX.vectors(spark, sf))


TYPES4 = ["simple", "reasoning", "conditional", "compress"]


@register("question_rules", f"""WITH u AS (SELECT conv_id, turn, text AS question, (['simple', 'reasoning', 'conditional', 'compress'])[1 + turn % 4] AS evolution_type FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS original FROM conversations WHERE role = 'assistant'),
x AS (SELECT * FROM u LEFT JOIN a USING (conv_id, turn)),
y AS (SELECT *, len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) AS n_words FROM x)
SELECT conv_id, turn, n_words, coalesce(n_words > CASE evolution_type WHEN 'reasoning' THEN 15 WHEN 'conditional' THEN 25 END, false) AS too_long,
  regexp_matches(question, '(?i)(provided context|according to the context)') AS mentions_context,
  (evolution_type = 'compress') AND (length(question) >= length(original)) AS not_shorter FROM y""")
def q_rules(spark, sf):
    c = read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"),
                                                F.element_at(F.array(*[F.lit(t) for t in TYPES4]), (1 + F.pmod("turn", F.lit(4))).cast("int")).alias("evolution_type"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("original"))
    r = TS.question_rules(u.join(a, ["conv_id", "turn"], "left"), original="original")
    return r.select("conv_id", "turn", "n_words", "too_long", "mentions_context", "not_shorter")


@register("seed_question_inputs", f"""WITH {KEYPHRASE_SQL},
cd AS (SELECT doc_id, {clean('text')} AS text FROM documents), {chunk_ctes('cd', 'doc_id')}
SELECT ck_out.doc_id, CAST(top.rank AS INTEGER) AS rank, top.term AS keyphrase, ck_out.text AS context
  , ck_out.pos FROM ck_out JOIN top USING (doc_id)""")
def q_seed_inputs(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    ch = chunk_documents(clean_text(d))
    every = ch.where(F.col("pos").isNotNull()).select("doc_id", "pos", F.col("text").alias("context"))
    phrases = TS.keyphrases(d, "doc_id", "text", 5)
    return TS.seed_question_inputs(every, phrases).select("doc_id", F.col("rank").cast("int").alias("rank"), "keyphrase", "context", "pos")


@register("assemble_testset", f"""WITH {QUOTA_SQL}, {passages_ctes()},
tq AS (SELECT item_id AS query_id, 'query: ' || text AS qtext FROM qq),
{embed_ctes('tq', 'query_id', 'qtext', 'te')},
th AS (SELECT v.query_id, p.passage_id, p.text, p.source, round({l2sq('v.embedding', 'p.embedding')}, 9) AS score FROM te_vec v, psg p),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM th QUALIFY rank <= 3),
a AS (SELECT conv_id AS item_id, min(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT q.item_id, q.text AS question, CAST(r.rank AS INTEGER) AS ctx_pos, r.text AS context, c.text AS ground_truth, q.evolution_type, s.source
FROM qq q JOIN tr r ON r.query_id = q.item_id JOIN tr s ON s.query_id = q.item_id AND s.rank = 1
LEFT JOIN a ON a.item_id = q.item_id LEFT JOIN conversations c ON c.conv_id = a.item_id AND c.turn = a.turn AND c.role = 'assistant'""")
def q_assemble_testset(spark, sf):
    b = read_table(spark, sf, "benchmark")
    qs = TS.evolution_quota(b, "item_id", 10).select("item_id", F.col("text").alias("question"), "evolution_type")
    # contexts: the three nearest passages of the question, in order; an answer: the first assistant turn of the conversation
    hits = knn_topk(embed_questions(qs.withColumnRenamed("item_id", "query_id")), _passages(spark, sf), k=3, carry=["text", "source"])
    ctx = assemble_context(hits, "text", ("rank",)).join(hits.where("rank = 1").select("query_id", "source"), "query_id")
    c = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    ans = c.groupBy(F.col("conv_id").alias("item_id")).agg(F.min_by("text", "turn").alias("ground_truth"))
    t = TS.assemble_testset(qs, ctx.withColumnRenamed("query_id", "item_id"), ans)
    return t.select("item_id", "question", F.posexplode("contexts").alias("p", "context"), "ground_truth", "evolution_type", "source").select(
        "item_id", "question", (F.col("p") + 1).cast("int").alias("ctx_pos"), "context", "ground_truth", "evolution_type", "source")


@register("publish_testset", f"""WITH {QUOTA_SQL}
SELECT q.item_id, q.text AS question, q.evolution_type FROM qq q""")
def q_publish_testset(spark, sf):
    b = read_table(spark, sf, "benchmark")
    t = TS.evolution_quota(b, "item_id", 10).select("item_id", F.col("text").alias("question"), "evolution_type")
    path = os.path.join(scratch(spark, "testset"), "published")
    publish_testset(t, path)
    return read_committed(spark, path)
