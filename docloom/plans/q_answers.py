"""Registered queries: the answering plan with a model on every hop, its
chat messages, and further rows of search, duplicates and readers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docloom.operators import generation as G
from docloom.operators import testset as TS
from docloom.operators.ann import ann_topk, build_index
from docloom.operators.knn import knn_topk
from docloom.operators.prompts import signature_header
from docloom.plans.q_generation import SAMPLES_SQL, _q, _requests
from docloom.plans.rag import ANSWER, SEARCH, answer_events, rag_answer
from docloom.plans.registry import EXTRA_ORACLES, _passages, register
from docloom.plans.sqlparts import DIM, FILE, buckets, dot, embed_ctes, l2sq, passages_ctes
from docloom.session import materialize, read_table, scratch
from docloom.sources import fixtures as FX
from docloom.sources.corpus import scan_instruction_set, scan_prompt_specs, scan_text_corpus, write_text_corpus
from docloom.streaming.streams import stream_answers

LINK = "https://example.org/search?q="
STEP = "chr(10) || 'Reasoning: Let''s think step by step in order to'"


def _prompt(sig, context: str) -> str:
    return f"{_q(signature_header(sig))} || 'Context: ' || {context} || chr(10) || 'Question: ' || question || {STEP}"


def _stub(prompt: str) -> str:
    return f"'stub:' || substr(md5({prompt}), 1, 8)"


def _hop(n: int, queries: str) -> str:
    return f"""{embed_ctes(queries, 'query_id', 'qtext', f'e{n}')},
h{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM (
   SELECT v.query_id, p.passage_id, round({l2sq('v.embedding', 'p.embedding')}, 9) AS score FROM e{n}_vec v, psg p)
   QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) <= 20)"""


def _listed(order: str) -> str:
    return f"string_agg('[' || nr || '] «' || text || '»', chr(10) ORDER BY {order})"


ANSWER_CTES = f"""{passages_ctes()},
q AS (SELECT item_id AS query_id, text AS question FROM benchmark),
q1 AS (SELECT query_id, question, 'query: ' || {_stub(_prompt(SEARCH, "''"))} AS qtext FROM q),
{_hop(1, 'q1')},
c1 AS (SELECT query_id, {_listed('nr')} AS ctx FROM (SELECT h1.query_id, h1.rank AS nr, p.text FROM h1 JOIN psg p USING (passage_id)) GROUP BY query_id),
q2 AS (SELECT query_id, question, 'query: ' || {_stub(_prompt(SEARCH, 'ctx'))} AS qtext FROM q JOIN c1 USING (query_id)),
{_hop(2, 'q2')},
allh AS (SELECT query_id, passage_id, 1 AS hop, rank FROM h1 UNION ALL SELECT query_id, passage_id, 2, rank FROM h2),
dd AS (SELECT * FROM allh QUALIFY row_number() OVER (PARTITION BY query_id, passage_id ORDER BY hop, rank) = 1),
sc AS (SELECT dd.query_id, dd.passage_id, dd.hop, p.text, p.source, CAST(len(list_filter({buckets("substr(q2.qtext, 8)", DIM)},
      lambda b: list_contains({buckets('p.text', DIM)}, b))) AS DOUBLE) AS score FROM dd JOIN psg p USING (passage_id) JOIN q2 USING (query_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS nr FROM sc QUALIFY nr <= 10),
ca AS (SELECT query_id, {_listed('nr')} AS ctx FROM rr GROUP BY query_id),
an AS (SELECT query_id, question, {_stub(_prompt(ANSWER, 'ctx'))} AS answer FROM q JOIN ca USING (query_id))"""

EVENTS_SQL = f"""WITH {ANSWER_CTES},
ev AS (SELECT query_id, 0 AS seq, 'you' AS sender, 'stream' AS type, question AS message, NULL AS link FROM an
  UNION ALL SELECT query_id, 1, 'bot', 'start', '', NULL FROM an
  UNION ALL SELECT query_id, 2, 'bot', 'stream', answer, NULL FROM an
  UNION ALL SELECT query_id, 3, 'bot', 'end', '', NULL FROM an
  UNION ALL SELECT query_id, 3 + nr, 'bot', 'sources', source, '{LINK}' || source FROM rr)
SELECT query_id, CAST(seq AS INTEGER) AS seq, sender, type, message, link FROM ev"""


@register("rag_answer", f"WITH {ANSWER_CTES} SELECT query_id, question, answer FROM an")
def q_answer(spark, sf):
    return rag_answer(FX.questions(spark, sf), _passages(spark, sf))[0]


@register("rag_answer_hits", f"WITH {ANSWER_CTES} SELECT query_id, CAST(nr AS INTEGER) AS rank, passage_id, score, hop, source FROM rr")
def q_answer_hits(spark, sf):
    return rag_answer(FX.questions(spark, sf), _passages(spark, sf))[1].drop("text")


@register("answer_events", EVENTS_SQL)
def q_answer_events(spark, sf):
    return answer_events(*rag_answer(FX.questions(spark, sf), _passages(spark, sf)), LINK)


@register("stream_answers", EVENTS_SQL)
def q_stream_answers(spark, sf):
    base = scratch(spark, "stream-answers")
    src = os.path.join(base, "incoming")
    FX.questions(spark, sf).repartition(2).write.parquet(src)
    stream_answers(spark, src, _passages(spark, sf), os.path.join(base, "out"), os.path.join(base, "ckpt"), link_base=LINK)
    return spark.read.parquet(os.path.join(base, "out")).drop("batch_id")


# ---------------------------------------------------------------- search with other distances; vectors without a direction
def _vectors(spark, sf):
    v = FX.vectors(spark, sf)
    nothing = F.array_repeat(F.lit(0.0).cast("float"), F.size("embedding"))
    return v.withColumn("embedding", F.when(F.pmod("passage_id", F.lit(50)) == 0, nothing).otherwise(F.col("embedding")))


VZ = "v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS e FROM embeddings)"
NORM = lambda x: f"sqrt({dot(x, x)})"


def _metric(name: str, score: str, where: str = "true"):
    sql = f"""WITH {VZ}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round({score}, 9) AS score FROM v a, v b WHERE {where})
SELECT query_id, passage_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM d) WHERE rank <= 20"""

    @register(f"knn_topk_{name}", sql)
    def run(spark, sf):
        v = _vectors(spark, sf)
        q = v.select(F.col("passage_id").alias("query_id"), "embedding")
        return knn_topk(q, v, k=20, metric=name).select("query_id", "passage_id", "rank", "score")


_metric("cosine", f"1 - {dot('a.e', 'b.e')} / ({NORM('a.e')} * {NORM('b.e')})", "a.vec_id % 50 <> 0 AND b.vec_id % 50 <> 0")
_metric("ip", f"-({dot('a.e', 'b.e')})")


@register("ann_topk_all_cells", f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score
  FROM embeddings a, embeddings b)
SELECT query_id, passage_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, passage_id) AS rank FROM d) WHERE rank <= 20""")
def q_ann_exact(spark, sf):
    v = FX.vectors(spark, sf)
    q = v.select(F.col("passage_id").alias("query_id"), "embedding")
    return ann_topk(q, v, k=20, cells=16, nprobe=16).select("query_id", "passage_id", "rank", "score")


@register("multi_context_pairs_index", f"""SELECT a.vec_id AS context1, b.vec_id AS context2, round({l2sq('a.embedding', 'b.embedding')}, 9) AS score
FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score, b.vec_id) = 1""")
def q_pairs_index(spark, sf):
    v = FX.vectors(spark, sf)
    return TS.multi_context_pairs(v, index=build_index(v, cells=16), nprobe=16)


EXTRA_ORACLES["question_near_dups_loose"] = EXTRA_ORACLES.get("question_near_dups", "").replace("0.8", "0.55")


@register("question_near_dups_loose")
def q_near_dups_loose(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return TS.question_near_dups(d.withColumnRenamed("doc_id", "id"), "id", "text", 0.55)


# ---------------------------------------------------------------- requests as they are sent
TYPED = ("inputs string, parameters struct<best_of:int, details:boolean, do_sample:boolean, max_new_tokens:int, "
         "num_return_sequences:int, repetition_penalty:double, stop:array<string>, temperature:double, top_p:double>")


@register("request_payload", """SELECT event_id AS request_id, concat_ws(' ', event_type, props) AS inputs, CAST(1 + user_id % 3 AS INTEGER) AS best_of,
  (1 + user_id % 3) > 1 AS details, (1 + user_id % 3) > 1 AS do_sample, CAST(50 + event_id % 50 AS INTEGER) AS max_new_tokens,
  CAST(1 + user_id % 3 AS INTEGER) AS num_return_sequences, CAST(1.0 - (user_id % 4) * 0.25 AS DOUBLE) AS repetition_penalty, 2 AS n_stop,
  greatest(0.1, value / 100) AS temperature, CAST(0.97 AS DOUBLE) AS top_p FROM events""")
def q_payload(spark, sf):
    _, req = _requests(spark, sf)
    # a quoted number or boolean would not be read back under the typed schema
    p = req.select("request_id", F.from_json("payload", TYPED, {"mode": "FAILFAST"}).alias("p")).select("request_id", "p.inputs", "p.parameters.*")
    return p.withColumn("n_stop", F.size("stop")).drop("stop")


@register("request_payload_aliases", """SELECT event_id AS request_id, CAST(7 + event_id % 5 AS INTEGER) AS max_new_tokens FROM events""")
def q_payload_aliases(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "event_type"])
    params = F.create_map(F.lit("max_tokens"), F.lit("3"), F.lit("max_new_tokens"), (7 + F.pmod("event_id", F.lit(5))).cast("string"))
    req = G.build_requests(ev.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("prompt"), params.alias("params")))
    return req.select("request_id", F.from_json("payload", TYPED)["parameters"]["max_new_tokens"].alias("max_new_tokens"))


@register("response_cache_payloads", """WITH r AS (SELECT event_id AS request_id, user_id, concat_ws(' ', event_type, props) AS inputs,
   md5(concat_ws(' ', event_type, props)) AS h, [CAST(user_id % 3 AS VARCHAR), CAST(user_id % 4 AS VARCHAR), CAST(event_id % 50 AS VARCHAR),
     CAST(greatest(0.1, value / 100) AS VARCHAR), concat_ws(' ', event_type, props)] AS k FROM events),
c AS (SELECT DISTINCT k FROM r WHERE user_id % 2 = 0 AND h >= '4')
SELECT request_id, CASE WHEN h < '4' THEN NULL ELSE 'reply to ' || inputs END AS response, k IN (SELECT k FROM c) AS from_cache FROM r""")
def q_cache_payloads(spark, sf):
    _, req = _requests(spark, sf)
    req = materialize(req.select("request_id", "payload"), "payloads")              # built once for both rounds

    def generate(todo):                                     # a reply that fails is null
        said = F.get_json_object("payload", "$.inputs")
        return todo.select("key", F.when(F.md5(said) >= "4", F.concat(F.lit("reply to "), said)).alias("response"))

    path = scratch(spark, "cache")
    spark.createDataFrame([], "key string, response string").write.parquet(path)
    even = req.join(read_table(spark, sf, "events", ["event_id", "user_id"]).where("user_id % 2 = 0")
                    .select(F.col("event_id").alias("request_id")), "request_id")
    G.append_cache(G.cached_generate(even, spark.read.parquet(path), generate), path)      # failures are not stored
    return G.cached_generate(req, spark.read.parquet(path), generate).select("request_id", "response", "from_cache")


# ---------------------------------------------------------------- readers
@register("scan_corpus_odd_names", f"""SELECT 'a+b %41 c:' || {FILE} AS file, text || chr(10) AS text FROM documents WHERE text IS NOT NULL""")
def q_odd_names(spark, sf):
    path = scratch(spark, "odd-names")
    c = FX.corpus(spark, sf).where(F.col("text").isNotNull())
    write_text_corpus(c.select(F.concat(F.lit("a+b %41 c:"), "file").alias("file"), F.concat("text", F.lit("\n")).alias("text")), path)
    return scan_text_corpus(spark, path, name_dir="file")


@register("read_instruction_set", f"WITH {SAMPLES_SQL} SELECT instruction, input, output FROM smp WHERE conv_id % 5 <> 0")
def q_read_instructions(spark, sf):
    path = scratch(spark, "instructions")
    s = FX.instruction_samples(spark, sf)
    conv = F.split("sample_id", ":")[0].cast("bigint")
    (s.withColumn("split", F.when(F.pmod(conv, F.lit(5)) == 0, "test").otherwise("train")).drop("sample_id")
     .write.partitionBy("split").parquet(path))
    return scan_instruction_set(spark, path, split="train")


@register("scan_prompt_specs", f"""WITH {SAMPLES_SQL}
SELECT 'conv-' || conv_id AS name, CAST(count(*) AS INTEGER) AS n_examples, CAST(count(*) FILTER (length(output) % 2 = 0) AS INTEGER) AS n_objects,
  min(instruction) AS first_question, max(output) AS last_answer, count(*) * 2 AS n_keys FROM smp GROUP BY conv_id""")
def q_prompt_specs_files(spark, sf):
    """One multi-line JSON document a file; the outputs of examples are strings in some and objects in others."""
    path = scratch(spark, "specs")
    s = FX.instruction_samples(spark, sf).withColumn("conv", F.split("sample_id", ":")[0])
    quoted = F.to_json(F.struct(F.col("instruction").alias("question"), F.col("output")))
    nested = F.to_json(F.struct(F.col("instruction").alias("question"), F.struct(F.col("output").alias("answer"), F.lit(1).alias("verdict")).alias("output")))
    example = F.when(F.length("output") % 2 == 0, nested).otherwise(quoted)
    body = F.concat(F.lit('{\n  "name": "conv-'), "conv", F.lit('",\n  "instruction": "Answer the question.",\n  "examples": [\n    '),
                    F.array_join(F.collect_list(example), ",\n    "), F.lit('\n  ],\n  "input_keys": ["question"],\n  "output_key": "output",\n'),
                    F.lit('  "output_type": "str",\n  "language": "english"\n}'))
    s.groupBy("conv").agg(body.alias("value")).withColumnRenamed("conv", "file").repartition("file").write.partitionBy("file").text(path)
    got = scan_prompt_specs(spark, path).select("name", "input_keys", F.explode("examples").alias("e"))
    said = F.col("e")["output"]
    answer = F.when(said.startswith('{"answer":'), F.coalesce(F.get_json_object(said, "$.answer"), F.lit(""))).otherwise(said)
    return got.groupBy("name").agg(
        F.count(F.lit(1)).cast("int").alias("n_examples"), F.sum(F.when(said.startswith('{"answer":'), 1).otherwise(0)).cast("int").alias("n_objects"),
        F.min(F.col("e")["question"]).alias("first_question"), F.max(answer).alias("last_answer"), F.sum(F.size("e")).alias("n_keys"))


@register("scan_prompt_specs_lines", f"""WITH {SAMPLES_SQL}, sp AS (SELECT conv_id, count(*) AS n_examples, min(instruction) AS first_question,
   max(output) AS last_answer FROM smp GROUP BY conv_id)
SELECT 'conv-' || conv_id AS name, CAST(n_examples AS INTEGER) AS n_examples, first_question, last_answer FROM sp""")
def q_prompt_specs(spark, sf):
    path = scratch(spark, "specs")
    s = FX.instruction_samples(spark, sf).withColumn("conv", F.split("sample_id", ":")[0])
    spec = s.groupBy("conv").agg(F.collect_list(F.struct(F.col("instruction").alias("question"), F.col("output"))).alias("examples")).select(
        F.concat(F.lit("conv-"), "conv").alias("name"), F.lit("Answer the question.").alias("instruction"), "examples",
        F.array(F.lit("question")).alias("input_keys"), F.lit("output").alias("output_key"), F.lit("str").alias("output_type"),
        F.lit("english").alias("language"))
    spec.select(F.to_json(F.struct("*")).alias("value")).write.text(path)                 # a JSON document a line
    got = scan_prompt_specs(spark, path, multi_line=False)
    q = F.transform("examples", lambda e: e["question"])
    return got.select("name", F.size("examples").alias("n_examples"), F.array_min(q).alias("first_question"),
                      F.array_max(F.transform("examples", lambda e: e["output"])).alias("last_answer"))
