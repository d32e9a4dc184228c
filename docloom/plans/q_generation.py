"""Registered queries: prompts, requests, generation, reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import generation as G
from docloom.operators.prompts import PromptSpec, Signature, few_shot_header, render_few_shot_prompt, \
    render_signature_prompt, signature_header
from docloom.plans.registry import register
from docloom.plans.sqlparts import py_strip
from docloom.session import read_table
from docloom.sources import fixtures as FX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SEARCH_SIG = Signature(
    instruction="Given what has been found so far, state in a few words what to look for next.",
    inputs=[("context", "may contain relevant facts"), ("question", "")],
    output=("query", ""),
)

SAMPLES_SQL = """u AS (SELECT conv_id, turn, text AS instruction FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS output FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn + 1 AS turn, text AS input FROM conversations WHERE role = 'system'),
smp AS (SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS sample_id, u.conv_id, u.turn, instruction,
           coalesce(s.input, '') AS input, output
        FROM u JOIN a USING (conv_id, turn) LEFT JOIN s USING (conv_id, turn))"""


@register("render_signature_prompt", f"""WITH {SAMPLES_SQL}
SELECT sample_id, {_q(signature_header(SEARCH_SIG))} || 'Context: '
   || array_to_string(list_transform(list_filter([input, output], lambda x: x <> ''), lambda x, i: '[' || i || '] «' || x || '»'), chr(10))
   || chr(10) || 'Question: ' || coalesce(instruction, '') || chr(10) || 'Reasoning: Let''s think step by step in order to' AS prompt
FROM smp""")
def q_signature(spark, sf):
    smp = FX.instruction_samples(spark, sf)
    rows = smp.select("sample_id", F.filter(F.array("input", "output"), lambda x: x != "").alias("context"),
                      F.col("instruction").alias("question"))
    return render_signature_prompt(rows, SEARCH_SIG).select("sample_id", "prompt")


# Our own prompt spec (not taken from any cache file).
SHORTEN_SPEC = PromptSpec(
    name="shorten_question",
    instruction="Rewrite the question so that it is shorter while keeping its meaning.",
    examples=[{"question": "What is the name of the river that flows through the old town?",
               "output": "Which river crosses the old town?"},
              {"question": "How many people were living in the valley at the end of the survey?",
               "output": "How many lived in the valley after the survey?"}],
    input_keys=["question"], output_key="output", output_type="str", language="english")


@register("render_few_shot_prompt", f"""SELECT item_id AS query_id,
  {_q(few_shot_header(SHORTEN_SPEC))} || 'question: ' || coalesce(text, '') || chr(10) || 'output: ' AS prompt FROM benchmark""")
def q_few_shot(spark, sf):
    rows = FX.questions(spark, sf).withColumnRenamed("question", "question")
    return render_few_shot_prompt(rows, SHORTEN_SPEC).select("query_id", "prompt")


def _requests(spark, sf, backend="hosted"):
    ev = read_table(spark, sf, "events", ["event_id", "user_id", "event_type", "value", "props"])
    params = F.create_map(F.lit("n"), (1 + F.pmod("user_id", F.lit(3))).cast("string"),
                          F.lit("temperature"), (F.col("value") / 100).cast("string"),
                          F.lit("max_tokens"), (50 + F.pmod("event_id", F.lit(50))).cast("string"),
                          F.lit("frequency_penalty"), (F.pmod("user_id", F.lit(4)) * 0.25).cast("string"),
                          F.lit("model"), F.lit("stub"))
    rows = ev.select(F.col("event_id").alias("request_id"), F.concat_ws(" ", "event_type", "props").alias("prompt"),
                     params.alias("params"))
    return rows, G.build_requests(rows, "prompt", "params", backend=backend)


@register("build_requests", """SELECT event_id AS request_id, concat_ws(' ', event_type, props) AS inputs,
  (1 + user_id % 3) > 1 AS do_sample, (1 + user_id % 3) > 1 AS details, CAST(1 + user_id % 3 AS INTEGER) AS best_of,
  CAST(1 + user_id % 3 AS INTEGER) AS num_return_sequences, greatest(0.1, value / 100) AS temperature,
  CAST(50 + event_id % 50 AS INTEGER) AS max_new_tokens, CAST(0.97 AS DOUBLE) AS top_p,
  CAST(1.0 - (user_id % 4) * 0.25 AS DOUBLE) AS repetition_penalty, false AS has_model, '["\\n","\\n\\n"]' AS stop
FROM events""")
def q_build_requests(spark, sf):
    _, req = _requests(spark, sf)
    p = F.col("parameters")
    return req.select("request_id", "inputs", p["do_sample"].cast("boolean").alias("do_sample"),
                      p["details"].cast("boolean").alias("details"), p["best_of"].cast("int").alias("best_of"),
                      p["num_return_sequences"].cast("int").alias("num_return_sequences"),
                      p["temperature"].cast("double").alias("temperature"),
                      p["max_new_tokens"].cast("int").alias("max_new_tokens"), p["top_p"].cast("double").alias("top_p"),
                      p["repetition_penalty"].cast("double").alias("repetition_penalty"),
                      F.map_contains_key(p, "model").alias("has_model"), p["stop"].alias("stop"))


@register("build_requests_local", """SELECT event_id AS request_id,
  ((1 + user_id % 3) > 1 OR value / 100 > 0.1) AS do_sample, CAST(1 + user_id % 3 AS INTEGER) AS num_return_sequences,
  value / 100 AS temperature, CAST(50 + event_id % 50 AS INTEGER) AS max_new_tokens, CAST(1.0 - (user_id % 4) * 0.25 AS DOUBLE) AS repetition_penalty
FROM events""")
def q_build_requests_local(spark, sf):
    _, req = _requests(spark, sf, backend="local")
    p = F.col("parameters")
    return req.select("request_id", F.coalesce(p["do_sample"].cast("boolean"), F.lit(False)).alias("do_sample"),
                      p["num_return_sequences"].cast("int").alias("num_return_sequences"),
                      p["temperature"].cast("double").alias("temperature"),
                      p["max_new_tokens"].cast("int").alias("max_new_tokens"),
                      p["repetition_penalty"].cast("double").alias("repetition_penalty"))


STUB_SQL = """'{"generated_text": "stub:' || substr(md5(inputs), 1, 8) || '"' ||
  CASE WHEN n > 1 THEN ', "details": {"best_of_sequences": [' ||
    array_to_string(list_transform(range(1, n), lambda i: '{"generated_text": "stub:' || substr(md5(inputs), 1, 8) || ':' || i || '"}'), ', ')
    || ']}' ELSE '' END || '}'"""


@register("batch_generate", f"""WITH r AS (SELECT event_id AS request_id, concat_ws(' ', event_type, props) AS inputs, 1 + user_id % 3 AS n FROM events)
SELECT request_id, {STUB_SQL} AS raw, CAST(NULL AS VARCHAR) AS error FROM r""")
def q_batch_generate(spark, sf):
    _, req = _requests(spark, sf)
    return G.batch_generate(req).select("request_id", "raw", "error")


@register("request_log", f"""WITH r AS (SELECT event_id AS request_id, concat_ws(' ', event_type, props) AS inputs, CAST(1 + user_id % 3 AS INTEGER) AS n,
   value / 100 AS temperature, CAST((user_id % 4) * 0.25 AS DOUBLE) AS penalty FROM events)
SELECT request_id, inputs AS prompt, {STUB_SQL} AS response,
  'best_of,details,do_sample,max_new_tokens,num_return_sequences,repetition_penalty,stop,temperature,top_p' AS kwargs_keys,
  'frequency_penalty,max_tokens,model,n,temperature' AS raw_kwargs_keys, n AS raw_n, n AS best_of, n > 1 AS details, temperature AS raw_temperature,
  greatest(0.1, temperature) AS temperature, 0.97::DOUBLE AS top_p, penalty AS raw_penalty, 1 - penalty AS penalty, 2 AS n_stop FROM r""")
def q_request_log(spark, sf):
    rows, req = _requests(spark, sf)
    gen = G.batch_generate(req).join(rows.select("request_id", "params"), "request_id")
    log = G.request_log(gen)
    keys = lambda c: F.array_join(F.sort_array(F.map_keys(F.from_json(c, "map<string,string>"))), ",")
    k = F.from_json("kwargs", "best_of int, details boolean, temperature double, top_p double, repetition_penalty double, stop array<string>",
                    {"mode": "FAILFAST"})
    raw = F.from_json("raw_kwargs", "n int, temperature double, frequency_penalty double", {"mode": "FAILFAST"})
    return log.select("request_id", "prompt", "response", keys("kwargs").alias("kwargs_keys"), keys("raw_kwargs").alias("raw_kwargs_keys"),
                      raw["n"].alias("raw_n"), k["best_of"].alias("best_of"), k["details"].alias("details"),
                      raw["temperature"].alias("raw_temperature"), k["temperature"].alias("temperature"), k["top_p"].alias("top_p"),
                      raw["frequency_penalty"].alias("raw_penalty"), k["repetition_penalty"].alias("penalty"), F.size(k["stop"]).alias("n_stop"))


def _raw_completions(spark, sf):
    c = read_table(spark, sf, "conversations")
    details = F.when(F.pmod("turn", F.lit(2)) == 0, F.struct(F.array(
        F.struct(F.col("role").alias("generated_text")), F.struct(F.upper("role").alias("generated_text"))).alias("best_of_sequences")))
    js = F.to_json(F.struct(F.col("text").alias("generated_text"), details.alias("details")))
    raw = F.when(F.col("role") == "system", F.substring(js, 1, 12)).otherwise(js)
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.substring("text", 1, 5).alias("prompt"),
                    raw.alias("raw"))


@register("parse_completions", """WITH c AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, role, turn, text, substr(text, 1, 5) AS prompt FROM conversations),
ch AS (SELECT request_id, prompt, 0 AS choice, text AS t FROM c WHERE role <> 'system'
       UNION ALL SELECT request_id, prompt, 1, role FROM c WHERE role <> 'system' AND turn % 2 = 0
       UNION ALL SELECT request_id, prompt, 2, upper(role) FROM c WHERE role <> 'system' AND turn % 2 = 0)
SELECT request_id, CAST(choice AS INTEGER) AS choice, CASE WHEN starts_with(t, prompt) THEN substr(t, length(prompt) + 1) ELSE t END AS text,
       CAST(NULL AS VARCHAR) AS error FROM ch
UNION ALL SELECT request_id, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), 'invalid JSON response' FROM c WHERE role = 'system'""")
def q_parse_completions(spark, sf):
    return G.parse_completions(_raw_completions(spark, sf), "raw", "prompt", drop_prompt=True)


@register("response_cache", """WITH r AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_id, md5(text) AS key FROM conversations),
cache AS (SELECT DISTINCT md5(text) AS key FROM conversations WHERE role = 'user')
SELECT request_id, key, CASE WHEN key IN (SELECT key FROM cache) THEN 'cached:' ELSE 'gen:' END || substr(key, 1, 8) AS response,
       key IN (SELECT key FROM cache) AS from_cache FROM r""")
def q_response_cache(spark, sf):
    c = read_table(spark, sf, "conversations")
    req = c.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.col("text").alias("payload"))
    cache = c.where(F.col("role") == "user").select(F.md5("text").alias("key")).distinct() \
        .withColumn("response", F.concat(F.lit("cached:"), F.substring("key", 1, 8)))

    def generate(todo):
        return todo.select("key", F.concat(F.lit("gen:"), F.substring("key", 1, 8)).alias("response"))

    return G.cached_generate(req, cache, generate)


def _verdict_replies(spark, sf):
    lab = read_table(spark, sf, "labels")
    reply = (F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit('```json\n{"verdict": 1, "reason": "cut'))
             .when(F.col("toxic") == 1, F.lit('```json\n{"verdict": "-1", "reason": "toxic"}\n```'))
             .when(F.col("quality") == 1, F.lit('```json\n{"verdict": "1", "reason": "good", "answer": "yes"}\n```'))
             .when(F.pmod("doc_id", F.lit(7)) == 0, F.lit('```json\n{"verdict": "clarté", "reason": "odd"}\n```'))
             .otherwise(F.lit('Here it is:\n```\n{"verdict": 0, "reason": "weak", "feedback": "too vague"}\n```')))
    return lab.select("doc_id", "quality", "toxic", reply.alias("reply"))


VERDICT_SQL = """v AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 11 = 0 THEN '```json' || chr(10) || '{"verdict": 1, "reason": "cut'
   WHEN toxic = 1 THEN '```json' || chr(10) || '{"verdict": "-1", "reason": "toxic"}' || chr(10) || '```'
   WHEN quality = 1 THEN '```json' || chr(10) || '{"verdict": "1", "reason": "good", "answer": "yes"}' || chr(10) || '```'
   WHEN doc_id % 7 = 0 THEN '```json' || chr(10) || '{"verdict": "clarté", "reason": "odd"}' || chr(10) || '```'
   ELSE 'Here it is:' || chr(10) || '```' || chr(10) || '{"verdict": 0, "reason": "weak", "feedback": "too vague"}' || chr(10) || '```' END AS reply FROM labels),
p AS (SELECT *, nullif(regexp_extract(reply, '(?s)(\\{.*\\})', 1), '') AS j FROM v),
pj AS (SELECT *, coalesce(json_valid(j), false) AS json_ok FROM p)"""


@register("parse_fenced_json", f"""WITH {VERDICT_SQL}
SELECT doc_id, CASE WHEN json_ok THEN TRY_CAST(json_extract_string(j, '$.verdict') AS INTEGER) END AS verdict,
       CASE WHEN json_ok THEN json_extract_string(j, '$.reason') END AS reason, json_ok FROM pj""")
def q_parse_fenced(spark, sf):
    p = G.parse_fenced_json(_verdict_replies(spark, sf), "reply", int_fields=("verdict",), str_fields=("reason",))
    return p.select("doc_id", "verdict", "reason", "json_ok")


LABELLED = "Reasoning: think it through" + "\n" + "Query: "


@register("parse_labelled_field", f"""WITH c AS (SELECT conv_id, turn, 'Reasoning: think it through' || chr(10) || 'Query: ' || text
   || CASE WHEN turn % 2 = 0 THEN chr(10) || 'Answer: done' ELSE '' END AS raw FROM conversations)
SELECT conv_id, turn, {py_strip("regexp_extract(raw, '(?s)Query:\\s*(.*?)(?:\\n\\w+:|\\z)', 1)")} AS query FROM c""")
def q_parse_labelled(spark, sf):
    c = read_table(spark, sf, "conversations")
    raw = F.concat(F.lit(LABELLED), "text", F.when(F.pmod("turn", F.lit(2)) == 0, F.lit("\nAnswer: done")).otherwise(F.lit("")))
    return G.parse_labelled_field(c.select("conv_id", "turn", raw.alias("raw")), "raw", "query").select("conv_id", "turn", "query")
