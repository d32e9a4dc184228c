"""Registered queries: chat records and fine-tuning data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import chat as CH
from docloom.operators import sft as S
from docloom.plans.q_generation import SAMPLES_SQL, _q
from docloom.plans.registry import register
from docloom.plans.sqlparts import py_strip
from docloom.session import read_table
from docloom.sources import fixtures as FX

MSG_SQL = """m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'you' WHEN 'assistant' THEN 'bot' ELSE role END AS sender,
   text AS message, 'stream' AS type FROM conversations)"""


@register("validate_messages", f"""WITH {MSG_SQL}
SELECT conv_id, turn, sender, type, CASE WHEN sender IN ('bot', 'you') THEN NULL ELSE 'sender must be one of bot, you' END AS reason FROM m""")
def q_validate(spark, sf):
    return CH.validate_messages(FX.chat_messages(spark, sf)).select("conv_id", "turn", "sender", "type", "reason")


QA_SQL = """u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
qa AS (SELECT * FROM u LEFT JOIN a USING (conv_id, turn))"""

LINK = "https://example.org/search?q="


@register("chat_event_expand", f"""WITH {QA_SQL},
src AS (SELECT doc_id AS conv_id, 'pdf-' || source || '-' || CAST(doc_id AS VARCHAR) AS source FROM documents),
ev AS (
  SELECT conv_id, turn, 0 AS seq, 'you' AS sender, 'stream' AS type, question AS message, NULL AS link FROM qa
  UNION ALL SELECT conv_id, turn, 1, 'bot', 'start', '', NULL FROM qa
  UNION ALL SELECT conv_id, turn, 2, 'bot', 'stream', replace(answer, chr(10), '<br>'), NULL FROM qa WHERE answer IS NOT NULL
  UNION ALL SELECT conv_id, turn, 3, 'bot', 'end', '', NULL FROM qa WHERE answer IS NOT NULL
  UNION ALL SELECT qa.conv_id, turn, 4, 'bot', 'sources', s.source, '{LINK}' || s.source FROM qa JOIN src s USING (conv_id) WHERE answer IS NOT NULL
  UNION ALL SELECT conv_id, turn, 2, 'bot', 'error', {_q(CH.ERROR_TEXT)}, NULL FROM qa WHERE answer IS NULL)
SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, sender, type, message, link FROM ev""")
def q_chat_events(spark, sf):
    turns = read_table(spark, sf, "conversations")
    d = read_table(spark, sf, "documents", ["doc_id", "source"])
    qa = CH.question_answers(turns).select("conv_id", "turn")
    src = qa.join(d.withColumnRenamed("doc_id", "conv_id"), "conv_id").select(
        "conv_id", "turn", F.lit(1).alias("rank"),
        F.concat(F.lit("pdf-"), "source", F.lit("-"), F.col("conv_id").cast("string")).alias("source"))
    return CH.chat_event_expand(turns, src, LINK)


@register("chat_history_pairs", f"""WITH {QA_SQL}
SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS idx, '' AS question, 'Hello, I am your research assistant.' AS answer FROM conversations
UNION ALL SELECT conv_id, CAST(turn + 1 AS BIGINT), question, answer FROM qa WHERE answer IS NOT NULL""")
def q_history(spark, sf):
    return CH.chat_history_pairs(read_table(spark, sf, "conversations"))


# ---------------------------------------------------------------- fine-tuning data
SEED = 42
KEY = f"md5('{SEED}:' || sample_id)"


@register("scan_instruction_set", f"WITH {SAMPLES_SQL} SELECT sample_id, instruction, input, output FROM smp")
def q_scan_instr(spark, sf):
    return FX.instruction_samples(spark, sf)


@register("shuffle_seeded", f"WITH {SAMPLES_SQL} SELECT sample_id, {KEY} AS ord FROM smp")
def q_shuffle(spark, sf):
    return S.shuffle_seeded(FX.instruction_samples(spark, sf), "sample_id", SEED).select("sample_id", "ord")


def _alpaca_sql() -> str:
    head, rest = S.ALPACA_TEMPLATE.split("{instruction}")
    mid, tail = rest.split("{input}")
    return f"{_q(head)} || coalesce(instruction, 'None') || {_q(mid)} || coalesce(input, 'None') || {_q(tail)}"


def _chat_sys_sql() -> str:
    head, tail = S.CHAT_SYSTEM_TEMPLATE.split("{input}")
    return f"{_q(head)} || coalesce(input, 'None') || {_q(tail)}"


def _explode_messages(df):
    return df.select("sample_id", F.posexplode_outer("messages").alias("idx", "m")).where(F.col("idx").isNotNull()) \
        .select("sample_id", F.col("idx").cast("int").alias("idx"), "m.role", "m.content")


@register("format_instruct", f"""WITH {SAMPLES_SQL}
SELECT sample_id, 0 AS idx, 'user' AS role, {_alpaca_sql()} AS content FROM smp
UNION ALL SELECT sample_id, 1, 'assistant', output FROM smp""")
def q_format_instruct(spark, sf):
    return _explode_messages(S.format_instruct(FX.instruction_samples(spark, sf), keep=("sample_id",)))


@register("format_chat", f"""WITH {SAMPLES_SQL}
SELECT sample_id, 0 AS idx, 'system' AS role, {_chat_sys_sql()} AS content FROM smp
UNION ALL SELECT sample_id, 1, 'user', instruction FROM smp
UNION ALL SELECT sample_id, 2, 'assistant', output FROM smp""")
def q_format_chat(spark, sf):
    return _explode_messages(S.format_chat(FX.instruction_samples(spark, sf), keep=("sample_id",)))


@register("train_test_split_exact", f"""WITH {SAMPLES_SQL}, k AS (SELECT sample_id, row_number() OVER (ORDER BY {KEY}) AS r FROM smp)
SELECT sample_id, CASE WHEN r <= ceil(0.01 * (SELECT count(*) FROM smp)) THEN 'test' ELSE 'train' END AS split FROM k""")
def q_split_exact(spark, sf):
    return S.train_test_split(FX.instruction_samples(spark, sf), "sample_id", 0.01, SEED, "exact").select("sample_id", "split")


@register("train_test_split_hash", f"""WITH {SAMPLES_SQL}
SELECT sample_id, CASE WHEN ('0x' || substr(md5({KEY}), 1, 8))::BIGINT < {int(0.01 * (1 << 32))} THEN 'test' ELSE 'train' END AS split FROM smp""")
def q_split_hash(spark, sf):
    return S.train_test_split(FX.instruction_samples(spark, sf), "sample_id", 0.01, SEED, "hash").select("sample_id", "split")


@register("split_counts", f"""WITH {SAMPLES_SQL}, k AS (SELECT sample_id, row_number() OVER (ORDER BY {KEY}) AS r FROM smp),
ss AS (SELECT CASE WHEN r <= ceil(0.01 * (SELECT count(*) FROM smp)) THEN 'test' ELSE 'train' END AS split FROM k)
SELECT split, count(*) AS n FROM ss GROUP BY split""")
def q_split_counts(spark, sf):
    return S.split_counts(S.train_test_split(FX.instruction_samples(spark, sf), "sample_id", 0.01, SEED, "exact"))


def _chatml(parts: list[tuple[str, str]], gen: bool = True) -> str:
    s = " || ".join(f"'<|im_start|>{r}' || chr(10) || {c} || '<|im_end|>' || chr(10)" for r, c in parts)
    return s + (" || '<|im_start|>assistant' || chr(10)" if gen else "")


@register("chat_template", f"""WITH {SAMPLES_SQL}
SELECT sample_id, {_chatml([('user', _alpaca_sql())])} AS prompt_default,
       {_chatml([('user', _alpaca_sql()), ('assistant', 'output')])} AS prompt_parity FROM smp""")
def q_chat_template(spark, sf):
    m = S.format_instruct(FX.instruction_samples(spark, sf), keep=("sample_id",))
    return m.select("sample_id", S.chat_template("messages").alias("prompt_default"),
                    S.chat_template("messages", n=2).alias("prompt_parity"))


def _tokens_sql(col: str) -> str:
    return (f"coalesce(list_sum(list_transform(list_filter(regexp_split_to_array({col}, '\\s+'), lambda w: w <> ''), "
            f"lambda w: greatest(1, ceil(length(w) / 4))::BIGINT)), 0)")


@register("pack_sequences", f"""WITH {SAMPLES_SQL},
t AS (SELECT sample_id, {KEY} AS ord, {_tokens_sql(f"{_alpaca_sql()} || ' ' || output")} AS n FROM smp),
c AS (SELECT *, sum(n) OVER (ORDER BY ord, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM t WHERE n > 0),
sp AS (SELECT sample_id, e - n AS st, e, unnest(range(CAST(floor((e - n) / 2048) AS BIGINT), CAST(floor((e - 1) / 2048) AS BIGINT) + 1)) AS block FROM c)
SELECT CAST(block AS BIGINT) AS block, sample_id, greatest(st, block * 2048) - st AS "from", least(e, (block + 1) * 2048) - st AS "to"
FROM sp WHERE block < (SELECT sum(n) FROM t) // 2048""")
def q_pack(spark, sf):
    smp = FX.instruction_samples(spark, sf)
    m = S.format_instruct(S.shuffle_seeded(smp, "sample_id", SEED), keep=("sample_id", "ord"))
    text = F.concat(F.element_at("messages", 1)["content"], F.lit(" "), F.element_at("messages", 2)["content"])
    t = m.select("sample_id", "ord", S.token_count(text).alias("n"))
    return S.pack_sequences(t, "sample_id", "ord", "n", 2048)


STUB7 = "<|gen|>"


@register("extract_prediction", f"""WITH {SAMPLES_SQL},
p AS (SELECT sample_id, output, {_chatml([('user', _alpaca_sql())])} AS prompt FROM smp)
SELECT sample_id, {py_strip(f"substr(prompt || '{STUB7}' || ' ' || output, length(prompt) + 8)")} AS pred FROM p""")
def q_extract(spark, sf):
    m = S.format_instruct(FX.instruction_samples(spark, sf), keep=("sample_id", "output"))
    p = m.withColumn("prompt", S.chat_template("messages"))
    out = F.concat("prompt", F.lit(STUB7 + " "), "output")      # stand-in model output: prompt + 7 chars + answer
    return p.select("sample_id", S.extract_prediction(out, F.col("prompt"), 7).alias("pred"))


@register("predictions_table", f"""WITH {SAMPLES_SQL}
SELECT {_alpaca_sql()} AS id, {py_strip("output")} AS pred FROM smp""")
def q_predictions(spark, sf):
    m = S.format_instruct(FX.instruction_samples(spark, sf), keep=("sample_id", "output"))
    p = m.withColumn("prompt", S.chat_template("messages"))
    out = F.concat("prompt", F.lit(STUB7 + " "), "output")
    return S.predictions_table(p.withColumn("pred", S.extract_prediction(out, F.col("prompt"), 7)))


@register("sample_n", f"WITH {SAMPLES_SQL} SELECT sample_id FROM smp ORDER BY {KEY} LIMIT 25")
def q_sample_n(spark, sf):
    return S.sample_n(FX.instruction_samples(spark, sf), "sample_id", 25, SEED).select("sample_id")
