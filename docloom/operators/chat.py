"""Chat records (CHT-1..3).

Turn pairing uses equi-joins on (conv_id, turn ± 1) rather than windows over
a conversation, so one very long conversation is still spread by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed senders and message types of the chat protocol.
SENDERS = ("bot", "you")
TYPES = ("start", "stream", "end", "error", "info", "sources")
# Fixed value: the reply sent when answering a question fails.
ERROR_TEXT = "Sorry, something went wrong. Try again."


def validate_messages(df: DataFrame, sender: str = "sender", type_col: str = "type") -> DataFrame:
    """Adds ``reason`` (NULL when the message is valid)."""
    r_sender = F.when(~F.coalesce(F.col(sender).isin(*SENDERS), F.lit(False)), F.lit("sender must be one of bot, you"))
    r_type = F.when(~F.coalesce(F.col(type_col).isin(*TYPES), F.lit(False)),
                    F.lit("type must be one of " + ", ".join(TYPES)))
    return df.withColumn("reason", F.concat_ws("; ", r_sender, r_type)).withColumn(
        "reason", F.when(F.col("reason") == "", None).otherwise(F.col("reason")))


def split_valid(df: DataFrame):
    v = validate_messages(df)
    return v.where(F.col("reason").isNull()).drop("reason"), v.where(F.col("reason").isNotNull())


def question_answers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the assistant
    turn right after it (NULL answer when there is none)."""
    u = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"], "left")


def chat_event_expand(turns: DataFrame, sources: DataFrame | None = None, link_base: str = "",
                      encode_links: bool = False) -> DataFrame:
    """Per question, the ordered reply messages:
    (you, stream, question), (bot, start, ''), (bot, stream, answer with
    newlines as <br>), (bot, end, ''), then (bot, sources, s) per source with
    its search link. A question without an answer gets (bot, error, …)
    instead of answer, end and sources.

    ``sources(conv_id, turn, rank, source)`` — at most the reranked k per
    question, so the per-question list is bounded."""
    qa = question_answers(turns)
    if sources is not None:
        src = sources.groupBy("conv_id", "turn").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda s: s["source"]).alias("_src"))
        qa = qa.join(src, ["conv_id", "turn"], "left")
    else:
        qa = qa.withColumn("_src", F.array().cast("array<string>"))
    qa = qa.withColumn("_src", F.coalesce("_src", F.array().cast("array<string>")))

    def msg(sender, type_, message, link=None):
        return F.struct(F.lit(sender).alias("sender"), F.lit(type_).alias("type"), message.alias("message"),
                        (link if link is not None else F.lit(None).cast("string")).alias("link"))

    head = [msg("you", "stream", F.col("question")), msg("bot", "start", F.lit(""))]
    ok = F.concat(F.array(*head, msg("bot", "stream", F.replace(F.col("answer"), F.lit("\n"), F.lit("<br>"))),
                          msg("bot", "end", F.lit(""))),
                  F.transform("_src", lambda s: F.struct(F.lit("bot").alias("sender"), F.lit("sources").alias("type"),
                                                         s.alias("message"),
                                                         # a blank source has nothing to search for
                                                         F.when(~s.rlike(r"^\s*$"), F.concat(
                                                             F.lit(link_base), F.url_encode(s) if encode_links else s)).alias("link"))))
    err = F.array(*head, msg("bot", "error", F.lit(ERROR_TEXT)))
    events = F.when(F.col("answer").isNotNull(), ok).otherwise(err)
    out = qa.select("conv_id", "turn", F.posexplode_outer(events).alias("seq", "m"))
    return out.select("conv_id", "turn", F.col("seq").cast("int").alias("seq"), "m.sender", "m.type", "m.message", "m.link")


def chat_history_pairs(turns: DataFrame, greeting: str = "Hello, I am your research assistant.") -> DataFrame:
    """(conv_id, idx, question, answer): first entry ('', greeting), then one
    entry per answered question (idx = its turn + 1)."""
    qa = question_answers(turns).where(F.col("answer").isNotNull())
    convs = turns.select("conv_id").distinct()
    first = convs.select("conv_id", F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("question"),
                         F.lit(greeting).alias("answer"))
    rest = qa.select("conv_id", (F.col("turn") + 1).cast("bigint").alias("idx"), "question", "answer")
    return first.unionByName(rest)
