"""Question answering retrieval (entry point 2, RET-8 flagship).

prefix -> embed -> 2 hops of kNN with a rewritten query -> dedup -> rerank
-> attach source. The question table is the broadcast side of the kNN
(size-checked there); the passage table is scanned, never shuffled. With
``index=`` (a stored index of the passages) every hop searches that instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.replies import labelled_field
from docloom.functions.text import py_strip
from docloom.operators.chat import chat_event_expand
from docloom.operators.embed import embed_texts, query_prefix, term_buckets
from docloom.operators.generation import StubClient, batch_generate, build_requests, parse_completions
from docloom.operators.prompts import Signature, render_signature_prompt
from docloom.operators.retrieve import (assemble_context, attach_source, dedup_first, multi_hop_retrieve,
                                        multi_hop_search, overlap_maxsim, rerank)
from docloom.session import materialize


def embed_questions(questions: DataFrame, dim: int = 64, embedder=None, text_col: str = "question") -> DataFrame:
    """(query_id, embedding) by the same embedder as the passages (default: hash embedder)."""
    q = questions.select("query_id", query_prefix(text_col).alias("_qt"))
    return embed_texts(q, "_qt", "embedding", dim, embedder).select("query_id", "embedding")


def retrieve_hits(questions: DataFrame, passages: DataFrame, k: int = 20, hops: int = 2, dim: int = 64,
                  embedder=None, **knn_kw) -> DataFrame:
    """All hops' hits (repeats included) with text and source carried."""
    return multi_hop_retrieve(embed_questions(questions, dim, embedder), passages, max_hops=hops, k=k,
                              carry=["text", "source"], **knn_kw)


def overlap_reranker(dim: int = 64):
    """Default reranker: a score Column of (query text, passage text), one-hot
    hashed-token MaxSim. A model's is a pandas UDF of the same two columns."""
    return lambda query, text: overlap_maxsim(term_buckets(query, dim), term_buckets(text, dim))


SEARCH = Signature("Given what has been found so far, state in a few words what to look for next.",
                   [("context", "may contain relevant facts"), ("question", "")], ("query", ""))
ANSWER = Signature("Answer the question from the context alone, in full sentences.",
                   [("context", "may contain relevant facts"), ("question", "")], ("answer", ""))


def ask(rows: DataFrame, sig: Signature, client_factory=StubClient, params: dict | None = None, out: str = "reply",
        **generate_kw) -> DataFrame:
    """rows(query_id, context, question) -> (query_id, out): the signature's
    prompt is rendered, generated in batch and parsed; a reply without the
    field's label counts as the field, a failed one is null."""
    call = F.create_map(*[x for k, v in (params or {}).items() for x in (F.lit(k), F.lit(str(v)))]) if params else \
        F.create_map().cast("map<string,string>")
    prompts = render_signature_prompt(rows, sig).withColumn("params", call)
    got = batch_generate(build_requests(prompts, "prompt", "params", id_col="query_id"), client_factory, **generate_kw)
    first = parse_completions(got.withColumnRenamed("request_id", "query_id"), "raw", id_col="query_id").where("choice = 0")
    named = labelled_field("text", sig.output[0])
    return first.select("query_id", F.when(named != "", named).otherwise(py_strip(F.col("text"))).alias(out))


def model_rewriter(client_factory=StubClient, params: dict | None = None, sig: Signature = SEARCH, **generate_kw):
    """Rewriter for :func:`multi_hop_search`: a language model makes every
    hop's query from the question and the passages found so far; where it
    fails, the question is searched."""
    def rewrite(questions: DataFrame, hits: DataFrame | None, hop: int) -> DataFrame:
        if hits is None:
            rows = questions.withColumn("context", F.array().cast("array<string>"))
        else:
            rows = questions.join(assemble_context(dedup_first(hits), "text", out="context"), "query_id", "left")
        said = ask(rows.select("query_id", "context", "question"), sig, client_factory, params, "said", **generate_kw)
        return questions.join(said, "query_id", "left").select("query_id", F.coalesce("said", "question").alias("query"))
    return rewrite


def rag_answer(questions: DataFrame, passages: DataFrame, client_factory=StubClient, params: dict | None = None,
               embedder=None, reranker=None, k: int = 20, hops: int = 2, rerank_k: int = 10, dim: int = 64,
               source_mode: str = "by_id", rewrite=None, **knn_kw) -> tuple[DataFrame, DataFrame]:
    """The answering plan: on every hop a model rewrites the query and k
    passages are retrieved; hits are deduplicated, reranked by the last hop's
    query and credited; a model answers from the best. Returns answers
    (query_id, question, answer; null where generation failed) and the
    reranked hits (query_id, rank, passage_id, score, hop, text, source)."""
    rewrite = rewrite or model_rewriter(client_factory, params)
    hits, last = multi_hop_search(questions, passages, rewrite,
                                  lambda q: embed_questions(q, dim, embedder, "query"), hops, k, **knn_kw)
    dd = dedup_first(hits.repartition("query_id"))
    scored = dd.join(last, "query_id")
    rr = rerank(scored, (reranker or overlap_reranker(dim))(F.col("query"), F.col("text")), rerank_k)
    rr = materialize(attach_source(rr, dd, source_mode).select(
        "query_id", F.col("rerank_pos").alias("rank"), "passage_id", F.col("rerank_score").alias("score"), "hop", "text", "source"),
        "reranked")
    rows = questions.join(assemble_context(rr, "text", ("rank",), "context"), "query_id", "left")
    said = materialize(ask(rows.select("query_id", "context", "question"), ANSWER, client_factory, params, "answer"), "answers")
    return questions.select("query_id", "question").join(said, "query_id", "left"), rr


def answer_events(answers: DataFrame, ranked: DataFrame, link_base: str = "", encode_links: bool = False) -> DataFrame:
    """Chat messages (CHT-2) of answered questions, their sources by rank:
    (query_id, seq, sender, type, message, link)."""
    turn = lambda n, role, c: answers.select(F.col("query_id").alias("conv_id"), F.lit(n).cast("long").alias("turn"),
                                             F.lit(role).alias("role"), F.col(c).alias("text"))
    turns = turn(0, "user", "question").unionByName(turn(1, "assistant", "answer").where("text is not null"))
    sources = ranked.select(F.col("query_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "rank", "source")
    return chat_event_expand(turns, sources, link_base, encode_links).drop("turn").withColumnRenamed("conv_id", "query_id")


def rag_retrieve(questions: DataFrame, passages: DataFrame, k: int = 20, hops: int = 2, rerank_k: int = 10,
                 dim: int = 64, source_mode: str = "by_id", embedder=None, reranker=None, **knn_kw) -> DataFrame:
    """questions(query_id, question) x passages(passage_id, embedding, text, source)
    -> (query_id, rank, passage_id, score, hop, text, source).

    Retrieval without a language model: the rewriter is Rocchio's mean, which
    makes vectors, not text, so the reranker sees the question (with a model:
    :func:`rag_answer`). ``embedder`` and ``reranker`` are plug points."""
    hits = retrieve_hits(questions, passages, k, hops, dim, embedder, **knn_kw)
    # one exchange on query_id serves both the dedup (query, passage) and the rerank window (query);
    # every query holds at most k * hops hits, so no partition can be skewed by a key
    dd = dedup_first(hits.drop("embedding").repartition("query_id"))
    scored = dd.join(questions.select("query_id", "question"), "query_id")
    rr = rerank(scored, (reranker or overlap_reranker(dim))(F.col("question"), F.col("text")), rerank_k)
    rr = attach_source(rr, dd, source_mode)
    return rr.select("query_id", F.col("rerank_pos").alias("rank"), "passage_id",
                     F.col("rerank_score").alias("score"), "hop", "text", "source")
