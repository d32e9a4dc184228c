"""Evaluation-set construction (EVL-1..12).

In the original flow an LLM makes each judgement from a JSON prompt
contract; here the deterministic data step around each contract is built
(parse, validate, filter, pair, assemble). TF-IDF keyphrases and Jaccard
near-duplicates are stand-ins for the model's judgement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.ids import seeded_key
from docloom.operators.embed import terms
from docloom.operators.generation import parse_fenced_json
from docloom.operators.ann import ann_topk
from docloom.operators.components import components
from docloom.operators.knn import knn_topk
from docloom.operators.neighbor_graph import neighbor_graph
from docloom.operators.set_join import near_sets, numbered_sets
from docloom.session import materialize


#: Terms whose frequency is sent to all tasks; only rows of rarer terms are shuffled to meet theirs.
COMMON_TERMS = 200_000


def _term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of every row, counted within the row: runs of its sorted
    terms. A text without terms gives one row of a null term."""
    s1 = df.select(id_col, F.sort_array(terms(text_col)).alias("_s"))
    prev = F.slice(F.concat(F.array(F.lit("")), "_s"), 1, F.greatest(F.size("_s"), F.lit(0)))
    s2 = s1.select(id_col, "_s", F.zip_with("_s", prev, lambda cur, p: cur != p).alias("_first"))
    s3 = s2.select(id_col, F.size("_s").alias("_n"), F.filter(F.transform("_first", lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda x: x >= 0).alias("_st"),
                   F.filter(F.zip_with("_s", "_first", lambda v, f: F.when(f, v)), lambda x: x.isNotNull()).alias("_d"))
    ends = F.slice(F.concat(F.slice("_st", 2, F.greatest(F.size("_st") - 1, F.lit(0))), F.array("_n")), 1, F.greatest(F.size("_st"), F.lit(0)))
    counted = s3.select(id_col, F.explode_outer(F.arrays_zip(F.col("_d").alias("t"), F.zip_with(ends, "_st", lambda a, b: a - b).alias("c"))).alias("e"))
    return counted.select(id_col, F.col("e.t").alias("term"), F.col("e.c").cast("long").alias("tf"))


def keyphrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, min_k: int = 3) -> DataFrame:
    """Top-k terms per text by tf * ln(N / df) (ties by term), with a flag
    when fewer than ``min_k`` exist. tf is counted within a row, without a
    shuffle, and written; only rows whose id comes more than once are added up.
    df of the ``COMMON_TERMS`` most common terms is broadcast, so only rows of
    rarer terms are joined by shuffling; the top-k window gets a partial limit
    before its shuffle. A text without terms gives one row of nulls, flagged
    ``too_few``."""
    n_docs = df.select(id_col).count()
    # written once: otherwise Catalyst rebuilds the df branch from the raw text (second scan and explode)
    staged = materialize(_term_counts(df, id_col, text_col), "tf")
    tf = staged.where(F.col("term").isNotNull())
    again = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col(id_col).alias("_id"))
    if not again.isEmpty():
        again = materialize(again, "repeated-ids")
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        tf = materialize(tf.join(again, same, "left_anti").unionByName(
            tf.join(again, same, "left_semi").groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))), "tf-by-id")
    # written too: against a table AQE can split a term's partition, against an aggregate on the key it can't
    dfreq = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    if dfreq.count() <= COMMON_TERMS:
        joined = tf.join(F.broadcast(dfreq), "term")
    else:
        common = F.broadcast(materialize(dfreq.orderBy(F.desc("df"), "term").limit(COMMON_TERMS), "common-df"))
        joined = tf.join(common, "term").unionByName(tf.join(common.select("term"), "term", "left_anti").join(dfreq, "term"))
    scored = joined.withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(max(n_docs, 1))) / F.col("df")), 9))
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("term"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    cnt = Window.partitionBy(id_col)
    found = top.withColumn("too_few", F.count(F.lit(1)).over(cnt) < min_k).select(
        id_col, F.col("rank").cast("int").alias("rank"), "term", "score", "too_few")
    bare = staged.where(F.col("term").isNull()).select(
        id_col, F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("double").alias("score"), F.lit(min_k > 0).alias("too_few"))
    return found.unionByName(bare)


SCORE_FIELDS = ("clarity", "depth", "structure", "relevance")


def context_score_filter(df: DataFrame, raw_col: str, threshold: float = 2.0) -> DataFrame:
    """Four 1-3 scores; values that are not an integer in 1..3 become NULL;
    ``score`` = mean of the valid ones; ``keep`` = score >= threshold."""
    p = parse_fenced_json(df, raw_col, int_fields=SCORE_FIELDS)
    for f in SCORE_FIELDS:
        p = p.withColumn(f, F.when(F.col(f).between(1, 3), F.col(f)))
    vals = F.array(*[F.col(f) for f in SCORE_FIELDS])
    valid = F.filter(vals, lambda x: x.isNotNull())
    p = p.withColumn("score", F.when(F.size(valid) > 0, F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.size(valid)))
    return p.withColumn("keep", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def question_verdict_filter(df: DataFrame, raw_col: str) -> DataFrame:
    """``keep`` when verdict = 1; ``feedback`` kept for the others."""
    p = parse_fenced_json(df, raw_col, int_fields=("verdict",), str_fields=("feedback",))
    return p.withColumn("keep", F.coalesce(F.col("verdict") == 1, F.lit(False))).withColumn(
        "feedback", F.when(~F.col("keep"), F.col("feedback")))


def evolution_elimination(pairs: DataFrame, raw_col: str) -> DataFrame:
    """Drops an evolved question judged equal (verdict 1) to its base;
    unreadable verdicts are kept (the judgement failed, not the question)."""
    p = parse_fenced_json(pairs, raw_col, int_fields=("verdict",), str_fields=("reason",))
    return p.where(~F.coalesce(F.col("verdict") == 1, F.lit(False)))


def answer_verdict(df: DataFrame, raw_col: str, answer_out: str = "answer") -> DataFrame:
    """Verdict ``'1'`` keeps the answer, ``'-1'`` makes it NULL."""
    p = parse_fenced_json(df, raw_col, int_fields=("verdict",), str_fields=("answer",))
    return p.withColumn(answer_out, F.when(F.col("verdict") == 1, F.col("answer")))


def select_contexts(contexts: str, idx: str, out: str = "selected") -> Column:
    """Pick contexts by 1-based positions; out-of-range positions are ignored."""
    z = F.arrays_zip(F.col(idx).alias("i"), F.array_repeat(F.col(contexts), F.size(idx)).alias("c"))
    picked = F.transform(z, lambda r: F.when((r["i"] >= 1) & (r["i"] <= F.size(r["c"])), F.get(r["c"], r["i"] - 1)))
    return F.filter(picked, lambda x: x.isNotNull()).alias(out)


# Default shares of the evolution types.
DEFAULT_SHARES = {"simple": 0.4, "reasoning": 0.2, "multi_context": 0.2, "conditional": 0.2}


def quotas(test_size: int, shares: dict[str, float]) -> list[tuple[str, int]]:
    """Largest-remainder apportionment (ties by listed order)."""
    total = sum(shares.values())
    raw = [(k, test_size * v / total) for k, v in shares.items()]
    base = [(k, math.floor(x)) for k, x in raw]
    left = test_size - sum(b for _, b in base)
    order = sorted(range(len(raw)), key=lambda i: (-(raw[i][1] - base[i][1]), i))
    extra = set(order[:left])
    return [(k, b + (1 if i in extra else 0)) for i, (k, b) in enumerate(base)]


def evolution_quota(df: DataFrame, id_col: str, test_size: int = 10, shares: dict | None = None, seed: int = 42) -> DataFrame:
    """Seeded choice of ``test_size`` rows (a top-n), each given an evolution
    type by quota; the row_number runs over those n rows only."""
    q = quotas(test_size, shares or DEFAULT_SHARES)
    chosen = df.withColumn("_k", seeded_key(seed, id_col)).orderBy("_k").limit(test_size)
    pos = chosen.withColumn("slot", F.row_number().over(Window.orderBy("_k")))
    expr, upto = None, 0
    for name, cnt in q:
        upto += cnt
        expr = (F.when(F.col("slot") <= upto, F.lit(name)) if expr is None else expr.when(F.col("slot") <= upto, F.lit(name)))
    return pos.withColumn("evolution_type", expr).drop("_k")


def multi_context_pairs(vectors: DataFrame, id_col: str = "passage_id", vec: str = "embedding", index=None,
                        nprobe: int = 4, graph: bool = False, **knn_kw) -> DataFrame:
    """Second context for each seed context: its nearest other vector, exact.
    For large tables, where comparing all with all is not wanted: among the
    probed cells of a cell ``index`` of the vectors (RET-2), or with ``graph``
    by a neighbour graph (:func:`neighbor_graph`), which needs no index."""
    if graph:
        near, _ = neighbor_graph(vectors, id_col=id_col, vec=vec, **knn_kw)
        return near.where("rank = 1").select(F.col("id").alias("context1"), F.col("neighbor").alias("context2"), "score")
    q = vectors.select(F.col(id_col).alias("query_id"), vec)
    p = vectors.select(F.col(id_col).alias("passage_id"), vec)
    if index is not None:
        nn = ann_topk(q, p, k=1, nprobe=nprobe, vec=vec, index=index, exclude_self=True, **knn_kw)
    else:
        nn = knn_topk(q, p, k=1, exclude_self=True, **knn_kw)
    return nn.select(F.col("query_id").alias("context1"), F.col("passage_id").alias("context2"), "score")


# Rules of the question-rewrite contracts (phrases a question must not use,
# word limits per evolution type).
CONTEXT_PHRASES = r"(?i)(provided context|according to the context)"
MAX_WORDS = {"reasoning": 15, "conditional": 25}


def question_rules(df: DataFrame, question: str = "question", evolution_type: str = "evolution_type",
                   original: str | None = None) -> DataFrame:
    """Rule flags of the rewrite contracts: word limits per type, no mention
    of the context, and a compressed question shorter than its original."""
    words = F.size(F.filter(F.split(F.col(question), r"\s+"), lambda w: w != ""))
    limit = F.when(F.col(evolution_type) == "reasoning", MAX_WORDS["reasoning"]).when(
        F.col(evolution_type) == "conditional", MAX_WORDS["conditional"])
    out = (df.withColumn("n_words", words)
           .withColumn("too_long", F.coalesce(words > limit, F.lit(False)))
           .withColumn("mentions_context", F.col(question).rlike(CONTEXT_PHRASES)))
    if original:
        out = out.withColumn("not_shorter", (F.col(evolution_type) == "compress") &
                             (F.length(question) >= F.length(original)))
    return out


def seed_question_inputs(contexts: DataFrame, phrases: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One (context, keyphrase) row per keyphrase of the context's document."""
    return contexts.join(phrases.select(id_col, F.col("term").alias("keyphrase"), "rank"), id_col)


def assemble_testset(questions: DataFrame, contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """question, contexts, ground_truth, evolution_type, source; LEFT joins so a
    failed step leaves NULLs instead of stopping the run."""
    return (questions.join(contexts, "item_id", "left").join(answers, "item_id", "left")
            .select("item_id", "question", "contexts", "ground_truth", "evolution_type", "source"))


# ------------------------------------------------------------------ near duplicates
def word_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.array_sort(F.array_distinct(terms(text_col))).alias("ws"))


def _keyed_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sk, ws): word sets and their keys, written once."""
    return materialize(word_sets(df, id_col, text_col).select(F.col(id_col).alias("id"), F.md5(F.array_join("ws", "\u0001")).alias("sk"), "ws"),
                       "word-sets")


def question_near_dups(df: DataFrame, id_col: str = "id", text_col: str = "text", t: float = 0.8,
                       hash_payload: bool = True) -> DataFrame:
    """Near-duplicate graph ``(id_a, id_b, jaccard)``, exact for Jaccard >= t.

    Each distinct word set is represented by its least id. Copies (same word
    set) give one row ``(representative, copy, 1.0)`` each, so a group of
    copies costs rows linear in its size; distinct sets that reach t give
    ``(rep_a < rep_b, jaccard)``. Clusters follow by connected components.

    Identical word sets are grouped first; the distinct ones are joined block
    by block (:func:`near_sets`), so candidate pairs stay in their task.
    ``hash_payload`` makes no difference any more: words travel as numbers
    that no two words share.
    """
    sets = _keyed_sets(df, id_col, text_col)
    uniq = numbered_sets(sets, t)
    near = near_sets(uniq, t, "rep")
    cross = near.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"),
                        (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))
    copies = (sets.select("sk", "id").join(uniq.select("sk", "rep"), "sk").where(F.col("id") != F.col("rep"))
              .select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("jaccard")))
    return cross.unionByName(copies).withColumn("jaccard", F.round("jaccard", 6))


def question_dup_classes(df: DataFrame, id_col: str = "id", text_col: str = "text", t: float = 0.8) -> DataFrame:
    """Near-duplicate classes for big inputs: one row per row of ``df``,
    ``(id, class_id, n_rows, n_texts)``. A class is a connected component of
    the texts whose word sets reach Jaccard ``t``, exactly, as the pairs of
    :func:`question_near_dups` would give it, named by its least id; ``n_rows``
    and ``n_texts`` count its rows and its distinct word sets. Texts without
    words are classes of their own.

    No pairs are listed, so a template in a third of all rows costs rows in
    proportion to it: a task compares two blocks of distinct word sets
    (:func:`near_sets`) and gives only links that join what it had not joined."""
    rows = _keyed_sets(df, id_col, text_col)
    sets = numbered_sets(rows, t)
    links = materialize(near_sets(sets, t, "nr", chain=True).select("a", "b"), "links")
    comps = materialize(components(links), "components")
    named = materialize(sets.select("sk", "nr", "rep", "m").join(comps.withColumnRenamed("node", "nr"), "nr", "left").withColumn(
        "c", F.coalesce("component", "nr")), "named")
    classes = materialize(named.groupBy("c").agg(F.min("rep").alias("class_id"), F.sum("m").alias("n_rows"), F.count(F.lit(1)).alias("n_texts")), "classes")
    of = materialize(named.join(classes, "c").select("sk", "class_id", "n_rows", "n_texts"), "class-of")
    some = rows.where(F.size("ws") > 0).select("id", "sk").join(of, "sk").select("id", "class_id", "n_rows", "n_texts")
    none = rows.where(F.size("ws") <= 0).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_rows"), F.lit(1).cast("long").alias("n_texts"))
    lost = rows.where("ws is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_rows"), F.lit(1).cast("long").alias("n_texts"))
    return some.unionByName(none).unionByName(lost).select(F.col("id").alias(id_col), "class_id", "n_rows", "n_texts")
