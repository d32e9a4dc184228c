"""Language identification by multilingual mixture inference.

Every learned language has a distribution over hashed character n-grams of
words (their bytes, with the word's ends marked), smoothed; a text is cut into
runs of a few words, and each run has a log-likelihood under each language.
The text's language proportions are found by expectation-maximisation over
its runs. Which languages a text holds is then chosen by penalised
likelihood: nested sets of the strongest languages are fitted anew, and a
further language has to raise the log-likelihood by more than half the log of
the number of runs (and a margin); sets grow as long as one does. The predicted language is the one with the
largest proportion in the chosen set.

Counts: n-grams of the learned texts are counted in Spark over a uniform,
documented sample of at most about ``max_train`` documents a language (a hash
of id); scoring covers every whole text. The model has 2**bits rows a
language and at most ``MOST_CELLS`` cells: beyond 256 languages the buckets get
fewer. The ``MOST_LANGUAGES`` most frequent languages are learnt.

Cases: a null text and one without a letter are ``und`` with score 0; if
nothing was learned every text is ``und``; rows of a null language teach
nothing; ties go to the language first by code point; repeated rows are
scored alike; a null id is never held out; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import python_ready, stage
from docloom.llm.toxicity import remainder

BITS = 15
MAX_TRAIN = 8_000
#: Bounds of the model: languages learnt (the most frequent ones), and cells of its table, languages x buckets.
MOST_LANGUAGES, MOST_CELLS = 1 << 14, 1 << 23
#: Language sets up to this size are tried for every text; larger ones as long as the penalised likelihood rises.
TRIED = 4
RUN = 8                       # words in a run
ORDERS = (1, 2, 3, 4)         # bytes in an n-gram
MARGIN = 3.0
_U = np.uint64


def grams(w: W.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of all n-grams of all words; the n-grams at a
    word's start and end are also counted as marked ones."""
    shift = _U(64 - bits)
    n = w.end - w.start
    words, out = [], []
    for k in ORDERS:
        here = np.maximum(n - k + 1, 0)
        word = np.repeat(np.arange(len(n)), here)
        at = w.start[word] + np.arange(len(word)) - np.repeat(np.cumsum(here) - here, here)
        words.append(word)
        out.append(W.mix(w.span_hash(at, at + k) + _U(k)))
    for k, salt in ((2, 40), (3, 50)):
        long_ = np.flatnonzero(n >= k)
        words += [long_, long_]
        out.append(W.mix(w.span_hash(w.start[long_], w.start[long_] + k) + _U(salt)))
        out.append(W.mix(w.span_hash(w.end[long_] - k, w.end[long_]) + _U(salt + 1)))
    return np.concatenate(words), (np.concatenate(out) >> shift).astype(np.int64)


def count_ngrams(labelled: DataFrame, text_col: str, lang_col: str, bits: int) -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language, summed per batch in
    the tasks and then by Spark."""
    def count(batches):
        for b in batches:
            lang = b.column(0).dictionary_encode()
            names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            tables = np.zeros((len(names), 1 << bits), np.int64)
            lo = 0
            for part in W.slices(b.column(1)):
                w = W.Words(part)
                word, bucket = grams(w, bits)
                key = code[lo:lo + w.n_texts][w.doc[word]].astype(np.int64) << bits | bucket
                tables += np.bincount(key, minlength=len(names) << bits).reshape(tables.shape)
                lo += w.n_texts
            for name, t in zip(names, tables):
                at = np.flatnonzero(t)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])],
                                      names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int = BITS, max_train: int = MAX_TRAIN) -> dict:
    """``langs`` (ascending) and ``logp``, a (2**bits, languages) float32 table."""
    python_ready(docs)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).count()
             .orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    bits = min(bits, int(math.log2(MOST_CELLS / max(len(sizes), 1))))       # beyond 256 languages they share fewer buckets
    if not sizes:
        return {"langs": [], "logp": np.zeros((1 << bits, 0), np.float32), "bits": bits}
    known = known.where(F.col(lang_col).cast("string").isin(list(sizes))) if len(sizes) == MOST_LANGUAGES else known
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_train / v)))])
    chosen = known.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30)) <
                         share[F.col(lang_col).cast("string")] * (1 << 30))
    got = count_ngrams(chosen, text_col, lang_col, bits).toPandas()          # at most MOST_CELLS rows
    langs = sorted(sizes)
    n = np.zeros((1 << bits, len(langs)))
    n[got["bucket"], got["lang"].map({k: i for i, k in enumerate(langs)})] = got["n"]
    prior = (n.sum(1, keepdims=True) + 0.5) / (n.sum() + 0.5 * len(n))
    smoothed = n + 50.0 * prior                            # towards all languages' distribution
    p = smoothed / np.maximum(smoothed.sum(0, keepdims=True), 1e-300)
    return {"langs": langs, "logp": np.log(p).astype(np.float32), "bits": bits}


def _em(like: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (n_docs, languages) and log-likelihoods of texts whose runs
    have the log-likelihoods ``like`` (runs, languages); ``allowed`` masks
    languages per text."""
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)[:, None]
    pi = allowed / allowed.sum(1, keepdims=True)
    top = like.max(1, keepdims=True)
    e = np.exp(like - top)
    starts = np.searchsorted(doc, np.arange(n_docs))
    some = np.flatnonzero(np.bincount(doc, minlength=n_docs))
    for _ in range(steps):
        r = e * pi[doc]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        new = np.zeros_like(pi)
        new[some] = np.add.reduceat(r, starts[some], axis=0)
        pi = np.where(n > 0, new / n, pi)
    ll = np.bincount(doc, np.log(np.maximum((e * pi[doc]).sum(1), 1e-300)) + top[:, 0], n_docs)
    return pi, ll


def infer(w: W.Words, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text of a slice: index of the predicted language, its
    proportion, and the number of languages chosen."""
    logp = model["logp"]
    k = logp.shape[1]
    word, bucket = grams(w, model["bits"])
    per = np.zeros((len(w.h), k), np.float64)
    for j in range(k):
        per[:, j] = np.bincount(word, logp[bucket, j], len(w.h))
    nth = (np.arange(len(w.h)) - w.first[:-1][w.doc]) // RUN
    counts = -(-w.counts() // RUN)
    base = np.cumsum(counts) - counts
    run = base[w.doc] + nth
    n_runs = int(counts.sum())
    like = np.zeros((n_runs, k))
    for j in range(k):
        like[:, j] = np.bincount(run, per[:, j], n_runs)
    doc = np.repeat(np.arange(w.n_texts), counts)
    pi, _ = _em(like, doc, w.n_texts, np.ones((w.n_texts, k)))
    order = np.argsort(-pi, axis=1, kind="stable")
    best_pi, size = None, np.ones(w.n_texts, np.int64)
    best = np.full(w.n_texts, -np.inf)
    rising = np.arange(w.n_texts)                           # texts whose set still grows
    for m in range(1, k + 1):
        if not len(rising):
            break
        place = np.full(w.n_texts, -1)
        place[rising] = np.arange(len(rising))
        mine = place[doc] >= 0
        allowed = np.zeros((len(rising), k))
        np.put_along_axis(allowed, order[rising, :m], 1.0, axis=1)
        fitted, ll = _em(like[mine], place[doc[mine]], len(rising), allowed)
        value = ll - (m - 1) * (0.5 * np.log(np.maximum(counts[rising], 1)) + MARGIN)
        better = value > best[rising]
        if best_pi is None:
            best_pi = fitted.copy()
        best_pi[rising[better]] = fitted[better]
        best[rising[better]] = value[better]
        size[rising[better]] = m
        rising = rising[better] if m >= TRIED else rising
    lang = best_pi.argmax(1)
    return lang, best_pi[np.arange(w.n_texts), lang] * np.clip(pi[np.arange(w.n_texts), lang], 0, 1) ** 0.5, size


def predict(text: Column, model: dict, spark) -> Column:
    """struct(lang, score, n_langs) of a text column."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("n_langs", pa.int32())])
    sent = spark.sparkContext.broadcast(model)               # at most MOST_CELLS cells

    @F.arrow_udf("struct<lang:string,score:double,n_langs:int>")
    def of(text: pa.Array) -> pa.Array:
        m, out = sent.value, []
        names = pa.array(m["langs"], pa.string())
        for part in W.slices(text):
            letters = pc.fill_null(pc.match_substring_regex(part, r"\pL"), False).to_numpy(zero_copy_only=False)
            w = W.Words(part)
            known = letters & (w.counts() > 0)
            if len(names) and len(w.h):
                lang, score, size = infer(w, m)
            else:
                lang, score, size = np.zeros(w.n_texts, np.int64), np.zeros(w.n_texts), np.zeros(w.n_texts)
                known &= bool(len(names))
            picked = pc.if_else(pa.array(known), names.take(pa.array(np.where(known, lang, 0))) if len(names) else
                                pa.array(["und"] * w.n_texts, pa.string()), "und")
            out.append(pa.StructArray.from_arrays(
                [picked, pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(np.where(known, size, 0), pa.int32())],
                fields=list(kind)))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return of(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             held_out: Column | None = None, **fit_kw) -> DataFrame:
    """All columns of ``docs`` and ``held_out``, ``lang_pred``, ``score`` and
    ``n_langs`` (columns of these names are replaced). Held-out rows teach
    nothing; by default those whose id's crc32 leaves 0 modulo 5."""
    test = F.coalesce(remainder(id_col, 5) == 0 if held_out is None else held_out, F.lit(False))
    model = fit(docs.where(~test).select(id_col, text_col, lang_col), id_col, text_col, lang_col, **fit_kw)
    p = docs.withColumn("held_out", test).withColumn("_docloom_p", predict(F.col(text_col), model, docs.sparkSession))
    return p.withColumns({"lang_pred": F.col("_docloom_p.lang"), "score": F.col("_docloom_p.score"), "n_langs": F.col("_docloom_p.n_langs")}).drop("_docloom_p")


__all__ = ["count_ngrams", "fit", "identify", "infer", "predict", "stage"]
