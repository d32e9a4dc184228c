"""Embedding (EMB-1..3).

``with_hash_embedding`` is a deterministic stand-in for a sentence model:
lower-cased terms, bucket = first 32 bits of md5(term) mod dim, bucket counts,
L2-normalised, counted in an Arrow UDF. A real model plugs in through :func:`model_embedder` (Arrow-batched pandas UDF).
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import small_batches

TERM_SPLIT = r"[^\p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def terms(text) -> Column:
    return F.filter(F.split(F.lower(_c(text)), TERM_SPLIT), lambda t: t != "")


def term_buckets(text, dim: int = 64) -> Column:
    return F.transform(terms(text), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


#: Buckets of terms that a Python worker has met; emptied when it holds this many.
KNOWN_TERMS = 1 << 18
_KNOWN: dict[bytes, int] = {}


def _bucket32(term: bytes) -> int:
    """First 32 bits of the term's MD5."""
    if term not in _KNOWN:
        if len(_KNOWN) >= KNOWN_TERMS:
            _KNOWN.clear()
        _KNOWN[term] = int.from_bytes(hashlib.md5(term).digest()[:4], "big")
    return _KNOWN[term]


def _term_vectors(lists: pa.Array, dim: int) -> pa.Array:
    """The L2-normalised bucket counts of every list of terms."""
    off = lists.offsets.to_numpy().astype(np.int64)
    terms_ = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    bucket = np.array([_bucket32(t) % dim for t in terms_.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(off))
    counts = np.bincount(row * dim + (bucket[terms_.indices.to_numpy()] if len(row) else row), minlength=len(lists) * dim).reshape(len(lists), dim)
    norm = np.sqrt((counts * counts).sum(1).astype(np.float64))[:, None]
    vecs = np.divide(counts, norm, out=np.zeros(counts.shape), where=norm > 0).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, vecs.size + 1, dim, dtype=np.int32)), pa.array(vecs.ravel()),
                                    mask=lists.is_null() if lists.null_count else None)


def with_hash_embedding(df: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = 64) -> DataFrame:
    """Hash-embedding column: the terms' bucket counts, L2-normalised, as a
    FLOAT vector. Terms are split by Spark; a batch's distinct terms are hashed
    once each, and counted over Arrow arrays. No terms: zeros; null text: null."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<float>")
    def vectors(lists: pa.Array) -> pa.Array:
        return _term_vectors(lists, dim)

    keep = [c for c in df.columns if c != out]
    return df.select(*keep, vectors(terms(text_col)).alias(out))


def embed_texts(df: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = 64,
                embedder: Callable | None = None) -> DataFrame:
    """Add one vector per text. ``embedder`` is either a Column function
    (JVM) or a pandas UDF from :func:`model_embedder`; default hash embedder."""
    if embedder is None:
        return with_hash_embedding(df, text_col, out, dim)
    return df.withColumn(out, embedder(F.col(text_col)))


def model_embedder(load_model: Callable[[], Callable[[list], np.ndarray]], keep_going: bool = False):
    """Wrap a model as an Arrow-batched pandas UDF. ``load_model`` runs once
    per Python worker (cached), then each batch is one model call.
    ``keep_going``: a batch that fails is tried text by text, and a text that
    fails alone gets a null vector (:func:`ingest` reports its documents)."""
    cache: dict = {}

    def call(texts: list) -> list:
        vecs = np.asarray(cache["m"](texts), dtype=np.float32)
        if len(vecs) != len(texts):
            raise ValueError(f"{len(vecs)} vectors for {len(texts)} texts")
        return list(vecs)

    def one(text):
        try:
            return call([text])[0]
        except Exception:  # noqa: BLE001 - the text's documents are reported
            return None

    @F.pandas_udf("array<float>")
    def _embed(texts: pd.Series) -> pd.Series:
        if "m" not in cache:
            cache["m"] = load_model()
        batch = texts.fillna("").tolist()
        try:
            vecs = call(batch)
        except Exception:  # noqa: BLE001
            if not keep_going:
                raise
            vecs = [one(t) for t in batch]
        return pd.Series(vecs, dtype=object)

    return _embed


def cls_pool(token_vectors) -> Column:
    """First token's vector per row."""
    return F.get(_c(token_vectors), 0)


# Fixed value: the prefix the embedding model expects on queries.
QUERY_PREFIX = "query: "


def query_prefix(col, prefix: str = QUERY_PREFIX) -> Column:
    """Queries (not passages) get the model's query prefix before embedding."""
    return F.concat(F.lit(prefix), _c(col))
