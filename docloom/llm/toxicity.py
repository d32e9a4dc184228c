"""Toxicity scores by FTRL-proximal logistic regression over hashed word
n-grams and skip-grams.

Features of a text (present or not): every word, every word's first four and
first five bytes (compounds of a stem), every word pair at a distance of one
and of two. They are hashed to 2**bits coordinates. FTRL-proximal gives each
coordinate its own learning rate and, by its L1 term, leaves most weights at
exactly zero, so the model is a short list of (coordinate, weight) pairs whose
size the number of coordinates bounds; that list goes to the workers.

Fitting: FTRL is sequential, so the labelled rows are cut into shards by a hash
of their id and the state (z, n) passes from shard to shard as a table, a task
each; a task holds one shard and the state alone. The table's rows are blocks
of coordinates. The fit uses at most about
``max_train`` labelled rows, a uniform sample by a hash of the id; a
coordinate seen in one document of a shard alone is not admitted there.

Cases: null and empty texts have no features and get the score of the bias
alone; if no labelled row is left to learn from, every score is 0; a label
that is null is no label, the larger of two labels of one id counts; a
document whose id is null is never learnt from (no label names it) and is not
held out; repeated rows are scored alike; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import words as W
from docloom.llm.common import python_ready, stage

BITS = 20
MAX_TRAIN = 20_000
#: Coordinates in a row of the state's table.
BLOCK = 1 << 14
THRESHOLD = 0.3
_U = np.uint64


def features(w: W.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, coordinate) of all features of a slice of texts, repeats included."""
    shift = _U(64 - bits)
    length = w.end - w.start
    docs, out = [w.doc], [w.h]
    for k in (4, 5):
        docs.append(w.doc)
        out.append(W.mix(w.span_hash(w.start, w.start + np.minimum(length, k)) + _U(k)))
    for gap, seed in ((1, 23), (2, 29)):
        h, at = w.grams((0, gap), seed)
        docs.append(w.doc[at])
        out.append(h)
    return np.concatenate(docs), (np.concatenate(out) >> shift).astype(np.int64)


def _unique(doc: np.ndarray, coord: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) << bits | coord)
    return key >> bits, key & ((1 << bits) - 1)


def _features_udf(bits: int):
    @F.arrow_udf("array<int>")
    def of(text: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(text):
            w = W.Words(part)
            doc, coord = _unique(*features(w, bits), bits)
            out.append(W.lists(coord.astype(np.int32), np.bincount(doc, minlength=w.n_texts), pa.int32()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    return of


class Ftrl:
    """State and step of FTRL-proximal; a coordinate's weight is closed-form in (z, n)."""

    def __init__(self, z, n, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, i=slice(None)):
        z, n = self.z[i], self.n[i]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, label: float, weight: float = 1.0) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def sample(ids: DataFrame, id_col: str, max_train: int) -> DataFrame:
    """About ``max_train`` of the rows, by a hash of the id; all if there are no more."""
    share = min(1.0, max_train / max(ids.count(), 1))
    return ids.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, bits: int = BITS,
        shards: int = 4, rounds: int = 2, alpha: float = 0.2, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0,
        ) -> dict[str, np.ndarray]:
    """The non-zero weights as arrays ``at`` (coordinate; the last one is the
    bias) and ``weight``. ``labelled`` has one row per id, a bounded number."""
    python_ready(labelled)
    rows = stage(labelled.select(F.pmod(F.xxhash64(F.lit("shard"), F.col(id_col)), F.lit(shards)).cast("int").alias("shard"),
                         F.xxhash64(F.lit("order"), F.col(id_col)).alias("turn"), F.col(label_col).cast("int").alias("y"),
                         _features_udf(bits)(text_col).alias("x")), "toxicity-fit")
    dims = (1 << bits) + 1

    def run(batches):
        z, n, seen, held = np.zeros(dims), np.zeros(dims), np.zeros(dims, np.int32), []
        for batch in batches:                                                       # in any order
            for i in np.flatnonzero(batch["block"].is_valid()):
                at = batch["block"][i].as_py() * BLOCK
                for into, name in ((z, "z"), (n, "n")):
                    of = batch[name][i].values.to_numpy()
                    into[at:at + len(of)] = of
            docs = batch.select(["turn", "y", "x"]).filter(batch["turn"].is_valid())
            if docs.num_rows:
                values = docs["x"].values.to_numpy()
                off = docs["x"].offsets.to_numpy()
                seen += np.bincount(values[off[0]:off[-1]], minlength=dims).astype(np.int32)
                held.extend(zip(docs["turn"].to_pylist(), docs["y"].to_pylist(), (values[i:j] for i, j in zip(off, off[1:]))))
            del batch, docs
        model = Ftrl(z, n, alpha, beta, l1, l2)
        for _, y, x in sorted(held, key=lambda d: d[0]):
            model.learn(np.append(x[seen[x] > 1], dims - 1).astype(np.int64), float(y))
        held = seen = None
        for block, at in enumerate(range(0, dims, BLOCK)):
            own = slice(at, at + BLOCK)
            if n[own].any():
                size = np.array([len(n[own])])
                yield pa.record_batch([pa.array([block], pa.int32()), W.lists(z[own], size, pa.float64()),
                                       W.lists(n[own], size, pa.float64())], ["block", "z", "n"])
        del z, n, model
        W.release()

    # bounded: a task holds one shard of the sampled rows and the state, which has a row a block of coordinates;
    # nothing is grouped or sorted, so that the rows pass through the JVM and are held once, in Python
    schema = "block int, z array<double>, n array<double>"
    state = rows.sparkSession.createDataFrame([], schema)
    for turn in range(rounds * shards):
        mine = rows.where(F.col("shard") == turn % shards).select("turn", "y", "x").repartition(1)
        both = mine.unionByName(state, allowMissingColumns=True).coalesce(1)
        state = stage(both.mapInArrow(run, schema), "ftrl-state")
    each = state.select("block", F.posexplode(F.arrays_zip("z", "n")).alias("i", "of"))
    kept = each.where(F.abs("of.z") > l1).select(                                   # the non-zero weights
        (F.col("block") * BLOCK + F.col("i")).alias("at"), "of.z", "of.n").orderBy("at").collect()
    at, z, n = (np.array([r[i] for r in kept], kind) for i, kind in enumerate((np.int64, float, float)))
    return {"at": at, "weight": Ftrl(z, n, alpha, beta, l1, l2).weights(), "bits": bits}


def score(text: Column | str, model: dict, spark) -> Column:
    """Probability that a text is toxic, from its whole words."""
    bits = model["bits"]
    sent = spark.sparkContext.broadcast((model["at"], model["weight"]))
    nothing = not len(model["at"])
    cache: dict = {}

    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        if "w" not in cache:
            at, weight = sent.value
            cache["w"] = np.zeros((1 << bits) + 1)
            cache["w"][at] = weight
        w_all, out = cache["w"], []
        for part in W.slices(text):
            w = W.Words(part)
            doc, coord = features(w, bits)
            hit = np.flatnonzero(w_all[coord])
            doc, coord = _unique(doc[hit], coord[hit], bits)
            total = np.bincount(doc, w_all[coord], w.n_texts) + w_all[-1]
            out.append(np.zeros(w.n_texts) if nothing else 1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return of(text)


def remainder(id_col: str, of: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % of


def learned_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", held_out: Column | None = None, max_train: int = MAX_TRAIN, **fit_kw) -> Column:
    """A score column for ``docs``, learnt from its labelled rows that aren't
    held out; by default those are whose id's crc32 leaves 2 modulo 4."""
    test = F.coalesce(remainder(id_col, 4) == 2 if held_out is None else held_out, F.lit(False))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~test).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    chosen = F.broadcast(sample(known, "_id", max_train))          # bounded by max_train
    train = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").groupBy(
        "_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    return score(F.col(text_col), fit(train, "_id", "_text", "_y", **fit_kw), docs.sparkSession)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD,
                    held_out: Column | None = None, **kw) -> DataFrame:
    """All columns of ``docs`` and ``held_out``, ``score``, ``predicted``
    (columns of these names are replaced)."""
    test = F.coalesce(remainder(id_col, 4) == 2 if held_out is None else held_out, F.lit(False))
    scored = docs.withColumns({"held_out": test, "score": learned_score(docs, labels, id_col, held_out=held_out, **kw)})
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    return docs.where(learned_score(docs, labels, **kw) < threshold)
