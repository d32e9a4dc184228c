"""Vector code compression: each vector becomes one byte a part.

Components are made integers, floor(scale * x), and a vector is cut into equal
consecutive parts. Every part position has a codebook of a few entries; it
starts with that part of the vectors of the smallest ids and is refined by
Lloyd rounds: every part goes to its nearest entry (squared Euclidean distance,
ties to the lower index), then an entry becomes the floor of its parts' mean.
All of it is integers, so the result depends on the rows alone.

The nearest entry is found by memoised grid cells. A part lies in a coarse cell
of a grid; over the cell's box each entry has a smallest and a largest possible
distance, and an entry whose smallest one is above the least largest one is
dominated: it is nearest nowhere in the box. The cells that a task meets are
hashed and their undominated entries kept for the task's next batches; only
these are evaluated exactly for the cell's parts. Parts whose cell shares
another cell's hash are evaluated against every entry. The grid's side follows
the entries: half the median over the components of their spread, a power of
two, as finer cells leave fewer entries and are met less often.

A round is one pass of the vectors; what leaves a task is a sum, a count and a
sum of distances per entry, and the codebooks (parts x entries) alone reach the
driver and go back.

Cases: a row whose vector is null or holds a null or non-finite component is
dropped; a null id is largest; rows of equal ids and vectors are rows of their
own; with fewer rows than entries the codebooks have as many entries as rows;
a vector of another length than the first one's, or with a component beyond
2^27 after scaling (squares no longer fit), keeps its row with null code and
error and has no part in the codebooks; a length that parts don't divide is cut
at floor(i * length / parts); equal labels' errors are added, nulls being one
label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, python_ready, stage
from docloom.llm.words import constants, mix

LIMIT = 1 << 27
#: Cells that a task keeps; beyond, the memo starts anew (results don't depend on it).
MEMO_CELLS = 1 << 18
#: (row, entry) pairs of a part that are held together.
PAIRS = 1 << 18


class Memo:
    """Nearest entries of one codebook, with the undominated entries of the cells met so far."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries                              # (entries, components) int64
        spread = np.median(entries.max(axis=0) - entries.min(axis=0)) if entries.size else 0
        self.shift = max(0, int(max(spread, 1)).bit_length() - 2)
        self.hashes = np.zeros(0, np.uint64)                # ascending
        self.cells = np.zeros((0, entries.shape[1]), np.int64)
        self.alive = np.zeros((0, len(entries)), bool)
        self.evaluated = 0

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries that are nearest somewhere in its box, as far as min/max distances tell."""
        lo = (cells << self.shift)[:, None, :]
        hi = lo + (1 << self.shift) - 1
        e = self.entries[None]
        near = np.maximum(np.maximum(lo - e, e - hi), 0)
        far = np.maximum(np.abs(e - lo), np.abs(e - hi))
        least, most = (near * near).sum(axis=2), (far * far).sum(axis=2)
        return least <= most.min(axis=1)[:, None]

    def _look_up(self, cells: np.ndarray) -> np.ndarray:
        """Undominated entries per part, from the memo; unknown cells are added first."""
        with np.errstate(over="ignore"):
            h = mix((cells.astype(np.uint64) * constants(cells.shape[1], 41)).sum(axis=1, dtype=np.uint64))
        found, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        if not known.all():
            if len(self.hashes) > MEMO_CELLS:
                self.hashes, self.cells, self.alive = self.hashes[:0], self.cells[:0], self.alive[:0]
                known[:] = False
            new = first[~known]
            step = max(1, PAIRS // 4 // len(self.entries))
            alive = np.concatenate([self.undominated(cells[new[i:i + step]]) for i in range(0, len(new), step)])
            hashes = np.concatenate([self.hashes, found[~known]])
            by = np.argsort(hashes)
            self.hashes, self.cells = hashes[by], np.concatenate([self.cells, cells[new]])[by]
            self.alive = np.concatenate([self.alive, alive])[by]
            at = np.searchsorted(self.hashes, found)
        at = at[back]
        return self.alive[at] | (self.cells[at] != cells).any(axis=1)[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each of ``parts`` (rows, components)."""
        alive = self._look_up(parts >> self.shift)
        row, entry = np.nonzero(alive)                      # by row, then entry
        gap = parts[row] - self.entries[entry]
        d = np.einsum("ij,ij->i", gap, gap)
        self.evaluated += len(row)
        start = np.searchsorted(row, np.arange(len(parts)))
        best = np.minimum.reduceat(d, start) if len(parts) else d
        hit = np.flatnonzero(d == best[row])
        lowest = hit[np.searchsorted(row[hit], np.arange(len(parts)))]
        return entry[lowest], best


def cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """List rows of one length without nulls as an int64 matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), np.int64)


def _slices(batch: pa.RecordBatch, entries: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, PAIRS // entries)
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _sums(books: list[np.ndarray], at: list[int]):
    """One row (part, entry, rows, sums) per entry that a task's parts chose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        n = np.zeros((len(books), len(books[0])), np.int64)
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for whole in batches:
            for batch in _slices(whole, len(books[0])):
                v = _matrix(batch["ints"])
                for k, memo in enumerate(memos):
                    part = v[:, at[k]:at[k + 1]]
                    entry, _ = memo.nearest(part)
                    n[k] += np.bincount(entry, minlength=len(memo.entries))
                    by = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[by], return_index=True)
                    if len(used):
                        sums[k][used] += np.add.reduceat(part[by], first, axis=0)
        k, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(n[k, e], pa.int64()),
             pa.array([sums[a][b].tolist() for a, b in zip(k, e)], pa.list_(pa.int64()))], ["part", "entry", "rows", "sums"])

    return run


def _codes(books: list[np.ndarray], at: list[int], kinds: pa.Schema):
    """Adds code and error to the rows, in place of their integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in books]
        for whole in batches:
            for batch in _slices(whole, len(books[0])):
                v = _matrix(batch["ints"])
                digits = np.zeros((len(v), 2 * len(memos)), np.uint8)
                error = np.zeros(len(v), np.int64)
                for k, memo in enumerate(memos):
                    entry, d = memo.nearest(v[:, at[k]:at[k + 1]])
                    digits[:, 2 * k], digits[:, 2 * k + 1] = _HEX[entry >> 4], _HEX[entry & 15]
                    error += d
                code = pa.Array.from_buffers(pa.string(), len(v), [
                    None, pa.py_buffer((np.arange(len(v) + 1) * digits.shape[1]).astype(np.int32)), pa.py_buffer(digits.tobytes())])
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names if c != "ints"], code, pa.array(error)], schema=kinds)

    return run


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def integers(vector: Column, scale: int = 4096) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null
    or has a null or non-finite component; components beyond the limit become
    the limit plus one."""
    wide = lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(LIMIT + 1))),
                                        F.lit(float(-LIMIT - 1)))).cast("long")
    x_bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.when(vector.isNotNull() & ~F.exists(vector, x_bad), F.transform(vector, wide))


def train(ints: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], list[int]]:
    """Codebooks after ``rounds`` rounds, and where a vector is cut. ``ints``
    (vec_id, ints) holds vectors of one length."""
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()      # ``entries`` rows
    start = np.array([r["ints"] for r in first], np.int64)
    at = cuts(start.shape[1], parts)
    books = [start[:, at[k]:at[k + 1]] for k in range(parts)]
    width = max(np.diff(at))
    for _ in range(rounds):
        sums = ints.select("ints").mapInArrow(_sums(books, at), "part int, entry int, rows bigint, sums array<bigint>")
        total = sums.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}")
                                                                                for i in range(width)]).collect()
        books = [b.copy() for b in books]
        for r in total:                                     # at most parts x entries rows
            k = r["part"]
            books[k][r["entry"]] = [r[f"s{i}"] // r["rows"] for i in range(at[k + 1] - at[k])]
    return books, at


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) for every vector kept."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    kept = stage(python_ready(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                                             integers(F.col(vector_col), scale).alias("ints"))).where("ints is not null"), "vector-ints")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    usable = F.forall("ints", lambda x: F.abs(x) <= LIMIT) & (F.size("ints") == (first["n"] if first else 0))
    ints = kept.where(usable)
    label = kept.schema["label"].dataType
    if ints.isEmpty():
        coded, sha = kept.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), fingerprint([])
    else:
        books, at = train(ints, parts, entries, rounds)
        sha = fingerprint(books)
        shape = ints.select("vec_id", "label").limit(0).toArrow().schema
        kinds = pa.schema([*shape, pa.field("code", pa.string()), pa.field("error", pa.int64())])
        coded = ints.mapInArrow(_codes(books, at, kinds),
                                f"vec_id {ints.schema['vec_id'].dataType.simpleString()}, label {label.simpleString()}, code string, error bigint")
    coded = stage(coded.unionByName(kept.where(~usable).select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                                                               F.lit(None).cast("long").alias("error"))), "vector-codes")
    sums, _ = bounded(stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        F.lit(sha).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """Adds ``approx``: the integers that a code stands for, part by part."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    entry = lambda k: F.conv(F.substring(code_col, 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approx", F.concat(*[F.get(F.get(tables, F.lit(k)), entry(k)) for k in range(len(books))]))


__all__ = ["Memo", "compress", "cuts", "decode", "fingerprint", "integers", "train"]
