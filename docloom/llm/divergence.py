"""Source divergence audit: which sources of a language use its terms
otherwise than the language as a whole, and otherwise than each other.

Counting is a pointer sort. Per shard (a slice of an Arrow batch of texts, whose
character buffer is read where it lies), a pointer is set on the start of every word;
slices of the pointers are put in order by multikey quicksort, whose character
is eight bytes at once: a slice is split three ways around a pivot, the equal
part goes on eight bytes deeper, a small slice is sorted outright. Words of one
spelling then stand in one run, and a run yields the occurrences and the
document frequency per (language, source). Nothing is made per word but its
pointer, no word is hashed and no spelling is copied but once a run.

A text longer than a slice is sorted slice by slice, and the slices' runs are
merged by the same sort over one pointer a run with its count, so a document
counts once however long it is.

Spark adds the shards' runs up by (language, source, term); terms of at least
``least_docs`` documents of a language are kept. With N the kept occurrences of
a group, V the language's kept terms and c a term's count, its share is
p = 1 + floor(scale * (c + 1) / (N + V)); a group's divergence at a term from q
is floor((p - q)^2 / q). Part ``term`` ranks a group's terms above the
language's share, part ``pair`` sums the divergence over all kept terms against
every other source of the language. All of it is integers.

Pairs: a language's kept terms are dealt to blocks, a task holds the counts of
one block's terms in all of the language's sources and compares the sources in
tiles, so no pair is a row before it is summed over a block.

Cases: null language, source or text is ''; a text without terms makes its
group occur with no counts; a language without kept terms has pairs of value 0
and no terms; a language of one source has no pairs; repeated rows are
documents of their own, whatever their ids; ties are ranked by the item's
bytes; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import python_ready, stage
from docloom.llm.words import slices

SCALE = 1_000_000_000
#: Pointers sorted together, and the size from which a slice is sorted outright.
SLICE = 1 << 20
SMALL = 1 << 15
#: Bytes of text in a shard (a longer text is a shard of its own).
SHARD_BYTES = 4 << 20
#: Counts (terms x sources) of a block, and of a tile of pairs.
BLOCK_CELLS = 1 << 18
TILE_CELLS = 1 << 20
_U = np.uint64
_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
#: Bytes of words, A-Z lower-cased; 0 for all others, which no word holds.
_FOLD = np.where(((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80), _LOWER, 0).astype(np.uint8)
_KEEP = np.array([0] + [((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9)], _U)


class Pointers:
    """Word-start pointers over the character buffer of an Arrow string array:
    ``start`` and ``length`` (bytes) of every word, ``doc`` (index of its text)."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        off = np.frombuffer(texts.buffers()[1], wide, n + 1, texts.offset * wide.itemsize).astype(np.int64) if n \
            else np.zeros(1, np.int64)
        m = int(off[-1] - off[0])
        self.data = np.zeros(m + 8, np.uint8)              # eight bytes beyond the last one can be read
        if m:
            np.take(_FOLD, np.frombuffer(texts.buffers()[2], np.uint8, m, int(off[0])), out=self.data[:m])
        off -= off[0]
        inside = self.data[:m] != 0
        step = np.zeros(m + 1, bool)                       # where a word starts or ends
        step[1:m] = inside[1:] != inside[:-1]
        step[0], step[m] = m > 0 and inside[0], m > 0 and inside[m - 1]
        # words that touch across two texts end and start again there
        touch = off[1:-1]
        touch = np.unique(touch[(touch > 0) & (touch < m)])
        touch = touch[inside[touch - 1] & inside[touch]]
        at = np.sort(np.concatenate([np.flatnonzero(step), touch, touch]))
        self.start, self.length = at[0::2], at[1::2] - at[0::2]
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.words = np.ndarray((m + 1,), ">u8", self.data.data, strides=(1,))

    def key(self, i: np.ndarray, depth: int) -> np.ndarray:
        """The eight bytes at ``depth`` of the words ``i`` as one number, zero beyond a word's end."""
        left = np.clip(self.length[i] - depth, 0, 8)
        at = np.minimum(self.start[i] + depth, len(self.words) - 1)
        return self.words[at].astype(_U) & _KEEP[left]

    def spelling(self, i: np.ndarray) -> pa.Array:
        """The words ``i``, lower-cased, as an Arrow string array."""
        off = np.zeros(len(i) + 1, np.int64)
        np.cumsum(self.length[i], out=off[1:])
        at = np.repeat(self.start[i] - off[:-1], self.length[i]) + np.arange(off[-1])
        return pa.Array.from_buffers(pa.large_binary(), len(i), [None, pa.py_buffer(off), pa.py_buffer(self.data[at])]) \
            .cast(pa.large_string())


def multikey_sort(p: Pointers, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pointers`` in order of their words, and the run (from 0, ascending) that each of them is in."""
    order, runs, n_runs = [], [], 0
    todo = [(pointers, p.key(pointers, 0), 0)]
    while todo:
        ptr, key, depth = todo.pop()
        if key is None:
            order.append(ptr)
            runs.append(np.full(len(ptr), n_runs))
            n_runs += 1
        elif len(ptr) > SMALL:
            sample = key[:: max(1, len(key) // 63)]
            pivot = np.partition(sample, len(sample) // 2)[len(sample) // 2]
            less, equal = key < pivot, key == pivot
            more = ~(less | equal)
            same = ptr[equal]
            deeper = (same, p.key(same, depth + 8), depth + 8) if pivot & _U(0xFF) else (same, None, depth)
            # a stack: what comes first in order goes on last; a part without keys is one finished run
            todo += [x for x in ((ptr[more], key[more], depth), deeper, (ptr[less], key[less], depth)) if len(x[0])]
        else:
            ptr, run = _sort_small(p, ptr, key, depth)
            order.append(ptr)
            runs.append(run + n_runs)
            n_runs += int(run[-1]) + 1
    return np.concatenate(order), np.concatenate(runs)


def _sort_small(p: Pointers, ptr: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A small slice: sorted by its keys, then the runs whose words go on, by the next ones."""
    by = np.argsort(key, kind="stable")
    ptr, key = ptr[by], key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while True:
        run = np.cumsum(new) - 1
        on = np.flatnonzero((np.bincount(run)[run] > 1) & (key & _U(0xFF) != 0))
        if not len(on):
            return ptr, run
        depth += 8
        deep = p.key(ptr[on], depth)
        by = np.lexsort((deep, run[on]))
        ptr[on], deep = ptr[on][by], deep[by]               # runs stay where they are
        key = np.zeros(len(ptr), _U)
        key[on] = deep
        new[on[1:]] |= (deep[1:] != deep[:-1]) & (run[on[1:]] == run[on[:-1]])


def _sorted_counts(p: Pointers, pointers: np.ndarray, group: np.ndarray, doc: np.ndarray, n: np.ndarray | None,
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row per (run, group): a pointer, the group, occurrences, documents.
    ``doc`` numbers documents so that a group's stand together."""
    n_docs = len(group)
    low = int(pointers.min())
    where = np.empty(int(pointers.max()) + 1 - low, np.int64)
    where[pointers - low] = np.arange(len(pointers))
    order, run = multikey_sort(p, pointers)
    at = where[order - low]
    both = run * n_docs + doc[at]
    by = np.argsort(both, kind="stable")
    both, order = both[by], order[by]
    weight = np.ones(len(both), np.int64) if n is None else n[at][by]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))       # (run, document)
    in_doc, cell = np.add.reduceat(weight, first), both[first]
    g = group[cell % n_docs]
    r = cell // n_docs
    head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])]))    # (run, group)
    return order[first][head], g[head], np.add.reduceat(in_doc, head), np.diff(np.append(head, len(cell)))


def term_counts(texts: pa.Array, group: np.ndarray, most: int = SLICE) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of a shard of texts, one row per
    term and group of one slice: sums over rows are right, terms may repeat."""
    p = Pointers(texts)
    by_group = np.argsort(group, kind="stable")             # documents numbered with a group's together
    number = np.empty(len(group), np.int64)
    number[by_group] = np.arange(len(group))
    group = group[by_group]
    doc = number[p.doc]
    ends = np.flatnonzero(np.concatenate([p.doc[1:] != p.doc[:-1], [True]])) + 1 if len(p.doc) else np.zeros(0, np.int64)
    parts, i = [], 0
    while i < len(p.start):
        j = int(np.searchsorted(ends, i + most, "right"))   # whole documents up to ``most`` pointers, or one
        j = int(ends[max(j - 1, np.searchsorted(ends, i, "right"))])
        if j - i <= most:
            parts.append(_sorted_counts(p, np.arange(i, j), group, doc[i:j], None))
        else:                                               # one long document: its slices' runs are merged
            runs = [_sorted_counts(p, np.arange(k, min(k + most, j)), group, doc[k:min(k + most, j)], None)
                    for k in range(i, j, most)]
            ptr, n = np.concatenate([x[0] for x in runs]), np.concatenate([x[2] for x in runs])
            parts.append(_sorted_counts(p, ptr, group, doc[ptr], n))
        i = j
    if not parts:
        return pa.array([], pa.large_string()), *(np.zeros(0, np.int64),) * 3
    ptr, g, n, docs = (np.concatenate(x) for x in zip(*parts))
    return p.spelling(ptr), g, n, docs


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), a shard being a slice of a batch's texts."""
    for batch in batches:
        i = 0
        for texts in slices(batch["text"], SHARD_BYTES):
            keys: dict = {}
            here = batch.slice(i, len(texts))
            i += len(texts)
            group = np.fromiter((keys.setdefault(k, len(keys)) for k in zip(here["lang"].to_pylist(), here["source"].to_pylist())),
                                np.int64, len(texts))
            lang, source = (pa.array([k[c] for k in keys], pa.string()) for c in (0, 1))
            term, g, n, docs = term_counts(texts, group)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), term.cast(pa.string()),
                                              pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                             ["lang", "source", "term", "n", "docs"])


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group
    and the group's documents that hold it. Nulls are ''."""
    rows = python_ready(docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                                      ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]))
    runs = rows.mapInArrow(_count_shards, "lang string, source string, term string, n bigint, docs bigint")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (F.col(n) + 1).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", up, (F.col(total) + F.col(terms)).cast("decimal(20,0)"))


def _compare(key, cells: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """One block of a language: (lang, source, item, value) for all pairs of its sources, summed over the block's terms."""
    lang = key[0].as_py()
    sources, base = groups["source"].to_pylist(), groups["base"].to_numpy().astype(np.int64)
    number = {s: i for i, s in enumerate(sources)}
    term, terms = pc.rank(cells["term"], tiebreaker="dense").to_numpy() - 1 if len(cells) else np.zeros(0, np.int64), 0
    terms = int(term.max()) + 1 if len(term) else 0
    row = np.fromiter((number[s] for s in cells["source"].to_pylist()), np.int64, len(cells))
    by = np.argsort(row, kind="stable")
    row, term, p = row[by], term[by], cells["p"].to_numpy()[by]
    at = np.searchsorted(row, np.arange(len(sources) + 1))

    def dense(a: int, b: int) -> np.ndarray:
        out = np.repeat(base[a:b, None], terms, axis=1)    # a term that a source lacks has the share of count 0
        s = slice(at[a], at[b])
        out[row[s] - a, term[s].astype(np.int64)] = p[s]
        return out

    names = pa.array(sources, pa.string())
    tile = max(1, TILE_CELLS // max(terms, 1))
    for a in range(0, len(sources), tile):
        mine = dense(a, min(a + tile, len(sources)))
        for b in range(0, len(sources), tile):
            other = mine if a == b else dense(b, min(b + tile, len(sources)))
            for i, own in enumerate(mine):
                gap = own - other
                value = (gap * gap // other).sum(axis=1)
                others = np.delete(np.arange(b, b + len(other)), [a + i - b] if b <= a + i < b + len(other) else [])
                if len(others):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(others), pa.string()), pa.array([sources[a + i]] * len(others), pa.string()),
                         names.take(pa.array(others)), pa.array(value[others - b], pa.int64())],
                        ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module's text."""
    counted = stage(count_terms(docs, text_col, lang_col, source_col), "term-counts")
    of_term = Window.partitionBy("lang", "term")            # at most a row a source
    kept = stage(counted.withColumn("all_docs", F.sum("docs").over(of_term)).withColumn("all_n", F.sum("n").over(of_term))
                 .where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "all_n"), "kept-terms")
    # totals of groups, and of languages as rows without a source
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                              ((lang_col, "lang"), (source_col, "source"))]).distinct()
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = kept.groupBy("lang", "term").agg(F.first("all_n").alias("n")).groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = stage(occurring.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")]), "groups")

    sized = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.first("terms").alias("terms"))
    blocks = sized.select("lang", F.greatest(F.lit(1), F.ceil(F.col("sources") * F.col("terms") / BLOCK_CELLS)).cast("long").alias("blocks"))
    rated = stage(kept.join(groups.join(blocks, "lang"), ["lang", "source"]).select(
        "lang", "source", "term", _share("n", "total", "terms").alias("p"),
        _share("all_n", "lang_total", "terms").alias("q"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")), "shares")

    gap = F.col("p") - F.col("q")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        F.call_function("div", gap * gap, F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    zero = F.when(F.col("terms") == 0, F.lit(1)).otherwise(
        1 + F.call_function("div", F.lit(SCALE).cast("long"), F.greatest(F.col("total") + F.col("terms"), F.lit(1)))).alias("base")
    sides = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                                               "source", zero)
    ship = python_ready(rated.select("lang", "block", "source", "term", "p"))
    sums = ship.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        _compare_tables, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


def _compare_tables(key, cells: pa.Table, groups: pa.Table) -> pa.Table:
    out = list(_compare(key, cells, groups))
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return pa.Table.from_batches(out, kinds)
