"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together are put in descending order of size, and
each goes to the least-loaded shard, which a heap gives (ties: the lower shard).
The schedule is exact at every size: groups of one size are alike, so all that
it needs is how many groups have each size. One task streams over those
counts, largest size first, with a heap of as many loads as there are shards;
a size with many groups is dealt in closed form, as many groups to each shard
as the heap would give it. n bytes have fewer than sqrt(2 n) distinct group
sizes, 14 million for 100 TB, and the task holds one batch of them.

Groups of one size are ranked by a digest of their key, ranks counted in 256
slices of it, and the schedule says which ranks of a size go to which shard.
Slots number a shard's rows from 0 without gaps in an order shuffled by a
digest of ``order``, counted likewise; so no task sees a whole size, shard or
group, and no text takes part in any of it unless ``df`` carries it.

Cases: rows of a null group are one group; a null size is 0 and a negative one
an error; rows equal in group and ``order`` are alike, and ties beyond it are
broken by their group; a group larger than its fair share is a shard's
load alone, as it may not be cut; an empty table gives no rows; columns of any
name pass through, those named ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import python_ready, stage


def deal(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of one size each shard gets when each
    goes to the least-loaded shard; ``loads`` grow accordingly. Shard i takes
    a group at each level ``loads[i] + j * size``; the lowest levels win."""
    n = [0] * len(loads)
    if not size:
        n[loads.index(min(loads))] = groups
        return n
    if groups <= 2 * len(loads):
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(groups):
            load, i = heap[0]
            n[i] += 1
            heapq.heapreplace(heap, (load + size, i))
    else:
        below = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: E731  levels under it, per shard
        lo, hi = min(loads), max(loads) + size * groups + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if sum(below(mid)) <= groups else (lo, mid)
        n = below(lo)
        left = groups - sum(n)                              # these stand at level lo itself
        for i, load in enumerate(loads):
            if left and load <= lo and (lo - load) % size == 0:
                n[i] += 1
                left -= 1
    for i, k in enumerate(n):
        loads[i] += k * size
    return n


def _schedule(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [0] * shards
        heap = [(0, i) for i in range(shards)]
        for batch in batches:
            out = []
            for size, groups in zip(batch["size"].to_pylist(), batch["groups"].to_pylist()):
                if groups == 1:                             # most large sizes: one step of the heap
                    load, i = heap[0]
                    heapq.heapreplace(heap, (load + size, i))
                    out.append((size, i, 0, 1))
                    continue
                for load, i in heap:
                    loads[i] = load
                at = 0
                for i, k in enumerate(deal(loads, size, groups)):
                    if k:
                        out.append((size, i, at, at + k))
                        at += k
                heap = [(load, i) for i, load in enumerate(loads)]
                heapq.heapify(heap)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["size", "shard", "lo", "hi"])

    return run


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(size, shard, lo, hi): the groups of rank lo..hi-1 among those of a
    size go to a shard. ``sizes`` has one row (size, groups) per distinct size."""
    ordered = python_ready(sizes.select(F.col("size").cast("long"), F.col("groups").cast("long"))).repartition(1)
    return ordered.sortWithinPartitions(F.desc("size")).mapInArrow(_schedule(shards), "size bigint, shard int, lo bigint, hi bigint")


def _digest(*cols: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """(key, shard) per distinct ``key`` (a hex digest) of ``rows`` (key, size)."""
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("slice", F.substring("key", 1, 2)),
                   "shard-groups")
    counts = stage(groups.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("groups")), "shard-sizes")
    plan = stage(schedule(counts.groupBy("size").agg(F.sum("groups").alias("groups")), shards), "schedule")
    upto = F.sum("groups").over(Window.partitionBy("size").orderBy("slice"))       # at most 256 rows a size
    before = counts.withColumn("before", upto - F.col("groups")).select("size", "slice", "before", upto.alias("upto"))
    # the ranks of a slice that each shard takes, at most one row a shard
    pieces = stage(before.join(plan, "size").where("lo < upto and hi > before").groupBy("size", "slice").agg(
        F.first("before").alias("before"), F.collect_list(F.struct("hi", "shard")).alias("takes")), "slices")
    rank = F.row_number().over(Window.partitionBy("size", "slice").orderBy("key")) - 1
    ranked = groups.withColumn("rank", rank).join(pieces, ["size", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    mine = F.array_min(F.filter("takes", lambda t: t["hi"] > F.col("rank")))
    return ranked.select("key", mine["shard"].alias("shard"))


def assign_shards(df: DataFrame, group: Column, size: Column, shards: int = 8, order: tuple[str, ...] = ("doc_id",),
                  ) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1) and ``slot`` (from 0 within the
    shard). Rows equal in ``group`` share a shard; ``size`` is a row's load."""
    sized = F.coalesce(size.cast("long"), F.lit(0))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]).alias("row"),
                     _digest(group).alias("key"), F.when(sized < 0, F.raise_error(F.lit("a size is negative"))).otherwise(sized).alias("size"),
                     F.concat_ws(" ", *[_digest(F.col(f"`{c}`")) for c in order]).alias("turn"))
    placed = stage(group_shards(rows.select("key", "size"), shards), "shards")
    rows = stage(rows.join(placed, "key").withColumn("slice", F.substring("turn", 1, 3)), "sharded")
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))          # at most 4,096 rows a shard
    before = counts.select("shard", "slice", (F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows"))
                           .alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("turn", "key")) - 1
    return rows.withColumn("at", slot).join(before, ["shard", "slice"]).select(
        "row.*", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def text_group(text_col: str = "text") -> Column:
    """Equal texts are one group; a null text is an empty one."""
    return F.col(text_col)


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, path: str, text_col: str = "text", shards: int = 8, order: tuple[str, ...] = ("doc_id",),
                 rows_a_file: int = 1_000_000) -> DataFrame:
    """The documents with their whole texts as Parquet below ``path``, a folder
    a shard (``shard=0`` ...), and the table read back. A file holds a
    consecutive range of a shard's slots, in order."""
    placed = assign_shards(docs, text_group(text_col), text_size(text_col), shards, order)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("errorifexists")
     .option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path))
    return docs.sparkSession.read.parquet(path)


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null, as
    sizes are what the law balances)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_size(text_col).alias("size"),
                       F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))
    return assign_shards(rows, F.col("text_md5"), F.col("size"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
