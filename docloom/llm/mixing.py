"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: the mix's size shared by the sources'
weights, no source more than ``most`` times its size, the excess reshared by
weight until none is above. A document of a source is expected
``target / source size`` times. Whole copies that are certain are allocated
first (the integer part of the expected copies); the rest (the fractional
part, its inclusion probability p) is drawn by Pareto order sampling: with a
uniform number u of its own, decided by a hash, a document ranks by
(u / (1 - u)) / (p / (1 - p)), and the first ones in rank are taken while they
fit the sample's fixed size in words; the last one, of those next in rank, is
the one whose size comes nearest to what is still open.

The order within a source is never sorted in one task: documents are dealt to
slots of the ranking variable's distribution, slots are summed, and only the
slot in which the size is met is put in order. All of it is DataFrame
functions.

Cases: null and empty texts have size 0 and take 0; a null source is a source
of its own, ordered last; a source of size 0 has target 0; ties in rank are
broken by id and size, rows equal in both are alike; repeated rows are
documents of their own; a null id is an id like others; an empty table gives
no rows. Reruns agree, since all chance is a hash of id, text and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded, stage

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(sources: DataFrame, cycle: tuple[float, ...], key: str = "src", null_last: str = "no_src") -> DataFrame:
    """Adds ``weight``: the cycle's values dealt to the rows in order of
    (null_last, key). Rows are ranked within range partitions, whose sizes (one
    row a partition) give the offsets; no task sees all rows."""
    ordered = stage(sources.repartitionByRange(null_last, key).withColumn("part", F.spark_partition_id()), "ordered-sources")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(null_last, key)) - 1
    return ordered.join(F.broadcast(before), "part").withColumn(
        "weight", F.element_at(F.array([F.lit(float(c)) for c in cycle]), (rank % len(cycle) + 1).cast("int"))).drop("part", "before")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to sources (src_size, weight): ``share`` times all
    sizes by weight, at most ``most`` times a source's size, the excess
    reshared by weight among the others until none is above."""
    cap = F.col("src_size") * most
    level = None                                           # words a unit of weight
    total = sources.agg(F.sum("src_size").alias("s")).first()["s"] or 0
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if not row["free"]:
            return sources.withColumn("target", cap.cast("double"))
        new = (total * share - float(row["capped"] or 0)) / float(row["free"])
        if level is not None and new <= level * (1 + 1e-15):
            return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))
        level = new


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target (of its
    source), taken (words the mix takes of it, repeats counted) and copies,
    and the columns named in ``keep``."""
    odd = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    base = stage(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("no_src"), n_words(text_col).alias("size"),
        # 52 bits of the hash, never 0 or 1
        ((F.shiftrightunsigned(odd, 12).cast("double") + 0.5) / float(1 << 52)).alias("u"),
        *[F.col(c).alias(f"_{c}") for c in keep]), "sized")
    grouped = base.groupBy("src", "no_src").agg(F.sum("size").alias("src_size"), F.count(F.lit(1)).alias("src_rows"))
    rated = targets(in_order(grouped, cycle), share, most)
    ratio = F.when(F.col("src_size") > 0, F.col("target") / F.col("src_size")).otherwise(0.0)
    sources, _ = bounded(stage(
        rated.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("src_size"))
        .withColumn("slots", F.ceil(F.sqrt("src_rows"))), "sources"))

    p, u = F.col("p"), F.col("u")
    odds = F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))
    # the ranking variable's distribution at p is known: u itself; slots of equal chance follow its order
    joined = base.join(sources, ["src", "no_src"]).withColumn("rank_by", F.coalesce(odds, u)).withColumn(
        "slot", F.floor(u * F.col("slots")))
    slots = joined.groupBy("src", "no_src", "slot").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    running = F.sum("words").over(Window.partitionBy("src", "no_src").orderBy("slot"))
    met = stage(slots.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("words"))
                .where("upto >= quota and before < quota").select("src", "no_src", F.col("slot").alias("at"), "before"), "met")
    met_side, _ = bounded(met)                              # at most one row a source
    placed = joined.join(met_side, ["src", "no_src"], "left")
    order = Window.partitionBy("src", "no_src").orderBy("rank_by", "id", "size")
    at_edge = placed.where("slot = at").withColumn(
        "upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole_slot = Window.partitionBy("src", "no_src")
    fits = F.col("upto") <= F.col("quota")
    at_edge = at_edge.withColumn("open", F.col("quota") - F.max(F.when(fits, F.col("upto")).otherwise(F.col("before"))).over(whole_slot))
    gap = F.abs(F.col("size") - F.col("open"))
    last = F.row_number().over(whole_slot.orderBy(fits, gap, "rank_by", "id")) == 1
    at_edge = at_edge.withColumn("drawn", fits | (last & (gap < F.col("open")))).drop("upto", "open")
    rest = placed.where("at is null or slot <> at").withColumn(
        "drawn", F.when(F.col("at").isNull(), F.col("quota") > 0).otherwise(F.col("slot") < F.col("at")))
    out = rest.unionByName(at_edge)
    # a source whose fractional part is nil draws nothing; one that can't meet its quota draws all
    copies = F.col("whole") + F.when(F.col("drawn") & (F.col("quota") > 0), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), "size", F.col("src_size").alias("source_size"), "target",
                      (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"_{c}").alias(c) for c in keep])

