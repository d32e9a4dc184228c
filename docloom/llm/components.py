"""Connected components of an edge table by alternating large-star and
small-star rounds; every round is joins and groupings, written to the shared
checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                  .select("a", F.least("a", "m").alias("m")), "large-star")
    return (both.where("b > a").join(least, "a")         # a hub's neighbours: Spark may split this join
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    turned = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` (long ids): the smallest
    id that edges lead to. Self-loops and repeated edges change nothing, null
    ends are ignored, and no edges give no rows."""
    e = stage(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
              .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"),
                    F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or not now["n"]:
            break
        seen = now
        e = stage(_small_star(_large_star(e)), "stars")
    # at rest every edge leads from a node to its component's smallest id
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
