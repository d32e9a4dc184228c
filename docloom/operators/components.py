"""Connected components of an edge table, as joins and groupings.

Every node holds the smallest node that it has heard of. A round tells each
node's value to its neighbours and to the node that the value names, and then
lets each node take the value of its value, so values run along chains twice as
far every round. Rounds are written to the shared folder, and end when nothing
changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges`` (ids that can be ordered):
    the smallest node that edges lead to. Self-loops and repeated edges change
    nothing, null ends are ignored."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    held = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("least")), "least")
    while True:
        # what neighbours say, and what a node's value hears through the node
        heard = both.join(held.withColumnRenamed("node", "y"), "y").select(F.col("x").alias("node"), "least")
        through = both.join(held.withColumnRenamed("node", "y"), "y").join(
            held.select(F.col("node").alias("x"), F.col("least").alias("to")), "x").select(F.col("to").alias("node"), "least")
        told = materialize(heard.unionByName(through).unionByName(held).groupBy("node").agg(F.min("least").alias("least")), "told")
        jumped = told.join(told.select(F.col("node").alias("least"), F.col("least").alias("next")), "least", "left").select(
            "node", F.least("least", F.coalesce("next", "least")).alias("least"))
        now = materialize(jumped, "least")
        changed = now.join(held.withColumnRenamed("least", "was"), "node").where("least <> was").limit(1).count()
        release(told, held)
        held = now
        if not changed:
            release(both)
            return held.withColumnRenamed("least", "component")
