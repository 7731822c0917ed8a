"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Rounds after which the contraction is taken to have failed; it needs about log² of the longest chain.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; ``component`` is its smallest node.

    Large-star and small-star steps alternate until nothing changes. A step replaces edges by
    edges to the smallest neighbour, found by a map-side combined ``min`` per node; no
    neighbourhood is ever gathered, so a hub with a third of all edges is one aggregation key
    that combines before it is shuffled and an AQE-splittable join. Each round is written to the
    shared folder, which cuts the lineage. Self-loops are dropped; a node without other edges
    does not appear.
    """
    now = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct(), "edges"
    )
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour v of u is linked to the least around u
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: among the neighbours of u that are not larger, all are linked to the least
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        )
        after = materialize(small, "edges")
        # a star forest: no node is both a leaf and a centre, and no leaf has two centres
        tangled = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        doubled = after.groupBy("u").count().filter("count > 1").limit(1).count()
        release(now)
        now = after
        if not tangled and not doubled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError("the contraction did not settle")
