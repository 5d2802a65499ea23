"""Connected components of a graph given as edges, by rounds of joins that shrink it.

Each round every node looks at the smallest label among its neighbours and itself and passes it on (large-star and
small-star steps of the alternating algorithm), so chains shorten by half or more each round and a star needs one. Labels
stay in Spark; the driver sees counts of edges only. Each round ends in a checkpoint, after which the files of the rounds before
go; otherwise a few edges in many partitions fill a disk, as each partition leaves files in each of a round's shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, fitted, release

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes with an edge to another node have a row."""
    now = fitted(cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()))
    for _ in range(MAX_ROUNDS):
        # large star: neighbours that are larger go to the smallest neighbour (or the node itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = fitted(cut(small))
        # both have the same size and nothing of one is missing in the other: the stars have settled
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(new, ["u", "v"], "left_anti").limit(1).count()
        now = new
        del new, both, low, large, least, small
        release(now.sparkSession)
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
