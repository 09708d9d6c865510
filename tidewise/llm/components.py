"""Connected components of an edge table by alternating large and small stars, all on tables.

Every round rewires each node's neighbours to the least node around; the edge table is written
after each round, and the rounds end when it no longer changes (an error, if that takes too many).  Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rewired = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewired.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(u, v) -> (node, root): the least node of the component, for every node that has an edge to another."""
    table = scratch.write(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        new = scratch.write(_small_star(_large_star(table)), "edges")
        scratch.drop(table)
        table = new
        state = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(table.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
