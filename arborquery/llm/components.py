"""Connected components by repeated contraction, with joins and aggregations only: nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, label): for links (a, b) of longs, each node's smallest reachable node.

    Each round, every node goes to the neighbour, itself included, of the least hash; links follow and those within a
    node vanish. A constant share of the nodes goes in each round on average, whatever the graph's shape.
    Self-links and null ends are ignored; an empty table gives an empty one.
    """
    spark = links.sparkSession
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(maps))
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        near = both.groupBy("node").agg(F.min(F.struct(F.xxhash64(seed, "other").alias("h"), "other")).alias("best"))
        own = F.struct(F.xxhash64(seed, "node").alias("h"), F.col("node").alias("other"))
        step = written(near.select("node", F.least("best", own)["other"].alias("to")), "cc-step")
        maps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        before, edges = edges, written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "cc-links")
        drop(before)
    drop(edges)
    if not maps:
        return spark.createDataFrame([], "node long, label long")
    roots = maps[0]
    for step in maps[1:]:
        roots = roots.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    roots = written(roots, "cc-roots")
    least = roots.groupBy("to").agg(F.min("node").alias("label"))
    labels = written(roots.join(least, "to").select("node", "label"), "cc-labels")
    drop(roots, *maps)
    return labels
