"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link, root being the smallest node of its component.

    ``links`` has long columns u and v. Each round rewires every node's larger neighbours to the smallest one it
    knows, then the smaller ones likewise, until all components are stars. Minima are taken by aggregation before
    the shuffle; each round ends in a table, so lineage stays short. Nothing is collected but a count and a sum.
    """
    pairs = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        before, pairs = pairs, cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
        discard(before)
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
