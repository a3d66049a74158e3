"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation with partial sums and an equi-join whose hot side Spark may split; edges stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nbr = both if large else both.where("v < u")
    low = materialise(nbr.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    met = nbr.join(low, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        met = met.unionByName(low.select("u", F.col("m").alias("v")))
    return materialise(met.where("u <> v").distinct(), "edges")


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two greater-to-lesser edges or both ends: then each component is a star around its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) -> (node, root): root is the least node of node's component; every node of an edge appears once.
    Null ends and loops are left out. No edges give no rows."""
    e = materialise(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        e = _star(_star(e, large=True), large=False)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
