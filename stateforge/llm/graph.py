"""Connected components of a link table, by alternating large and small stars.

Every step is a join and an aggregation that combines before its shuffle; no
node's neighbours are ever gathered, and nothing but a number a round comes
to the driver.  Each round is written to the shared folder; links that lead to the
least node already take none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateforge.llm import kit


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every edge (u > v, each once) leads to the least node of its component: no u has a second edge, up or down."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down")))).alias("end")).select("end.*")
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.count("down").alias("n")).where("down > 0 AND n > 1").limit(1).count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the component's least node."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = kit.written(edges, "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        pairs = large.join(small, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        edges = kit.written(pairs.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
