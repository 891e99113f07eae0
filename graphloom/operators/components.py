"""Connected components by alternating large and small stars.

Each round moves every node's links to the smallest neighbour, first for larger
neighbours and then for smaller ones, until all links form stars. The number of
rounds grows with the logarithm of the longest path. A round costs two
exchanges and no join, several rounds are one job, and the links that are asked
for are read once; nothing is collected but whether all links form stars, and
no neighbour list is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint

#: Rounds of a job; then links are kept and looked at.
TOGETHER = 2


def _star(links: DataFrame) -> DataFrame:
    """Links (u, v) seen from u, each once: the neighbour v, and the least m of u and its neighbours."""
    dealt = links.repartition("u").distinct()
    return dealt.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def _link(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("u"), F.col(b).alias("v"))


def _round(links: DataFrame) -> DataFrame:
    """Links (u, v), v at most u, after both stars. A loop stays until its node has a smaller neighbour."""
    large = _star(links.select(F.inline(F.array(_link("u", "v"), _link("v", "u"))))).filter("v >= u")
    small = _star(large.select(F.col("v").alias("u"), F.when(F.col("v") > F.col("u"), F.col("m")).otherwise(F.col("v")).alias("v")))
    own, other = _link("u", "m"), _link("v", "m")
    return small.select(F.inline(F.when(F.col("v") == F.col("m"), F.array(own)).otherwise(F.array(own, other))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node.

    Direction, loops, repeats and null ends of edges don't matter (a null end
    links nothing). RuntimeError if ``rounds`` do not suffice.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    for done in range(1, rounds + 1):
        links = _round(links)
        if done % TOGETHER == 0 or done == rounds:
            links = shared_checkpoint(links)
            found = links.select(F.inline(F.array(_link("u", "v"), _link("v", "v")))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"), F.max("v").alias("other"))
            if found.filter("component <> other").isEmpty():
                return found.select("node", "component")
    raise RuntimeError("components did not settle")
