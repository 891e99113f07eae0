"""References between graphs: vault:<slug>/<node>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^vault:([^/]+)/(.+)$"


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """Slug and node; both null if it is no such reference."""
    good = ref.rlike(PATTERN)
    return F.when(good, F.regexp_extract(ref, PATTERN, 1)), F.when(good, F.regexp_extract(ref, PATTERN, 2))


def resolve(refs: DataFrame, vaults: DataFrame, nodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``refs`` (any columns, ref) with slug, node, by_alias and status.

    vaults: (slug, aliases); nodes and tombstones: (slug, node). A slug is
    looked up by name before alias. resolved; tombstoned: the node was deleted;
    broken: it never was; unresolvable: no such vault; null: not a reference.
    """
    slug, node = parse_ref(F.col("ref"))
    names = vaults.select(F.col("slug").alias("asked"), "slug", F.lit(0).alias("way")).unionByName(vaults.select(F.explode("aliases").alias("asked"), "slug", F.lit(1).alias("way")))
    best = names.groupBy("asked").agg(F.min(F.struct("way", "slug")).alias("b")).select("asked", F.col("b.slug").alias("slug"), (F.col("b.way") == 1).alias("by_alias"))
    own = refs.withColumns({"asked": slug, "node": node}).join(best, "asked", "left")
    known = nodes.select("slug", "node").distinct().withColumn("there", F.lit(True))
    gone = tombstones.select("slug", "node").distinct().withColumn("gone", F.lit(True))
    status = F.when(F.col("asked").isNull(), None).when(F.col("slug").isNull(), "unresolvable").when(F.col("there"), "resolved").when(F.col("gone"), "tombstoned").otherwise("broken")
    return own.join(known, ["slug", "node"], "left").join(gone, ["slug", "node"], "left").withColumn("status", status).drop("there", "gone")
