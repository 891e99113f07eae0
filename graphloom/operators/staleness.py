"""Bindings that time has passed by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import finding


def commits_since(bound: DataFrame, commits: DataFrame, least: int) -> DataFrame:
    """Findings for (id, path, generated_at) with ``least`` or more commits (path, ts) at or after generated_at.

    An equi-join on the path carries the range condition, so no pair of
    different paths is ever formed.
    """
    own = bound.select("id", "path", "generated_at").distinct()
    later = own.join(commits.select("path", "ts"), "path").filter("ts >= generated_at")
    counts = later.groupBy("id", "path").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return finding(counts, "stale-binding", "id", "warn", F.col("path").cast("string"), "n")
