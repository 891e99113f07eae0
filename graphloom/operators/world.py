"""Several graphs side by side: profiles, hints where to ask, parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import search
from .traverse import successor_chain

CLEAR_GAP, CLEAR_TOP, INTRO_DAYS = 15.0, 40.0, 45


def profile_status(profiles: DataFrame, now) -> DataFrame:
    """``profiles`` (slug, path, name, description, modified) with hash, status and whether the introduction is old."""
    text = F.concat_ws("\n", "name", "description")
    status = F.when(F.col("path").rlike("^[a-z][a-z0-9+.-]*://|^git@") & ~F.col("path").startswith("file:"), "remote-unsupported").when(text == "", "no-profile").otherwise("ok")
    return profiles.withColumns({"hash": F.sha2(text.cast("binary"), 256), "status": status, "intro_old": F.date_diff(F.lit(now).cast("date"), F.col("modified").cast("date")) > INTRO_DAYS})


def changed_profiles(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Profiles whose text the cache (slug, hash) doesn't hold: these are embedded again."""
    return now.join(cached.select("slug", "hash"), ["slug", "hash"], "left_anti")


def world_hints(profiles: DataFrame, question: str, query_vectors=None, current: str | None = None, limit: int = 3) -> DataFrame:
    """(slug, score, rank, gap_above_next, confidence) of the graphs that a question may be meant for.

    A top that stands out by ``CLEAR_GAP`` points with ``CLEAR_TOP`` or more is
    high; others are low. ``profiles``: slug, name, description, vector.
    """
    others = profiles if current is None else profiles.filter(F.col("slug") != current)
    nodes = others.select(F.col("slug").alias("id"), F.lit("Vault").alias("type"), F.col("name").alias("title"), F.col("description").alias("summary"), *(["vector"] if "vector" in others.columns else []))
    top = search(nodes, question, query_vectors, limit=limit + 1, role_weights=None)
    order = Window.orderBy(F.desc("score"), "id")
    ranked = top.select(F.col("id").alias("slug"), "score", F.row_number().over(order).alias("rank"), F.round(F.col("score") - F.lead("score").over(order), 3).alias("gap_above_next"))
    clear = (F.col("rank") == 1) & (F.col("score") >= CLEAR_TOP) & (F.coalesce("gap_above_next", F.col("score")) >= CLEAR_GAP)
    return ranked.withColumn("confidence", F.when(clear, "high").otherwise("low")).filter(F.col("rank") <= limit)


def parent_status(vaults: DataFrame) -> DataFrame:
    """(slug, status) of (slug, parent, schema, aliases): none, self, unresolvable, schema-mismatch, cycle or resolved."""
    names = vaults.select(F.col("slug").alias("parent"), F.col("slug").alias("to"), F.col("schema").alias("their"), F.lit(0).alias("way")).unionByName(vaults.select(F.explode("aliases").alias("parent"), F.col("slug").alias("to"), F.col("schema").alias("their"), F.lit(1).alias("way")))
    best = names.groupBy("parent").agg(F.min(F.struct("way", "to", "their")).alias("b"))
    linked = vaults.join(best, "parent", "left").select("slug", "parent", "schema", F.col("b.to").alias("to"), F.col("b.their").alias("their"))
    loops = successor_chain(linked.select(F.col("slug").alias("id"), F.col("to").alias("successor"))).select(F.col("id").alias("slug"), "cyclic")
    status = F.when(F.col("parent").isNull(), "none").when(F.col("to") == F.col("slug"), "self").when(F.col("to").isNull(), "unresolvable").when(F.col("schema") != F.col("their"), "schema-mismatch").when(F.col("cyclic"), "cycle").otherwise("resolved")
    return linked.join(loops, "slug", "left").select("slug", status.alias("status"))


def xref_report(resolved: DataFrame) -> DataFrame:
    """One row of counts per status of resolved references."""
    return resolved.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("resolved", "broken", "tombstoned", "unresolvable")), F.count_if("by_alias").alias("by_alias"))
