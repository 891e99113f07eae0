"""Change sets over a graph: validation, application, cascades, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..schema import Preset
from .rules import finding

IMMUTABLE = {"node": ("type",), "edge": ("type", "src", "dst")}


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "id", stamp: str | None = None, now=None) -> DataFrame:
    """``rows`` after ``changes`` (op, key, any columns, nulls: array of names to clear).

    create adds; update overwrites a field where the change's is not null and
    clears those named in nulls; delete removes. With ``stamp``, that column
    becomes ``now`` where an update changed another field and didn't set it.
    """
    names = [c for c in rows.columns if c != key]
    own = [c for c in names if c in changes.columns]
    ops = changes.select(F.col(key), F.col("op").alias("_op"), (F.coalesce("nulls", F.array().cast("array<string>")) if "nulls" in changes.columns else F.array().cast("array<string>")).alias("_nulls"), *(F.col(c).alias(f"_{c}") for c in own))
    kept = rows.join(ops.filter("_op = 'delete'"), key, "left_anti")
    updated = kept.join(ops.filter("_op = 'update'"), key, "left")

    def value(c):
        if c not in own:
            return F.when(F.array_contains("_nulls", c), F.lit(None)).otherwise(F.col(c))
        return F.when(F.array_contains("_nulls", c), F.lit(None)).otherwise(F.coalesce(F.col(f"_{c}"), F.col(c)))

    columns = {c: value(c) for c in names}
    if stamp is not None:
        moved = F.lit(False)
        for c in names:
            if c != stamp:
                moved = moved | ~F.col(c).eqNullSafe(columns[c])
        asked = F.col(f"_{stamp}").isNotNull() if stamp in own else F.lit(False)
        columns[stamp] = F.when(moved & ~asked & F.col("_op").isNotNull(), F.lit(now)).otherwise(columns[stamp])
    merged = updated.select(key, *(columns[c].cast(rows.schema[c].dataType).alias(c) for c in names))
    created = ops.filter("_op = 'create'").select(key, *((F.col(f"_{c}") if c in own else F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in names))
    return merged.unionByName(created)


def cascaded_edges(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges at deleted nodes (id), with the node that takes them along: the smaller if both go."""
    gone = deleted.select("id").distinct()
    at_src = edges.join(gone.select(F.col("id").alias("src"), F.lit(True).alias("s")), "src", "left")
    both = at_src.join(gone.select(F.col("id").alias("dst"), F.lit(True).alias("d")), "dst", "left").filter("s or d")
    by = F.when(F.col("s") & F.col("d"), F.least("src", "dst")).when(F.col("s"), F.col("src")).otherwise(F.col("dst"))
    return both.select("id", "type", "src", "dst", by.alias("deleted_with"))


def apply_plan(graph: KnowledgeGraph, node_changes: DataFrame, edge_changes: DataFrame) -> KnowledgeGraph:
    """The next graph: changes applied, edges at deleted nodes removed."""
    nodes = apply_changes(graph.nodes, node_changes)
    edges = apply_changes(graph.edges, edge_changes)
    gone = node_changes.filter("op = 'delete'").select("id")
    edges = edges.join(cascaded_edges(edges, gone).select("id"), "id", "left_anti")
    return KnowledgeGraph(nodes, edges, graph.vectors)


def plan_failures(rows: DataFrame, changes: DataFrame, kind: str = "node", successors: DataFrame | None = None) -> DataFrame:
    """Why a change set is refused: repeated ids, creating what exists, changing what doesn't, changing what is fixed."""
    ids = rows.select("id")
    out = finding(changes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), f"duplicate-{kind}-change", "id", n="n")
    out = out.unionByName(finding(changes.filter("op = 'create'").join(ids, "id", "left_semi"), f"create-existing-{kind}", "id"))
    out = out.unionByName(finding(changes.filter("op in ('update', 'delete')").join(ids, "id", "left_anti"), f"missing-{kind}", "id"))
    for c in IMMUTABLE[kind]:
        if c in changes.columns:
            was = rows.select("id", F.col(c).alias("was"))
            out = out.unionByName(finding(changes.filter("op = 'update'").join(was, "id").filter(F.col(c).isNotNull() & (F.col(c) != F.col("was"))), f"immutable-{c}", "id"))
    if successors is not None:
        deleted = changes.filter("op = 'delete'").select("id")
        out = out.unionByName(finding(successors.join(deleted, successors["old"] == deleted["id"], "left_anti"), "successor-of-kept", "old"))
        left = ids.join(deleted, "id", "left_anti").union(changes.filter("op = 'create'").select("id"))
        out = out.unionByName(finding(successors.join(left, successors["new"] == left["id"], "left_anti"), "successor-missing", "new"))
    return out


def unsourced(nodes: DataFrame, edges: DataFrame, preset: Preset) -> DataFrame:
    """Distilled nodes without an outgoing edge to a source: a File with a path, or a provenance node with its own raw text."""
    raw = F.col("raw_content") if "raw_content" in nodes.columns else F.lit(None).cast("string")
    source = ((F.col("type") == "File") & F.col("path").isNotNull()) | (F.col("type").isin("ConversationChunk", "Investigation") & raw.isNotNull() & ~raw.eqNullSafe(F.col("summary")))
    sources = nodes.filter(source).select(F.col("id").alias("dst"))
    backed = edges.join(sources, "dst", "left_semi").select(F.col("src").alias("id"))
    return finding(nodes.filter(F.col("type").isin(*preset.categories["distilled"])).join(backed, "id", "left_anti"), "source-backing", "id")


def tombstones(nodes: DataFrame, edges: DataFrame, deleted: DataFrame, now) -> DataFrame:
    """A ledger entry per deleted node (id, reason, successor): type, title, month and cascaded edges."""
    gone = deleted.select("id", "reason", "successor")
    lost = cascaded_edges(edges, gone).groupBy(F.col("deleted_with").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("cascaded_edges"))
    entries = gone.join(nodes.select("id", "type", "title"), "id", "left").join(lost, "id", "left")
    return entries.select("id", "type", "title", "reason", "successor", F.lit(now).alias("deleted_at"), F.date_format(F.lit(now), "yyyy-MM").alias("month"), F.coalesce("cascaded_edges", F.array().cast("array<string>")).alias("cascaded_edges"))


def latest(entries: DataFrame, key: str, when: str, position: str, successor: str | None = None) -> DataFrame:
    """One row per key: the last by time, one with a successor before one without, then by position."""
    order = [F.desc(when)] + ([F.desc(F.col(successor).isNotNull())] if successor else []) + [F.desc(position)]
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
