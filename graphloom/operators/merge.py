"""Merging two branches of a graph: deltas, conflicts, what a judge is shown, and gates against loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from . import diff as df

#: Columns that say nothing about a node's meaning.
NOISE = ("generated_at", "raw_content")


def judgment_view(nodes: DataFrame) -> DataFrame:
    """Nodes as a judge of their meaning is shown them: every column but noise."""
    return nodes.drop(*NOISE)


def after_rows(changes: DataFrame, change: str, key: str = "id") -> DataFrame:
    """The rows of one kind of change, as they are now."""
    return changes.filter(F.col("change") == change).select(key, "after.*")


def changed_nodes(changes: DataFrame, key: str = "id") -> DataFrame:
    """What an index has to take in again: added rows, and modified ones as they are now."""
    return after_rows(changes, "added", key).unionByName(after_rows(changes, "modified", key))


def merge_conflicts(base: KnowledgeGraph, branch: KnowledgeGraph, main: KnowledgeGraph, vectors: DataFrame | None = None, least: float = 0.82) -> DataFrame:
    """(signal, subject, class, detail) of what two branches of one base did to each other.

    ``vectors`` (id, vector) adds pairs of similar new Decisions.
    """
    nodes = [df.diff(base.nodes, side.nodes) for side in (branch, main)]
    edges = [after_rows(df.diff(base.edges, side.edges), "added") for side in (branch, main)]
    out = df.co_modified(*nodes).unionByName(df.edge_target_co_added(*edges))
    added = [after_rows(n, "added") for n in nodes]
    for n, e in zip(added, edges, strict=True):
        out = out.unionByName(df.decisions_without_lineage(n, e))
    if vectors is not None:
        sides = [n.filter("type = 'Decision'").select("id", "type").join(vectors.select("id", "vector"), "id") for n in added]
        alike = df.similar_decisions(*sides, least)
        out = out.unionByName(alike.select(F.lit("decision_vector_similar").alias("signal"), F.col("a").alias("subject"), F.lit("semantic").alias("class"), F.concat_ws(":", "b", "similarity").alias("detail")))
    return out.distinct()


def merge_summary(base: KnowledgeGraph, branch: KnowledgeGraph, main: KnowledgeGraph) -> DataFrame:
    """(side, kind, change, n): how many rows each side added, removed and modified."""
    out = None
    for name, side in (("branch", branch), ("main", main)):
        for kind in ("nodes", "edges"):
            rows = df.summarize(df.diff(getattr(base, kind), getattr(side, kind)), kind).select(F.lit(name).alias("side"), "kind", "change", "n")
            out = rows if out is None else out.unionByName(rows)
    return out


def judgment_packet(conflicts: DataFrame, branch: KnowledgeGraph, main: KnowledgeGraph) -> DataFrame:
    """Semantic conflicts with both sides' view of the subject as JSON: (signal, subject, detail, branch, main)."""
    shown = lambda side, name: judgment_view(side.nodes).select(F.col("id").alias("subject"), F.to_json(F.struct("*")).alias(name))
    open_ = conflicts.filter("class = 'semantic'").drop("class")
    return open_.join(shown(branch, "branch"), "subject", "left").join(shown(main, "main"), "subject", "left").select("signal", "subject", "detail", "branch", "main")


def loss_gate(expected: KnowledgeGraph, actual: KnowledgeGraph, recall: DataFrame | None = None, shown: int = 5) -> None:
    """ValueError that names the first of what a rewritten graph lost or added, or of queries (query, id) that no longer find a node."""
    for kind in ("nodes", "edges"):
        a, b = getattr(expected, kind), getattr(actual, kind)
        names = sorted(set(a.columns) & set(b.columns))
        bad = df.lost_rows(a.select(*names), b.select(*names)).select("id", "side").orderBy("id", "side").limit(shown).collect()
        if bad:
            raise ValueError(f"{kind} differ: " + ", ".join(f"{r.side} {r.id}" for r in bad))
    if recall is not None and (bad := recall.orderBy("query", "id").limit(shown).collect()):
        raise ValueError("no longer found: " + ", ".join(f"{r.id} by {r.query!r}" for r in bad))
