"""Older graphs brought to today's types and ids, and the proof that nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..schema import Preset
from .diff import lost_rows, recall_loss
from .search import search


def canonical_type(node_type: Column, preset: Preset) -> Column:
    out = node_type
    for alias, name in preset.aliases.items():
        out = F.when(node_type == alias, name).otherwise(out)
    return out


def canonical_id(node_id: Column, preset: Preset) -> Column:
    """The id with an alias prefix replaced by the type's own; other ids stay."""
    out = node_id
    for alias, name in preset.aliases.items():
        out = F.when(node_id.startswith(f"{alias.lower()}:"), F.concat(F.lit(f"{name.lower()}:"), F.substring(node_id, len(alias) + 2, 1 << 20))).otherwise(out)
    return out


def canonical(graph: KnowledgeGraph, preset: Preset, dropped_types: tuple[str, ...] = (), dropped_edges: tuple[str, ...] = ()) -> KnowledgeGraph:
    """Types and ids canonical, edges rewritten with new ids, dropped kinds left out with the edges at them."""
    gone = graph.nodes.filter(F.col("type").isin(*dropped_types)).select("id")
    kept = graph.without(gone) if dropped_types else graph
    nodes = kept.nodes.withColumn("type", canonical_type(F.col("type"), preset)).withColumn("id", canonical_id(F.col("id"), preset))
    edges = kept.edges.filter(~F.col("type").isin(*dropped_edges)) if dropped_edges else kept.edges
    edges = edges.withColumn("src", canonical_id(F.col("src"), preset)).withColumn("dst", canonical_id(F.col("dst"), preset))
    edges = edges.withColumn("id", F.concat_ws("__", F.translate("src", ":", "_"), "type", F.translate("dst", ":", "_")))
    return KnowledgeGraph(nodes, edges.dropDuplicates(["id"]), graph.vectors)


def fidelity(expected: KnowledgeGraph, actual: KnowledgeGraph) -> DataFrame:
    """(kind, side, id): rows that one of two graphs lacks; times of generation don't count."""
    drop = [c for c in ("generated_at",) if c in expected.nodes.columns]
    nodes = lost_rows(expected.nodes.drop(*drop), actual.nodes.drop(*drop)).select(F.lit("node").alias("kind"), "side", "id")
    return nodes.unionByName(lost_rows(expected.edges, actual.edges).select(F.lit("edge").alias("kind"), "side", "id"))


def lost_recall(before: DataFrame, after: DataFrame, queries: list[str], limit: int = 10) -> DataFrame:
    """(query, id): what the first ``limit`` matches held before and no longer hold; a stated list of questions."""

    def answers(nodes: DataFrame) -> DataFrame:
        out = None
        for q in queries:
            one = search(nodes, q, limit=limit).select(F.lit(q).alias("query"), "id")
            out = one if out is None else out.unionByName(one)
        return out

    return recall_loss(answers(before), answers(after))
