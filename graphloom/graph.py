"""A property graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class KnowledgeGraph:
    """nodes (id, type, ...), edges (id, type, src, dst, ...), vectors (node_id, vector, ...)."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None

    def without(self, ids: DataFrame) -> KnowledgeGraph:
        """The graph without the nodes of ``ids`` (id) and the edges at them."""
        edges = self.edges.join(ids.select(ids["id"].alias("src")), "src", "left_anti").join(ids.select(ids["id"].alias("dst")), "dst", "left_anti")
        return KnowledgeGraph(self.nodes.join(ids, "id", "left_anti"), edges.select(*self.edges.columns), self.vectors)
