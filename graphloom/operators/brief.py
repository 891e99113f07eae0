"""Briefs: where a project stands, and what a question finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..graph import KnowledgeGraph
from .carving import with_columns
from .duplicates import normalized_names
from .rules import validate
from .search import TERMINAL_STATES
from .traverse import both_ways, edge_priority


def resume(graph: KnowledgeGraph, top: int = 5) -> DataFrame:
    """(section, rank, id, title, headline): newest active Investigations, oldest planned Goals, the oldest active Goal."""
    nodes = with_columns(graph.nodes, state="string", title="string", summary="string", generated_at="timestamp")
    own = nodes.select("id", "type", "state", "title", truncate(F.coalesce("summary", F.lit("")), 280).alias("headline"), F.coalesce(F.col("generated_at").cast("timestamp"), F.to_timestamp(F.lit("1970-01-01"))).alias("at"))
    parts = [
        ("investigation", own.filter("type = 'Investigation' and state = 'active'"), [F.desc("at"), "id"], top),
        ("planned-goal", own.filter("type = 'Goal' and state = 'planned'"), ["at", "id"], top),
        ("active-goal", own.filter("type = 'Goal' and state = 'active'"), ["at", "id"], 1),
    ]
    out = None
    for name, rows, order, n in parts:
        some = rows.orderBy(*order).limit(n)
        ranked = some.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "title", "headline")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def compact_relations(graph: KnowledgeGraph, ids: DataFrame, cap: int = 8) -> DataFrame:
    """Up to ``cap`` relations of each id by edge priority: (id, rank, edge_type, other, title, first_seen).

    ``first_seen``: the other node has not appeared in an earlier relation, so
    that it is told in full once.
    """
    nodes = with_columns(graph.nodes, title="string").select(F.col("id").alias("other"), "title")
    around = both_ways(graph.edges).join(ids.select(F.col("id").alias("node")), "node", "left_semi").join(nodes, "other")
    order = Window.partitionBy("node").orderBy(edge_priority(F.col("type")), "id")
    some = around.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    first = F.row_number().over(Window.partitionBy("other").orderBy("node", "rank")) == 1
    return some.select(F.col("node").alias("id"), "rank", F.col("type").alias("edge_type"), "other", "title", first.alias("first_seen"))


def evidence(matches: DataFrame, graph: KnowledgeGraph, raw_chars: int = 2000) -> DataFrame:
    """Matches with what is behind them: id, score, title, headline, raw (cut), relations."""
    nodes = with_columns(graph.nodes, title="string", summary="string", raw_content="string")
    own = nodes.select("id", "title", truncate(F.coalesce("summary", F.lit("")), 400).alias("headline"), truncate(F.col("raw_content"), raw_chars).alias("raw"))
    near = compact_relations(graph, matches.select("id")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "edge_type", "other"))).alias("relations"))
    return matches.select("id", "score").join(own, "id").join(near, "id", "left").orderBy(F.desc("score"), "id")


def health(graph: KnowledgeGraph, preset) -> DataFrame:
    """(nodes, edges, failures, first): counts, and the first five failures of validation."""
    bad = validate(graph.nodes, graph.edges, preset).filter("severity = 'error'")
    first = bad.orderBy("rule", "subject_id").limit(5).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "rule", "subject_id"))).alias("first"))
    counts = graph.nodes.agg(F.count("*").alias("nodes")).join(graph.edges.agg(F.count("*").alias("edges")), F.lit(True)).join(bad.agg(F.count("*").alias("failures")), F.lit(True))
    return counts.join(first, F.lit(True))


def auto_queries(nodes: DataFrame) -> DataFrame:
    """(query): every title and alias, to compare what two graphs find."""
    return normalized_names(nodes).select(F.col("name").alias("query")).distinct()


def open_questions(graph: KnowledgeGraph) -> DataFrame:
    """Nodes that have not ended, by type."""
    nodes = with_columns(graph.nodes, state="string")
    return nodes.filter(F.coalesce(~F.col("state").isin(*TERMINAL_STATES), F.lit(True))).groupBy("type").agg(F.count("*").alias("n"))
