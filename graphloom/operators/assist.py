"""What goes with an answer or a commit: scope, escalation, suspects told in brief, suggestions, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..schema import Preset
from .carving import knowledge_rules, with_columns
from .similarity import top_matches

#: Reasons of a match that a brief keeps, by how they begin.
KEPT_REASONS = ("alias", "vector:", "ngram:", "coverage:", "state:")
BINDING_TYPES = ("Decision", "OperationalKnowledge", "Risk", "Constraint")


def scope_ids(*parts: DataFrame) -> DataFrame:
    """(id): every node that an answer speaks of; each part's ids are in its columns id and other."""
    out = None
    for part in parts:
        for name in ("id", "other"):
            if name in part.columns:
                own = part.select(F.col(name).cast("string").alias("id"))
                out = own if out is None else out.unionByName(own)
    return out.filter("id is not null").distinct()


def should_escalate(confidence: str | None, count: int) -> bool:
    """Whether a question goes on to the next stage: unless something was found with high confidence."""
    return not (confidence == "high" and count > 0)


def compact_reasons(reasons: Column) -> Column:
    return F.filter(reasons, lambda r: F.exists(F.array(*map(F.lit, KEPT_REASONS)), lambda k: F.startswith(r, k)))


def told_suspects(suspects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Suspect pairs (candidate, existing) with the existing node in brief, and what to do."""
    own = with_columns(nodes, title="string", summary="string", state="string").select(F.col("id").alias("existing"), F.struct("type", "title", "summary", "state").alias("brief"))
    step = F.concat(F.lit("update "), F.col("existing"), F.lit(", let a successor refine it and mark it superseded, or acknowledge it if the new one is distinct"))
    return suspects.join(own, "existing", "left").select("candidate", "existing", "brief", step.alias("next_step"))


def suggestions(graph: KnowledgeGraph, created: DataFrame, preset: Preset, vectors: DataFrame | None = None, recent: DataFrame | None = None, least: float = 0.5, top: int = 3) -> DataFrame:
    """(kind, id, other, title, similarity) for nodes just created (id).

    binding: files near a new Decision, OperationalKnowledge, Risk or
    Constraint by ``vectors`` (id, vector); led_to: active Investigations, if a
    Decision is new; premise: ``recent`` hits (id) of types that can be
    premises; debt: knowledge still without a file, counted in similarity.
    """
    nodes = with_columns(graph.nodes, title="string", state="string")
    made = nodes.join(created.select("id"), "id", "left_semi")
    row = lambda df, kind, own, other, title, n: df.select(F.lit(kind).alias("kind"), own.alias("id"), other.alias("other"), title.alias("title"), n.cast("double").alias("similarity"))
    none, nothing = F.lit(None).cast("string"), F.lit(None)
    debt = knowledge_rules(graph.nodes, graph.edges).filter("rule = 'knowledge-impl-binding-missing'").agg(F.count("*").alias("n"))
    out = row(debt, "debt", none, none, none, F.col("n"))
    new = made.filter("type = 'Decision'").agg((F.count("*") > 0).alias("some"))
    active = nodes.filter("type = 'Investigation' and state = 'active'").join(F.broadcast(new), F.lit(True)).filter("some")
    out = out.unionByName(row(active, "led_to", F.col("id"), none, F.col("title"), nothing))
    if recent is not None:
        seen = nodes.filter(F.col("type").isin(*preset.categories["premise_candidate"])).join(recent.select("id").distinct(), "id", "left_semi").join(created.select("id"), "id", "left_anti")
        out = out.unionByName(row(seen, "premise", F.col("id"), none, F.col("title"), nothing))
    if vectors is not None:
        has = vectors.select("id", "vector", F.lit("file").alias("key"))
        near = top_matches(has.join(made.filter(F.col("type").isin(*BINDING_TYPES)).select("id"), "id"), has.join(nodes.filter("type = 'File'").select("id"), "id"), "key", least, top)
        told = near.join(nodes.select(F.col("id").alias("match"), "title"), "match")
        out = out.unionByName(row(told, "binding", F.col("id"), F.col("match"), F.col("title"), F.col("similarity")))
    return out


def precheck(index_head: int | str | None, head: int | str | None, asked_lately: bool) -> list[str]:
    """Warnings before a commit: the index is of another head, or nobody asked before writing."""
    out = []
    if index_head is not None and index_head != head:
        out.append(f"index-stale: the index was built at {index_head}, the head is {head}; the duplicate gate sees an old graph")
    if not asked_lately:
        out.append("no-recent-ask: nothing was asked before this commit")
    return out
