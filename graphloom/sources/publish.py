"""The commit of a change set: gates, ledger, vectors and self-check, published by one manifest.

Nodes, edges, the ledger of deletions and the vector index are tables of one
commit of a :class:`Repository`: either all show the change or none does. What
was written is read back and compared before the branch moves.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KnowledgeGraph
from ..operators import assist, duplicates, merge, mutate, rules
from ..schema import Preset
from ..session import shared_checkpoint
from . import vector_index
from .repository import Repository
from .snapshots import lost_nodes

EDGE = "id string, type string, src string, dst string"
INFO = "info string"


def graph_at(repo: Repository, commit: str) -> KnowledgeGraph:
    """Nodes, edges and vectors as of a commit."""
    own = repo.tables(commit)
    return KnowledgeGraph(own["nodes"], own["edges"], own.get("vectors"))


def import_graph(repo: Repository, graph: KnowledgeGraph, embedder: vector_index.Embedder, info: vector_index.IndexInfo, message: str = "import", branch: str = "main") -> str:
    """The first commit of a branch: a graph with its vectors and an empty ledger."""
    spark = graph.nodes.sparkSession
    nodes = shared_checkpoint(graph.nodes)
    tables = {"nodes": nodes, "edges": graph.edges, "vectors": vector_index.build_index(nodes, embedder, info), "index_info": spark.createDataFrame([(json.dumps(asdict(info)),)], INFO)}
    tables["ledger"] = _entries(nodes, graph.edges, spark.createDataFrame([], "id string, reason string, successor string"), datetime.now(timezone.utc))
    return repo.commit(tables, message, branch)


def _entries(nodes: DataFrame, edges: DataFrame, deleted: DataFrame, now: datetime) -> DataFrame:
    titled = nodes if "title" in nodes.columns else nodes.withColumn("title", F.lit(None).cast("string"))
    return mutate.tombstones(titled, edges, deleted, now).withColumn("deleted_at", F.col("deleted_at").cast("timestamp"))


def publish(repo: Repository, plan: dict, preset: Preset, embedder: vector_index.Embedder, info: vector_index.IndexInfo, branch: str = "main", acknowledged: tuple[str, ...] = (), now: datetime | None = None) -> dict:
    """Apply a plan (as from ``config.load_plan``) to the head of ``branch``.

    Returns failures, duplicates (suspects of the gate by name or vector that
    are not acknowledged) or lost; else commit, deleted (the new ledger
    entries) and suggestions. Vectors of texts that did not change are used
    again, if the index is of the same model. ValueError, with the branch
    where it was, if what was written differs from what was meant.
    """
    now = now or datetime.now(timezone.utc)
    head = repo.head(branch)
    if head is None:
        raise ValueError(f"{branch} has no commit to change")
    tables = repo.tables(head)
    spark, nodes, edges = tables["nodes"].sparkSession, tables["nodes"], tables["edges"]
    bad = mutate.plan_failures(nodes, plan["nodes"], successors=plan["successors"]).unionByName(mutate.plan_failures(edges, plan["edges"], "edge"))
    if not bad.isEmpty():
        return {"failures": bad}
    meant = mutate.apply_plan(KnowledgeGraph(nodes, edges), plan["nodes"], plan["edges"])
    after = KnowledgeGraph(shared_checkpoint(meant.nodes), shared_checkpoint(meant.edges))
    broken = rules.validate(after.nodes, after.edges, preset).filter("severity = 'error'")
    if not broken.isEmpty():
        return {"failures": broken}
    deleted = plan["nodes"].filter("op = 'delete'").select("id")
    lost = lost_nodes(nodes, after.nodes).join(deleted, "id", "left_anti")
    if not lost.isEmpty():
        return {"lost": lost}

    was = vector_index.IndexInfo(**json.loads(tables["index_info"].first().info))
    vectors = shared_checkpoint(vector_index.build_index(after.nodes, embedder, info, tables["vectors"], was))
    created = plan["nodes"].filter("op = 'create'")
    gated = created.filter(F.col("type").isin(*preset.categories.get("duplicate_check", tuple(duplicates.FAMILIES))))
    by_name = duplicates.lexical_suspects(gated, nodes)
    asked = gated.select("id", "type").join(vectors.select(F.col("node_id").alias("id"), "vector"), "id")
    by_vector = shared_checkpoint(duplicates.vector_suspects(asked, nodes, tables["vectors"])) if info.semantic else None
    known = spark.createDataFrame([(x,) for x in (*acknowledged, *plan["duplicate_ack"])], "id string")
    refused = duplicates.gate(by_name, by_vector, known).filter("status = 'rejected'")
    if not refused.isEmpty():
        pairs = by_name.select("candidate", "existing")
        pairs = pairs if by_vector is None else pairs.union(by_vector.filter("kind = 'duplicate'").select("candidate", "existing")).distinct()
        return {"duplicates": assist.told_suspects(pairs.join(refused, "candidate", "left_semi"), nodes)}

    to = deleted.join(plan["successors"].select(F.col("old").alias("id"), F.col("new").alias("successor")), "id", "left").select("id", F.lit(plan["reason"]).alias("reason"), "successor")
    entries = shared_checkpoint(_entries(nodes, edges, to, now))
    own = {"nodes": after.nodes, "edges": after.edges, "ledger": tables["ledger"].unionByName(entries), "vectors": vectors, "index_info": spark.createDataFrame([(json.dumps(asdict(info)),)], INFO)}

    def verify(written: dict[str, DataFrame]) -> None:
        merge.loss_gate(after, KnowledgeGraph(written["nodes"], written["edges"]))
        unseen = written["nodes"].select("id").join(written["vectors"].select(F.col("node_id").alias("id")), "id", "left_anti")
        untold = deleted.join(written["ledger"].select("id"), "id", "left_anti")
        for what, rows in (("without a vector", unseen), ("without a ledger entry", untold)):
            if (some := rows.limit(5).collect()):
                raise ValueError(f"{what}: " + ", ".join(r.id for r in some))

    commit = repo.commit(own, plan["reason"], branch, head, verify=verify)
    near = vectors.select(F.col("node_id").alias("id"), "vector") if info.semantic else None
    return {"commit": commit, "deleted": entries, "suggestions": assist.suggestions(after, created.select("id"), preset, near)}
