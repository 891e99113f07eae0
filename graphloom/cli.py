"""Verbs over a snapshot store: each prints one JSON document.

    python -m graphloom.cli search --store DIR --question "..." [--limit N]

Tables are printed whole, row by row as they arrive from the cluster.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import KnowledgeGraph
from .operators import assist, brief, builders, carving, checks, code_index, duplicates, fsck, merge, mutate, rules, search, staleness, traverse, xref
from .schema import get_preset
from .sources import config, history, ledger, session_state, vault, vector_index
from .sources.snapshots import SnapshotStore, lost_nodes


def emit(value, out) -> None:
    """Write ``value`` as JSON; a DataFrame is an array of its rows, which are never held all at once."""
    if isinstance(value, DataFrame):
        out.write("[")
        for k, row in enumerate(value.select(F.to_json(F.struct("*"))).toLocalIterator()):
            out.write(("," if k else "") + row[0])
        out.write("]")
    elif isinstance(value, dict):
        out.write("{")
        for k, (name, own) in enumerate(value.items()):
            out.write(("," if k else "") + json.dumps(name) + ": ")
            emit(own, out)
        out.write("}")
    else:
        out.write(json.dumps(value, ensure_ascii=False))


def _graph(store: SnapshotStore, args) -> KnowledgeGraph:
    return store.read(args.version)


def _files(spark, args) -> DataFrame:
    return code_index.scan_tree(spark, args.tree)


def _changed(spark, args) -> DataFrame:
    if args.paths:
        return spark.createDataFrame([(p,) for p in args.paths], "path string")
    return history.changed_files(spark, args.tree, args.revisions)


def _commit_plan(spark, store, args, plan: dict) -> dict:
    """The commit pipeline: failures, duplicates, then a version and what it suggests."""
    preset, head = get_preset(args.schema), store.head()
    now = store.read(head) if head is not None else KnowledgeGraph(plan["nodes"].drop("op", "nulls").limit(0), spark.createDataFrame([], "id string, type string, src string, dst string"))
    bad = mutate.plan_failures(now.nodes, plan["nodes"], successors=plan["successors"]).unionByName(mutate.plan_failures(now.edges, plan["edges"], "edge"))
    if not bad.isEmpty():
        return {"failures": bad}
    created = plan["nodes"].filter("op = 'create'")
    gated = created.filter(F.col("type").isin(*preset.categories.get("duplicate_check", tuple(duplicates.FAMILIES))))
    suspects = duplicates.lexical_suspects(gated, now.nodes)
    known = spark.createDataFrame([(x,) for x in (*args.ack, *plan["duplicate_ack"])], "id string")
    refused = duplicates.gate(suspects, None, known).filter("status = 'rejected'")
    if not refused.isEmpty():
        return {"duplicates": assist.told_suspects(suspects.join(refused, "candidate", "left_semi"), now.nodes)}
    after = mutate.apply_plan(now, plan["nodes"], plan["edges"])
    lost = lost_nodes(now.nodes, after.nodes).join(plan["nodes"].filter("op = 'delete'").select("id"), "id", "left_anti")  # what the plan deletes is no loss
    if not lost.isEmpty():
        return {"lost": lost}
    version = store.commit(after, head, plan["reason"], preset, may_lose=True)
    return {"version": version, "warnings": assist.precheck(args.index_head, head, args.asked), "suggestions": assist.suggestions(after, created.select("id"), preset)}


def check_store(spark, store, args):
    """Findings over a vault's files if one is named, else over the store's graph; and over a vector index (--out)."""
    preset = get_preset(args.schema)
    if args.vault:
        entries, bad = ledger.read(spark, args.log) if args.log else (None, None)
        return {"findings": fsck.vault_report(vault.read_files(spark, args.vault), preset, entries, bad)}
    graph = _graph(store, args)
    found = rules.validate(graph.nodes, graph.edges, preset)
    if args.out:
        found = found.unionByName(fsck.index_report(graph.nodes, *vector_index.read_index(spark, args.out)))
    return {"findings": found}


def ask(spark, store, args):
    graph = _graph(store, args)
    found = search.search(graph.nodes, args.question, limit=args.limit)
    sure = search.confidence(found)
    top = sure.select("confidence").first()
    behind = brief.evidence(found, graph)
    scope = assist.scope_ids(found.select("id"), brief.compact_relations(graph, found.select("id")))
    return {"matches": found, "confidence": sure, "escalate": assist.should_escalate(top and top[0], 0 if top is None else 1), "evidence": behind, "scope": scope}


def commit(spark, store, args):
    with open(args.plan, encoding="utf-8") as f:
        return _commit_plan(spark, store, args, config.load_plan(spark, f.read()))


def add(spark, store, args):
    """A typed plan of one node, committed like any other."""
    links: dict[str, list[str]] = {}
    for x in args.link:
        kind, _, to = x.partition("=")
        links.setdefault(kind, []).append(to)
    own = builders.build_add(args.kind, args.system, args.slug, args.title, args.summary or "", links, preset=get_preset(args.schema))
    return _commit_plan(spark, store, args, config.load_plan(spark, json.dumps(own)))


def vault_import(spark, store, args):
    parsed = vault.parse_files(vault.read_files(spark, args.vault))
    read = KnowledgeGraph(vault.nodes_of(parsed, ("title", "summary", "description", "state", "path")), vault.edges_of(parsed))
    return {"version": store.commit(read, store.head(), "vault import"), "errors": parsed.filter("error is not null").select("path", "error")}


def export(spark, store, args):
    graph = _graph(store, args)
    vault.export_json(graph, args.out)
    return {"wrote": args.out, "nodes": graph.nodes.count(), "edges": graph.edges.count()}


def index(spark, store, args):
    """File nodes of a source tree, and what changed against the store's."""
    made = code_index.file_facts(_files(spark, args), args.system)
    return {"files": made.select("id", "path", "language", "role", "summary")}


def vectors(spark, store, args):
    """Vectors of all nodes, by hashed words unless a server is named."""
    if args.base:
        from .sources.embedding_http import http_embedder, resolve_target

        base, model = resolve_target(args.model, args.base)
        embedder = http_embedder(base, model)
        size = len(embedder(["size"])[0])
        info = vector_index.IndexInfo("http", model, size, True, *vector_index.prefixes(model))
    else:
        embedder, info = vector_index.hash_embedder(), vector_index.IndexInfo("hash", "words", 64, False)
    made = vector_index.build_index(_graph(store, args).nodes, embedder, info)
    vector_index.write_index(made, info, args.out)
    own, kept = vector_index.read_index(spark, args.out)
    return {"index": vector_index.describe(own, kept)}


def carve(spark, store, args):
    """From a source tree to candidates and checks, in one go: index, vectors, hints, report."""
    files = _files(spark, args)
    made = code_index.file_facts(files, args.system)
    links = code_index.import_links(made)
    parts = code_index.component_candidates(made, links)
    info = vector_index.IndexInfo("hash", "words", 64, False)
    own = vector_index.build_index(made, vector_index.hash_embedder(), info).select(F.col("node_id").alias("id"), "vector", F.lit("file").alias("key"))
    ids = made.select("id", "path")
    hints = code_index.concern_hints(own, parts.join(ids, "path").select("id", "component"), "key")
    graph = _graph(store, args)
    return {"files": made.count(), "components": parts, "layers": code_index.layer_candidates(links), "hints": hints, "findings": carving.carving_report(graph, project=args.schema == "project")}


def frame_check(spark, store, args):
    entries = checks.frame_entries(_graph(store, args), _changed(spark, args))
    return {"entries": entries, "findings": checks.frame_findings(entries)}


def stale(spark, store, args):
    """Bindings whose files got commits since: the log has (path, ts)."""
    graph = _graph(store, args)
    nodes = carving.with_columns(graph.nodes, generated_at="timestamp").select("id", F.col("generated_at").cast("timestamp").alias("generated_at"))
    bound = checks.knowledge_files(graph).select("id", "path").distinct().join(nodes, "id")
    commits = spark.read.schema("path string, ts timestamp").json(args.log)
    return {"findings": staleness.commits_since(bound, commits, args.least)}


def xref_check(spark, store, args):
    graph = _graph(store, args)
    refs = graph.edges.filter(F.startswith("dst", F.lit("vault:"))).select("id", F.col("dst").alias("ref"))
    others = spark.read.schema("slug string, aliases array<string>, node string, gone boolean").json(args.vaults)
    known = others.filter("node is not null")
    found = xref.resolve(refs, others.select("slug", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).distinct(), known.filter("not coalesce(gone, false)").select("slug", "node"), known.filter("gone").select("slug", "node"))
    return {"references": found.select("id", "ref", "status", "by_alias")}


def merge_verb(spark, store, args):
    base = store.merge_base(args.branch, args.main)
    sides = [store.read(v) for v in (base, args.branch, args.main)]
    conflicts = merge.merge_conflicts(*sides)
    return {"base": base, "summary": merge.merge_summary(*sides), "conflicts": conflicts, "judgment": merge.judgment_packet(conflicts, *sides[1:])}


def harvest(spark, store, args):
    commits = history.read_git_log(spark, args.log)
    return {"reverts": history.revert_groups(commits), "tags": history.tagged_lines(_files(spark, args), "path", "content") if args.tree else []}


def allow(spark, store, args):
    """Exempt a path from the carving rules, in the exemption file."""
    raw = '{"allowed_orphans": []}'
    if os.path.exists(args.config):
        with open(args.config, encoding="utf-8") as f:
            raw = f.read()
    own = config.parse_exemptions(raw).add(args.paths[0], args.reason, args.date)
    if own.errors:
        return {"errors": list(own.errors)}
    with open(args.config, "w", encoding="utf-8") as f:
        json.dump({"allowed_orphans": [{"path": p, "reason": r, "date": d} for p, r, d in own.allowed]}, f)
    return {"allowed": len(own.allowed)}


VERBS = {
    "add": add,
    "ask": ask,
    "brief": lambda spark, store, args: {"resume": brief.resume(_graph(store, args)), "health": brief.health(_graph(store, args), get_preset(args.schema))},
    "carve": carve,
    "carving-allow": allow,
    "carving-check": lambda spark, store, args: {"findings": carving.carving_report(_graph(store, args), project=args.schema == "project")},
    "checkpoint-mark": lambda spark, store, args: {"next": session_state.CheckpointMark(args.config).mark(args.text, os.getcwd())},
    "commit-mutation": commit,
    "constraint-check": lambda spark, store, args: {"findings": checks.constraint_findings(_graph(store, args), _files(spark, args))},
    "delta-check": lambda spark, store, args: {"connected": checks.connected_knowledge(_graph(store, args), _changed(spark, args), args.limit)},
    "enforcement": lambda spark, store, args: checks.enforcement_debt(_graph(store, args)).first().asDict(),
    "evidence": lambda spark, store, args: {"evidence": brief.evidence(spark.createDataFrame([(args.id, 1.0)], "id string, score double"), _graph(store, args))},
    "export": export,
    "frame-check": frame_check,
    "fsck": check_store,
    "harvest-history": harvest,
    "index": index,
    "inspect": lambda spark, store, args: {"types": _graph(store, args).nodes.groupBy("type").count().orderBy("type"), "edges": _graph(store, args).edges.groupBy("type").count().orderBy("type"), "open": brief.open_questions(_graph(store, args))},
    "log": lambda spark, store, args: {"versions": store.log().orderBy("version")},
    "markers": lambda spark, store, args: {"markers": checks.marker_hits(_files(spark, args))},
    "merge": merge_verb,
    "neighbors": lambda spark, store, args: {"edges": traverse.neighbors_capped(_graph(store, args).edges, spark.createDataFrame([(args.id,)], "id string"), args.hops)},
    "search": lambda spark, store, args: {"matches": search.search(_graph(store, args).nodes, args.question, limit=args.limit)},
    "staleness-check": stale,
    "stocktake": lambda spark, store, args: {"suspects": checks.lifecycle_suspects(_graph(store, args), args.now or datetime.datetime.now())},
    "vault-build": lambda spark, store, args: {"files": vault.write_files(vault.render_files(_graph(store, args)), args.vault)},
    "vault-import": vault_import,
    "vector-index": vectors,
    "xref-check": xref_check,
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("verb", choices=sorted(VERBS))
    parser.add_argument("--store", required=True)
    parser.add_argument("--schema", default="system")
    parser.add_argument("--limit", type=int, default=10, help="most matches of a search, most rows of a delta check")
    for name in ("question", "id", "plan", "vault", "tree", "revisions", "log", "vaults", "out", "config", "text", "kind", "slug", "title", "summary", "reason", "date", "base", "model"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--system", default="main")
    for name in ("version", "branch", "main", "index-head"):
        parser.add_argument(f"--{name}", type=int)
    parser.add_argument("--hops", type=int, default=1, choices=(1, 2))
    parser.add_argument("--least", type=int, default=1)
    for name in ("paths", "link", "ack"):
        parser.add_argument(f"--{name}", nargs="*", default=[])
    parser.add_argument("--asked", action="store_true", help="something was asked before this commit")
    parser.add_argument("--now", type=datetime.datetime.fromisoformat)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    emit(VERBS[args.verb](spark, SnapshotStore(spark, args.store), args), sys.stdout)
    sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
