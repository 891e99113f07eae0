"""The consistency report of a vault and its index."""

import pytest

from graphloom.graph import KnowledgeGraph
from graphloom.operators import fsck
from graphloom.schema import SYSTEM
from graphloom.sources import vault, vector_index


@pytest.fixture
def graph(spark):
    n = spark.createDataFrame([("goal:s:a", "Goal", "Fast search", "a \"quoted\"\nlonger text", "active"), ("goal:s:b", "Goal", "Same", None, None), ("goal:s:c", "Goal", "same", None, "active")], "id string, type string, title string, summary string, state string")
    e = spark.createDataFrame([("e1", "refines", "goal:s:a", "goal:s:b")], "id string, type string, src string, dst string")
    return KnowledgeGraph(n, e)


def told(df):
    return {(r.rule, r.severity, r.subject_id) for r in df.collect()}


def test_rendered_files_are_canonical(spark, graph):
    files = vault.render_files(graph)
    assert {x for x in told(fsck.vault_report(files, SYSTEM)) if x[0] in ("import-parse", "duplicate-node-ids", "id-path-consistency", "round-trip", "edge-endpoints")} == set()


def test_every_fault_is_told(spark, graph):
    texts = {r.path: r.content for r in vault.render_files(graph).collect()}
    first, second, third = sorted(texts)
    broken = {
        first: texts[first].replace("goal:s:b", "goal:s:gone"),
        second: texts[second].replace("\n", "\r\n"),
        "Risk/" + third.split("/")[1]: texts[third],
        "Goal/copy.md": texts[first].replace("goal:s:b", "goal:s:gone"),
        "Goal/bad.md": "no front matter",
        "Goal/elsewhere.md": '---\nid: "goal:s:d"\ntype: "Goal"\ntitle: "Named"\n---\n',
        "Goal/hand.md": '---\ntype: "Goal"\nid: "goal:s:e"\ntitle: "hand"\ngraph_edges:\n---\n',
    }
    files = spark.createDataFrame(list(broken.items()), "path string, content string")
    entries = spark.createDataFrame([("goal:s:d",), ("goal:s:z",)], "id string")
    bad = spark.createDataFrame([("<<<<<<< HEAD",)], "line string")
    dirty = spark.createDataFrame([("Goal/bad.md",)], "path string")
    found = told(fsck.vault_report(files, SYSTEM, entries, bad, dirty))
    assert {("import-parse", "error", "Goal/bad.md"), ("duplicate-node-ids", "error", "goal:s:a"), ("edge-endpoints", "error", "e1"), ("id-path-consistency", "warn", "Goal/elsewhere.md"),
            ("id-path-consistency", "error", "Risk/" + third.split("/")[1]), ("tombstones", "warn", "goal:s:d"), ("tombstones", "error", "<<<<<<< HEAD"), ("uncommitted", "error", "Goal/bad.md")} <= found
    assert ("round-trip", "warn", second) not in found and ("tombstones", "warn", "goal:s:z") not in found
    assert ("round-trip", "warn", "Goal/hand.md") in found


def test_index(spark, graph):
    info = vector_index.IndexInfo("hash", "words", 8, False)
    index = vector_index.build_index(graph.nodes, vector_index.hash_embedder(8), info)
    assert fsck.index_report(graph.nodes, index, info).isEmpty()
    later = graph.nodes.filter("id <> 'goal:s:a'").union(spark.createDataFrame([("goal:s:n", "Goal", "New", None, None)], graph.nodes.schema)).replace("Same", "Other", "title")
    assert told(fsck.index_report(later, index, info)) == {("index-missing", "error", "goal:s:n"), ("index-orphan", "error", "goal:s:a"), ("index-stale", "warn", "goal:s:b")}
