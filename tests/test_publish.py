"""The commit of a change set, with all its tables."""

import json

import pytest

from graphloom.graph import KnowledgeGraph
from graphloom.schema import SYSTEM
from graphloom.sources import ledger, publish
from graphloom.sources.config import load_plan
from graphloom.sources.repository import Repository
from graphloom.sources.vector_index import IndexInfo, hash_embedder

INFO = IndexInfo("hash", "words", 32, True)
NODE = "id string, type string, title string, summary string, state string, path string, generated_at string"


@pytest.fixture
def repo(spark, tmp_path):
    made = Repository(spark, str(tmp_path / "repo"))
    rows = [("constraint:s:a", "Constraint", "Answers within a second", "fast", None, None, None), ("constraint:s:b", "Constraint", "Data stays encrypted", "keys", None, None, None), ("file:s:f", "File", "Answers within a second", None, None, "f.py", None), ("investigation:s:i", "Investigation", "Why slow", None, "active", None, None)]
    links = [("constraint_s_a__enforced_by__file_s_f", "enforced_by", "constraint:s:a", "file:s:f")]
    publish.import_graph(made, KnowledgeGraph(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, publish.EDGE)), hash_embedder(32), INFO)
    return made


def run(spark, repo, nodes, edges=(), successors=(), **more):
    plan = load_plan(spark, json.dumps({"reason": "why", "nodes": nodes, "edges": list(edges), "successors": list(successors), **more}))
    return publish.publish(repo, plan, SYSTEM, hash_embedder(32), INFO)


def test_vector_gate_refuses_and_acknowledges(spark, repo):
    twin = [{"id": "constraint:s:c", "type": "Constraint", "title": "within a second Answers", "summary": "fast"}]
    head = repo.head()
    refused = run(spark, repo, twin)
    assert {(r.candidate, r.existing) for r in refused["duplicates"].collect()} == {("constraint:s:c", "constraint:s:a")} and repo.head() == head
    done = run(spark, repo, twin, duplicate_ack=["constraint:s:a"])
    assert repo.head() == done["commit"] and repo.table("vectors").count() == 5
    kinds = {(r.kind, r.id, r.other) for r in done["suggestions"].collect()}
    assert ("binding", "constraint:s:c", "file:s:f") in kinds


def test_delete_leaves_a_ledger_entry_and_no_vector(spark, repo):
    before = {r.node_id: r.vector for r in repo.table("vectors").collect()}
    done = run(spark, repo, [{"op": "delete", "id": "constraint:s:a"}, {"op": "update", "id": "constraint:s:b", "updates": {"summary": "other keys"}}], successors=[{"old": "constraint:s:a", "new": "constraint:s:b"}])
    (entry,) = repo.table("ledger").collect()
    assert (entry.id, entry.title, entry.reason, entry.successor, list(entry.cascaded_edges)) == ("constraint:s:a", "Answers within a second", "why", "constraint:s:b", ["constraint_s_a__enforced_by__file_s_f"])
    after = {r.node_id: r.vector for r in repo.table("vectors").collect()}
    assert set(after) == set(before) - {"constraint:s:a"} and after["file:s:f"] == before["file:s:f"] and after["constraint:s:b"] != before["constraint:s:b"]
    assert repo.table("edges").isEmpty() and done["deleted"].count() == 1
    assert {(r.id, r.final) for r in ledger.final_successors(repo.table("ledger").select("id", "successor", "deleted_at", "reason")).collect()} == {("constraint:s:a", "constraint:s:b")}


def test_failures_change_nothing(spark, repo):
    head = repo.head()
    assert [r.rule for r in run(spark, repo, [{"id": "constraint:s:a", "type": "Constraint"}])["failures"].collect()] == ["create-existing-node"]
    assert run(spark, repo, [{"id": "odd:s:x", "type": "Odd", "title": "x"}])["failures"].count() == 1
    assert repo.head() == head


@pytest.mark.parametrize("fails", ["nodes", "ledger", "vectors", "verify", "ref"])
def test_faults_leave_every_table_old(spark, repo, fails):
    head = repo.head()
    count = {name: t.count() for name, t in repo.tables(head).items()}

    def stop(step):
        if step == fails:
            raise RuntimeError(step)

    repo.before = stop
    with pytest.raises(RuntimeError):
        run(spark, repo, [{"op": "delete", "id": "constraint:s:a"}])
    assert repo.head() == head and {name: t.count() for name, t in repo.tables(repo.head()).items()} == count


def test_self_check_finds_what_was_written_wrong(spark, repo, monkeypatch):
    head = repo.head()
    real = repo.commit

    def wrong(tables, *args, **more):
        return real(tables | {"nodes": tables["nodes"].filter("id <> 'file:s:f'")}, *args, **more)

    monkeypatch.setattr(repo, "commit", wrong)
    with pytest.raises(ValueError, match="nodes differ"):
        run(spark, repo, [{"op": "delete", "id": "constraint:s:b"}])
    assert repo.head() == head
