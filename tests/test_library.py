import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import code
from graphloom.functions import text as tx
from graphloom.graph import KnowledgeGraph
from graphloom.operators import brief, builders, carving, checks, code_index, diff, duplicates, mutate, rules, search, traverse, world
from graphloom.operators.components import connected_components
from graphloom.schema import PROJECT, SYSTEM, get_preset
from graphloom.sources import config, history, ledger, snapshots, vault, vector_index
from graphloom.streaming import state

NODE = "id string, type string, title string, summary string, state string, path string, description string, raw_content string, aliases array<string>, enforcement string, enforcement_reason string, generated_at timestamp, certainty string, role string"
NAMES = [f.split()[0] for f in NODE.split(", ")]
NOW = datetime.datetime(2026, 7, 8)


def nodes(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in NAMES) for r in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(f"{a}|{t}|{b}", t, a, b) for a, t, b in rows], "id string, type string, src string, dst string")


def found(df):
    return {(r.rule, r.subject_id) for r in df.collect()}


def test_presets():
    assert SYSTEM.allows("evidenced_by", "Pocket", "File") and not SYSTEM.allows("evidenced_by", "Decision", "File")
    assert PROJECT.allows("refines", "OK", "Decision") and len(SYSTEM.edge_types) == 16 and len(PROJECT.edge_types) == 22
    with pytest.raises(ValueError):
        get_preset("nothing")


def test_validate(spark):
    n = nodes(spark, {"id": "decision:a:x", "type": "Decision", "state": "closed"}, {"id": "goal:a:g", "type": "Goal", "state": "planned"}, {"id": "goal:a:g", "type": "Goal"}, {"id": "z", "type": "Zebra"})
    e = edges(spark, ("decision:a:x", "has_premise", "goal:a:g"), ("goal:a:g", "led_to", "decision:a:x"), ("goal:a:g", "targets", "nowhere"), ("goal:a:g", "targets", "vault:v/x"), ("z", "eats", "goal:a:g"))
    out = found(rules.validate(n, e, SYSTEM))
    assert {("bad-state", "decision:a:x"), ("duplicate-node-id", "goal:a:g"), ("unknown-node-type", "z"), ("missing-dst", "goal:a:g|targets|nowhere"), ("unknown-edge-type", "z|eats|goal:a:g"), ("edge-rule", "goal:a:g|led_to|decision:a:x")} == out


def test_required_certainty(spark):
    n = nodes(spark, {"id": "a", "type": "Assumption"}, {"id": "b", "type": "Assumption", "certainty": "Assumed"})
    assert found(rules.missing_required(n, PROJECT)) == {("required-field", "a")}


def test_text():
    assert tx.normalize("Ｈéllo—ワールド 42!") == "héllo わーるど 42" or tx.normalize("Ｈéllo—ワールド 42!").startswith("héllo")
    assert tx.grams_of("ab") == ["ab"] and tx.grams_of("abcd") == ["abc", "bcd"] and tx.grams_of("日本語") == ["日本", "本語", "日本語"]
    assert not tx.is_content_term("の") and tx.is_content_term("日") and tx.weight("a日") == 3


def test_text_columns(spark):
    df = spark.createDataFrame([("foo bar$x", "bar"), ("a.bar(", "bar"), ("Ｆｏｏ ﬁ", "x")], "line string, token string")
    assert [r[0] for r in df.select(tx.contains_token(F.col("line"), F.col("token"))).collect()] == [False, True, False]
    assert df.select(tx.normalize_text(F.col("line"), nfkc=True)).collect()[2][0] == "foo fi"
    assert df.select(tx.truncate(F.lit("abcdef"), 4)).first()[0] == "abc…"


def test_search_weights(spark):
    n = nodes(
        spark,
        {"id": "d1", "type": "Decision", "title": "payment retry"},
        {"id": "d2", "type": "Decision", "title": "payment retry", "state": "superseded"},
        {"id": "f1", "type": "File", "title": "payment retry", "role": "test"},
        {"id": "g1", "type": "Goal", "title": "retry", "aliases": ["Payment, retry!"]},
        {"id": "x", "type": "Goal", "title": "zzz"},
    )
    out = {r.id: (r.score, r.alias_exact) for r in search.search(n, "payment retry").collect()}
    assert out == {"d1": (105.0, False), "d2": (63.0, False), "f1": (55.0, False), "g1": (100.0, True)}
    assert [r.id for r in search.search(n, "payment retry", types=["File"]).collect()] == ["f1"]
    best = search.confidence(search.search(n, "payment retry")).first()
    assert best.confidence == "high"
    assert search.confidence(search.search(n, "qqqq")).count() == 0


def test_vectors_take_the_best_query(spark):
    n = spark.createDataFrame([("a", "Goal", [1.0, 0.0]), ("b", "Goal", [0.0, 1.0]), ("c", "Goal", None)], "id string, type string, vector array<double>")
    out = [(r.id, r.score) for r in search.search(n, "zz", [[0.9, 0.1], [0.0, 0.5]]).collect()]
    assert out == [("a", 90.0), ("b", 50.0)]


def test_traverse(spark):
    e = edges(spark, ("a", "t", "b"), ("b", "refines", "c"), ("c", "t", "d"), ("x", "t", "x"))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.distance) for r in traverse.khop_distance(e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src, r.depth) for r in traverse.neighbors_capped(e, seeds, depth=2).collect()} == {("a", 1), ("b", 2)}
    assert {(r.node, r.component) for r in connected_components(e, "src", "dst").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("p", "q"), ("q", "p"), ("z", "gone")], "id string, successor string")
    out = {r.id: (r.final, r.cyclic) for r in traverse.successor_chain(chain).collect()}
    assert out["a"] == ("c", False) and out["c"] == ("c", False) and out["p"] == (None, True) and out["z"] == ("gone", False)
    assert {(r.id, r.depth) for r in traverse.dependency_depth(e.filter("src <> 'x'")).collect()} == {("a", 3), ("b", 2), ("c", 1), ("d", 0)}
    assert {(r.id, r.depth) for r in traverse.dependency_depth(edges(spark, ("a", "t", "b"), ("b", "t", "a"))).collect()} == {("a", 0), ("b", 0)}


def test_long_path_is_one_component(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path).agg(F.count_distinct("component"), F.count("*")).first()[:] == (1, 301)


def test_label_propagation(spark):
    links = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "a", "c"), (0, "x", "y"), (0, "c", "x")], "grp int, a string, b string")
    out = {r.node: r.label for r in traverse.label_propagation_exact(links, "grp").collect()}
    assert out["a"] == out["b"] == out["c"]


def test_diff_and_apply(spark):
    a = nodes(spark, {"id": "a", "type": "Goal", "title": "x"}, {"id": "b", "type": "Goal", "state": "active"}, {"id": "c", "type": "Risk"}).select("id", "type", "title", "state")
    b = nodes(spark, {"id": "a", "type": "Goal", "title": "y"}, {"id": "b", "type": "Goal"}, {"id": "d", "type": "Risk", "title": "t"}).select("id", "type", "title", "state")
    changes = diff.diff(a, b)
    assert {(r.id, r.change, ",".join(r.properties)) for r in changes.collect()} == {("a", "modified", "title"), ("b", "modified", "state"), ("c", "removed", ""), ("d", "added", "")}
    op = F.when(F.col("change") == "added", "create").when(F.col("change") == "removed", "delete").otherwise("update")
    plan = changes.select("id", op.alias("op"), "after.type", "after.title", "after.state", F.filter("properties", lambda p: (p == "state") & F.col("after.state").isNull()).alias("nulls"))
    assert diff.lost_rows(b, mutate.apply_changes(a, plan)).count() == 0


def test_stamp_only_on_real_change(spark):
    n = nodes(spark, {"id": "a", "type": "Goal", "title": "x", "generated_at": datetime.datetime(2020, 1, 1)}, {"id": "b", "type": "Goal", "title": "x", "generated_at": datetime.datetime(2020, 1, 1)}).select("id", "title", "generated_at")
    c = spark.createDataFrame([("a", "update", "x"), ("b", "update", "z")], "id string, op string, title string")
    out = {r.id: r.generated_at.year for r in mutate.apply_changes(n, c, stamp="generated_at", now=NOW).collect()}
    assert out == {"a": 2020, "b": 2026}


def test_cascade_and_tombstones(spark, tmp_path):
    n = nodes(spark, {"id": "a", "type": "Goal", "title": "A"}, {"id": "b", "type": "Goal"}, {"id": "c", "type": "Goal"})
    e = edges(spark, ("a", "refines", "b"), ("b", "refines", "c"))
    changes = spark.createDataFrame([("a", "delete")], "id string, op string")
    none = spark.createDataFrame([], "id string, op string")
    after = mutate.apply_plan(KnowledgeGraph(n, e), changes, none)
    assert after.nodes.count() == 2 and [r.src for r in after.edges.collect()] == ["b"]
    gone = spark.createDataFrame([("a", "old", "b"), ("b", "old", None)], "id string, reason string, successor string")
    folder = str(tmp_path / "tombs")
    ledger.append(mutate.tombstones(n, e, gone, NOW), folder)
    (tmp_path / "tombs" / "month=2026-07" / "bad.json").write_text("{broken\n")
    entries, bad = ledger.read(spark, folder)
    assert entries.count() == 2 and bad.count() == 1
    assert {(r.id, r.final) for r in ledger.final_successors(entries).collect()} == {("a", "b"), ("b", None)}


def test_plan_failures(spark):
    n = nodes(spark, {"id": "a", "type": "Goal"}, {"id": "b", "type": "Goal"})
    c = spark.createDataFrame([("a", "create", "Goal"), ("z", "update", None), ("b", "update", "Risk"), ("a", "delete", None)], "id string, op string, type string")
    s = spark.createDataFrame([("b", "a")], "old string, new string")
    out = found(mutate.plan_failures(n, c, successors=s))
    assert {("duplicate-node-change", "a"), ("create-existing-node", "a"), ("missing-node", "z"), ("immutable-type", "b"), ("successor-of-kept", "b")} <= out


def test_source_backing(spark):
    n = nodes(spark, {"id": "d", "type": "Decision"}, {"id": "e", "type": "Decision"}, {"id": "f", "type": "File", "path": "x"}, {"id": "i", "type": "Investigation", "summary": "s", "raw_content": "s"})
    e = edges(spark, ("d", "documented_by", "f"), ("e", "derived_from", "i"))
    assert found(mutate.unsourced(n, e, SYSTEM)) == {("source-backing", "e")}


def test_duplicate_gate(spark):
    n = nodes(spark, {"id": "decision:s:a", "type": "Decision", "title": "Use Kafka!"}, {"id": "decision:s:b", "type": "Decision", "title": "use kafka", "state": "superseded"}, {"id": "decision:t:c", "type": "Decision", "title": "use kafka"})
    new = nodes(spark, {"id": "decision:s:n", "type": "Decision", "title": "x", "aliases": ["USE kafka"]})
    lexical = duplicates.lexical_suspects(new, n)
    assert [(r.candidate, r.existing) for r in lexical.collect()] == [("decision:s:n", "decision:s:a")]
    for c, kind in ((0.92, "duplicate"), (0.9199, "related"), (0.80, "related"), (0.7999, None)):
        vectors = spark.createDataFrame([("decision:s:a", [1.0, 0.0]), ("gone", [1.0, 0.0])], "node_id string, vector array<double>")
        asked = spark.createDataFrame([("decision:s:n", "Decision", [c, (1 - c * c) ** 0.5])], "id string, type string, vector array<double>")
        assert [r.kind for r in duplicates.vector_suspects(asked, n, vectors).collect()] == ([kind] if kind else [])
    ack = spark.createDataFrame([("decision:s:a",)], "id string")
    assert duplicates.gate(lexical, None, ack).first().status == "acked"
    assert duplicates.gate(lexical, None, ack.limit(0)).first().status == "rejected"


def test_project_rules(spark):
    n = nodes(
        spark, {"id": "ag1", "type": "Agreement", "state": "exploring"}, {"id": "ag2", "type": "Agreement", "state": "exploring"}, {"id": "ag3", "type": "Agreement", "state": "negotiating"},
        *({"id": f"a{k}", "type": "Agreement", "state": "active"} for k in range(3)), {"id": "s", "type": "Stakeholder"}, {"id": "t", "type": "Task"}, {"id": "done", "type": "Task", "state": "completed"},
        {"id": "as", "type": "Assumption"}, {"id": "g", "type": "Goal", "state": "active"}, {"id": "th", "type": "Theme"},
    )
    e = edges(spark, *(("s", "party_to", f"a{k}") for k in range(3)))
    assert found(carving.project_rules(n, e)) == {
        ("agreement-exploring-concentration", "ag1"), ("agreement-exploring-concentration", "ag2"), ("agreement-negotiating-stagnation", "ag3"), ("stakeholder-overload", "s"),
        ("task-resource-gap", "t"), ("assumption-orphan", "as"), ("goal-no-task", "g"), ("theme-empty", "th"),
    }


def test_constraints_and_markers(spark):
    n = nodes(
        spark, {"id": "constraint:s:a", "type": "Constraint"}, {"id": "constraint:s:b", "type": "Constraint", "enforcement": "none"}, {"id": "constraint:s:c", "type": "Constraint"},
        {"id": "constraint:s:d", "type": "Constraint", "enforcement": "none", "enforcement_reason": "law"}, {"id": "decision:s:x", "type": "Decision", "state": "superseded"}, {"id": "decision:s:y", "type": "Decision"},
    )
    e = edges(spark, ("constraint:s:c", "enforced_by", "file:s:t/c.test.ts"), ("constraint:s:d", "enforced_by", "file:s:gone.ts"), ("decision:s:y", "refines", "decision:s:x"))
    files = spark.createDataFrame(
        [("t/c.test.ts", "it.skip('x')\n// kg:enforces constraint:s:zz\n"), ("t/a.ts", "// kg:enforces constraint:s:a\n'kg:enforces constraint:s:q'\n// kg:see decision:s:x"), ("a.md", "kg:see decision:s:none")], "path string, content string"
    )
    g = KnowledgeGraph(n, e)
    assert {r[0] for r in found(checks.constraint_findings(g, files))} == {"contradictory-enforcement", "unenforceable-no-reason", "unguarded", "enforcer-missing", "enforcer-skipped", "marker-missing", "orphan-marker", "unregistered-enforcer"}
    tombs = spark.createDataFrame([("constraint:s:zz", "constraint:s:a")], "id string, final string")
    out = {(r.rule, r.detail) for r in checks.marker_findings(checks.marker_hits(files), g, tombs).collect()}
    assert out == {("marker-tombstoned-ref", "constraint:s:zz>constraint:s:a"), ("marker-superseded-ref", "decision:s:x>decision:s:y")}


def test_lifecycle(spark):
    old, new = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 7, 1)
    n = nodes(
        spark, {"id": "i1", "type": "Investigation"}, {"id": "i2", "type": "Investigation", "state": "active", "generated_at": old}, {"id": "i3", "type": "Investigation", "state": "active", "generated_at": new},
        {"id": "i4", "type": "Investigation", "state": "active"}, {"id": "g1", "type": "Goal", "state": "planned", "generated_at": old}, {"id": "g2", "type": "Goal", "state": "active", "generated_at": new},
        {"id": "g3", "type": "Goal", "state": "abandoned"}, {"id": "c", "type": "Constraint"},
    )
    out = {r.id: tuple(r.signals) for r in checks.lifecycle_suspects(KnowledgeGraph(n, edges(spark, ("c", "has_premise", "g3"))), NOW).collect()}
    assert out == {"i1": ("stateless",), "i2": ("stale-active",), "i4": ("stale-active", "no-generated-at"), "g1": ("stale-planned-goal",), "c": ("settled-premise", "abandoned-premise")}


def test_echoes_skip_homes_and_imports(spark):
    n = nodes(spark, {"id": "d", "type": "Decision", "aliases": ["RetryPolicy", "retry"]}, {"id": "file:s:a.ts", "type": "File", "path": "a.ts"})
    g = KnowledgeGraph(n, edges(spark, ("d", "documented_by", "file:s:a.ts")))
    added = spark.createDataFrame([("a.ts", 1, "RetryPolicy()"), ("b.ts", 2, "new RetryPolicy()"), ("b.ts", 3, "import { RetryPolicy } from 'a'"), ("b.ts", 4, "MyRetryPolicy retry")], "path string, line_no int, line string")
    assert [(r.path, r.line_no) for r in checks.authority_echoes(g, added).collect()] == [("b.ts", 2)]


def test_roles_and_symbols(spark):
    paths = {"src/x.test.ts": "test", "README.md": "documentation", "docs/a.py": "documentation", "a.yaml": "config", "app/x.tsx": "ui_component", "api/x.ts": "api_route", "src/index.ts": "entrypoint", ".env": "config", "src/types.ts": "config", "src/a.ts": "source", "bin/run": "entrypoint"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", code.role(F.col("path"))).collect()} == paths
    ts = spark.createDataFrame([("export function a(){}\nimport x from './b'\nclass Q {}\nfunction a(){}",)], "t string")
    assert ts.select(*(code.symbols(F.lit("typescript"), F.col("t"), k) for k in ("exported", "local", "imports"))).first()[:] == (["a"], ["Q", "a"], ["./b"])


def test_code_index(spark, tmp_path):
    tree = {"src/a/x.ts": "import y from './y'\nexport const X = 1", "src/a/y.ts": "import z from '../b/z.js'", "src/b/z.ts": "import w from '@/b/w'", "src/b/w.ts": "x", "node_modules/q.ts": "", "bin.ts": "\x00", "R.md": "# Title\n## Two"}
    for path, content in tree.items():
        place = tmp_path / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(content)
    files = code_index.file_facts(code_index.scan_tree(spark, str(tmp_path)), "s")
    assert {r.path for r in files.select("path").collect()} == {"src/a/x.ts", "src/a/y.ts", "src/b/z.ts", "src/b/w.ts", "R.md"}
    links = code_index.import_links(files)
    assert {(r.a, r.b) for r in links.collect()} == {("src/a/x.ts", "src/a/y.ts"), ("src/a/y.ts", "src/b/z.ts"), ("src/b/z.ts", "src/b/w.ts")}
    assert {(r.path, r.band) for r in code_index.layer_candidates(links, 4, 1).collect()} == {("src/a/x.ts", 3), ("src/a/y.ts", 2), ("src/b/z.ts", 1), ("src/b/w.ts", 0)}
    assert code_index.component_candidates(files, links, 2).count() > 0
    assert {r.change for r in code_index.change_status(files, files).collect()} == {"unchanged"}
    assert files.filter("path = 'R.md'").first().headings == ["Title", "Two"]


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"))
    n = nodes(spark, {"id": "goal:s:a", "type": "Goal"}, {"id": "goal:s:b", "type": "Goal"})
    e = edges(spark)
    assert store.commit(KnowledgeGraph(n, e), None, "one", SYSTEM) == 0
    with pytest.raises(snapshots.Conflict):
        store.commit(KnowledgeGraph(n, e), None, "again")
    with pytest.raises(ValueError, match="lose"):
        store.commit(KnowledgeGraph(n.limit(1), e), 0, "two")
    with pytest.raises(ValueError, match="bad-state"):
        store.commit(KnowledgeGraph(n.withColumn("state", F.lit("odd")), e), 0, "two", SYSTEM)
    assert store.commit(KnowledgeGraph(n.limit(1), e), 0, "two", may_lose=True) == 1
    assert store.read().nodes.count() == 1 and store.read(0).nodes.count() == 2 and store.merge_base(1, 0) == 0
    now, before = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"), spark.createDataFrame([("a", "1"), ("c", "3")], "path string, content string")
    assert {(r.path, r.action) for r in snapshots.changed_files(now, before).collect()} == {("b", "create"), ("c", "delete")}


def test_vault_files(spark, tmp_path):
    hostile = 'a "quoted" \\ back\nline\ttab --- end: x'
    n = spark.createDataFrame([("goal:s:a", "Goal", "Same", hostile), ("goal:s:b", "Goal", "same", None), ("risk:s:c", "Risk", None, "yes")], "id string, type string, title string, summary string")
    e = edges(spark, ("goal:s:a", "refines", "goal:s:b"))
    files = vault.render_files(KnowledgeGraph(n, e))
    assert vault.write_files(files, str(tmp_path)) == 3
    read = vault.parse_files(vault.read_files(spark, str(tmp_path)))
    assert diff.lost_rows(n, vault.nodes_of(read, ("title", "summary"))).count() == 0
    assert diff.lost_rows(e, vault.edges_of(read)).count() == 0
    assert found(checks.storage_findings(read)) == set()


def test_front_matter():
    text = '---\r\nid: x\ntype: Goal\nn: 007\nf: 1.5\nb: true\nnone: null\nlist:\n  - a\n  - k: 1\n    l: "q\\n"\nmap:\n  de:\n    t: z\nblock: |-\n  one\n\n  two\ngraph_edges:\n  - id: e\n    type: t\n    to: y\n---\nbody\n<!-- kg:description:begin -->\nD\n<!-- kg:description:end -->\n'
    out = vault.parse_file(text)
    assert out["error"] is None and out["edges"] == [{"id": "e", "type": "t", "src": "x", "dst": "y"}]
    assert out["fields"] | {} == {"n": "007", "f": "1.5", "b": "true", "list": json.dumps(["a", {"k": 1, "l": "q\n"}]), "map": json.dumps({"de": {"t": "z"}}), "block": "one\n\ntwo", "description": "D"}
    assert vault.parse_file("no fence")["error"] and vault.parse_file("---\n  bad\n---\n")["error"]


def test_vector_index(spark, tmp_path):
    n = nodes(spark, {"id": "a", "type": "Goal", "title": "x"}, {"id": "b", "type": "Goal", "title": "y"})
    info = vector_index.IndexInfo("hash", "nomic-embed-text", 16, document_prefix=vector_index.prefixes("nomic-embed-text:v1.5")[0])
    index = vector_index.build_index(n, vector_index.hash_embedder(16), info)
    vector_index.write_index(index, info, str(tmp_path / "i"))
    stored, told = vector_index.read_index(spark, str(tmp_path / "i"))
    assert told == info and stored.filter("abs(norm - 1) > 1e-9").count() == 0

    def refuse(texts):
        raise AssertionError(texts)

    again = vector_index.build_index(n, refuse, info, stored, info)
    assert again.count() == 2
    with pytest.raises(Exception, match="finite"):
        vector_index.build_index(n, lambda texts: [[1.0]] * len(texts), info).count()
    delta = spark.createDataFrame([("a", [1.0] * 16, "h", 4.0)], stored.schema)
    assert vector_index.overlay(stored, delta, info, info).filter("text_hash = 'h'").count() == 1


def test_config(spark):
    assert config.parse_env("export A='b c'\n# x\nB=1\nbad line") == {"A": "b c", "B": "1"}
    assert [v["remote"] for v in config.parse_world('{"vaults": ["a", {"path": "git@x", "slug": "s"}]}')] == [False, True]
    for bad in ('{"vaults": [{"path": "a", "x": 1}]}', "[]", '{"vaults": ["a", "a"]}'):
        with pytest.raises(ValueError):
            config.parse_world(bad)
    out = config.parse_exemptions('{"allowed_orphans": [{"path": "a", "reason": "r", "date": "2026-01-01"}, {"path": "b*", "reason": "r", "date": "2026-01-01"}, {"path": "a", "reason": "r", "date": "2026-01-01"}, {"path": "c", "reason": "r", "date": "x"}]}')
    assert len(out.allowed) == 1 and len(out.errors) == 3 and out.remove("a").allowed == ()
    df = spark.createDataFrame([("---\r\nname: N\nparent: p\nvault_slug_aliases: [x, 'y']\n---\nBody",)], "t string")
    r = df.select(*(c.alias(n) for n, c in config.profile_columns(F.col("t")).items())).first()
    assert (r.name, r.parent, r.schema, r.slug_aliases, r.description) == ("N", "p", "system", ["x", "y"], "Body")


def test_builders_and_plans(spark):
    with pytest.raises(ValueError):
        builders.build_add("Constraint", "s", "x", "t", "s")
    with pytest.raises(ValueError):
        builders.build_add("Assumption", "s", "x", "t", "s", certainty="Maybe")
    with pytest.raises(ValueError):
        builders.build_add("Goal", "s", "Bad Slug", "t", "s")
    with pytest.raises(ValueError):
        builders.build_add("Goal", "s", "x", "t", "s", links={"led_to": ["decision:s:y"]})
    plan = builders.build_add("Decision", "s", "x", "T", "S", links={"documented_by": ["file:s:a.ts"]})
    assert plan["edges"][0]["id"] == "decision_s_x__documented_by__file_s_a.ts"
    assert [f["id"] for f in builders.missing_evidence(plan, set(), {"a.ts"})] == ["file:s:a.ts"]
    loaded = config.load_plan(spark, json.dumps(plan))
    assert loaded["nodes"].count() == 1 and loaded["edges"].first().src == "decision:s:x"
    with pytest.raises(ValueError):
        config.load_plan(spark, '{"reason": "r", "nodes": [{"op": "burn", "id": "x"}]}')


def test_history(spark, tmp_path):
    (tmp_path / "log").write_text("h1\x1f2026-01-01\x1fRevert \"Revert \"x\"\"\x1f\x1e\nh2\x1f2026-01-02\x1fx\x1fThis reverts commit 1\x1e\nh3\x1f2026\x1fy\x1f\x1e\n")
    log = history.read_git_log(spark, str(tmp_path / "log"))
    assert log.count() == 3 and [(r.reverted, r.reverts) for r in history.revert_groups(log).collect()] == [("x", 2)]
    diff_text = "--- a/f.py\n+++ b/f.py\n@@ -1,2 +3,3 @@\n ctx\n+new\n-old\n+two\n+++ b/g.py\n@@ -0,0 +1 @@\n+g"
    rows = history.AddedLines(F.lit(diff_text)).collect()
    assert [tuple(r) for r in rows] == [("f.py", 4, "new"), ("f.py", 5, "two"), ("g.py", 1, "g")]


def test_brief(spark):
    n = nodes(spark, {"id": "i", "type": "Investigation", "state": "active", "title": "I"}, {"id": "g", "type": "Goal", "state": "planned"}, {"id": "h", "type": "Goal", "state": "active"})
    g = KnowledgeGraph(n, edges(spark, ("i", "discussed_in", "g"), ("i", "refines", "h")))
    assert [(r.section, r.id) for r in brief.resume(g).collect()] == [("investigation", "i"), ("planned-goal", "g"), ("active-goal", "h")]
    near = brief.compact_relations(g, n.filter("id = 'i'").select("id"), 1).collect()
    assert [(r.edge_type, r.other, r.first_seen) for r in near] == [("refines", "h", True)]
    assert brief.health(g, SYSTEM).first().failures == 2


def test_world(spark):
    v = spark.createDataFrame([("a", "b", "system", []), ("b", "a", "system", []), ("c", None, "system", []), ("d", "d", "system", []), ("e", "x", "system", []), ("f", "old", "project", []), ("g", None, "system", ["old"])], "slug string, parent string, schema string, aliases array<string>")
    assert {r.slug: r.status for r in world.parent_status(v).collect()} == {"a": "cycle", "b": "cycle", "c": "none", "d": "self", "e": "unresolvable", "f": "schema-mismatch", "g": "none"}
    p = spark.createDataFrame([("a", "billing", "payments and invoices"), ("b", "search", "ranking")], "slug string, name string, description string")
    out = world.world_hints(p, "payments invoices").collect()
    assert out[0].slug == "a" and out[0].confidence == "high"


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select * from values (timestamp'2026-01-01 00:01:00', 'k', 1.0D), (timestamp'2026-01-01 00:09:00', 'k', 2.0D), (timestamp'2026-01-01 01:00:00', 'k', 3.0D) t(ts, key, value)").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    def run(writer):
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(90)

    run(state.tumbling(stream, "ts", "key", "value", "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbled"))
    batch = state.tumbling(spark.read.parquet(src), "ts", "key", "value", "10 minutes")
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))
    target = str(tmp_path / "merged")
    run(stream.writeStream.foreachBatch(state.merge_latest(spark, target, "key", "ts", 4)))
    assert [r.value for r in state.read_latest(spark, target).collect()] == [3.0]
    sink = state.merge_latest(spark, target, "key", "ts", buckets=4)
    rows = lambda *x: spark.createDataFrame(x, schema)
    late = state.read_latest(spark, target).first().ts
    for number in (1, 2, 3, 3):
        sink(rows((late, "k", 3.0 + number), (late, f"other{number}", 3.0)), number)
    sink(stream.sparkSession.createDataFrame([], schema), 4)
    with pytest.raises(ValueError, match="has 4 buckets"):
        state.merge_latest(spark, target, "key", "ts", 8)(rows((late, "k", 9.0)), 5)
    kept = {r.key: r.value for r in state.read_latest(spark, target).collect()}
    assert kept == {"k": 6.0, "other1": 3.0, "other2": 3.0, "other3": 3.0}
    # Timeouts by processing time keep a query going, so this one is stopped once it has answered.
    asked = state.counted_asks(stream, "key").writeStream.outputMode("update").format("memory").queryName("asked").start()
    until = time.time() + 90
    while time.time() < until and spark.table("asked").isEmpty():
        time.sleep(0.5)
    asked.stop()
    assert [tuple(r) for r in spark.table("asked").collect()] == [("k", 3)]


def test_plans_stay_lean(spark):
    sf = "/root/testdata/sf0.001"
    from graphloom.plans.catalogue import QUERIES

    plan = QUERIES["type_filter_project"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "p_retailprice" not in plan
    for name in ("dup_vector_pairs", "knn_graph", "staleness_commits", "authority_echo", "dup_lexical"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
