import http.server
import io
import json
import os
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import code
from graphloom.graph import KnowledgeGraph
from graphloom.operators import assist, diff, merge, normalize, similarity, traverse
from graphloom.schema import SYSTEM
from graphloom.sources import config, embedding_http, history, vault
from graphloom.sources import session_state as ss
from graphloom.sources.snapshots import Conflict, SnapshotStore


def test_ask_state(tmp_path):
    own = ss.AskState(str(tmp_path / "ask.json"))
    assert [own.bump(" q ", 1000.0), own.bump("q", 1001.0), own.bump("r", 1002.0)] == [1, 2, 1]
    own.record("q", ["a", "b", "c", "d"], 1003.0)
    own.record("r", ["b", "z"], 1004.0)
    assert own.recent(1005.0) == ["b", "z", "a", "c"]
    assert own.bump("q", 1001.0 + ss.TTL + 10) == 1
    assert ss.repeat_guidance(3) == "excessive"


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    with ss.writer_lock(path), pytest.raises(TimeoutError), ss.writer_lock(path, wait=0.1):
        pass
    assert not os.path.exists(path)
    (tmp_path / "lock").write_text(json.dumps({"pid": 2**22 + 1, "at": 0}))
    with ss.writer_lock(path, wait=0.1):
        pass


def test_checkpoint_mark(tmp_path):
    own = ss.CheckpointMark(str(tmp_path / "mark.json"))
    assert own.mark("done x\nNext:\n\n- run tests\n", "/w", 0.0) == "run tests"
    assert own.take("/other", 1.0) is None and own.take("/w", 1.0).startswith("done") and own.take("/w", 1.0) is None
    own.mark("a", "/w", 0.0)
    assert own.take("/w", ss.MARK_TTL + 1) is None
    for bad in (" ", "x" * 9000):
        with pytest.raises(ValueError):
            own.mark(bad, "/w")


def test_canonical_graph(spark):
    n = spark.createDataFrame([("pocket:s:a", "Pocket", "x"), ("file:s:f", "File", "y"), ("root:s:r", "Root", "z")], "id string, type string, title string")
    e = spark.createDataFrame([("1", "evidenced_by", "pocket:s:a", "file:s:f"), ("2", "contains", "root:s:r", "file:s:f")], "id string, type string, src string, dst string")
    out = normalize.canonical(KnowledgeGraph(n, e), SYSTEM, ("Root",), ("contains",))
    assert {(r.id, r.type) for r in out.nodes.collect()} == {("component:s:a", "Component"), ("file:s:f", "File")}
    assert [(r.id, r.src) for r in out.edges.collect()] == [("component_s_a__evidenced_by__file_s_f", "component:s:a")]
    assert normalize.fidelity(out, out).count() == 0
    assert normalize.lost_recall(n, n.filter("id <> 'file:s:f'"), ["x", "y"]).collect()[0]["query"] == "y"


def test_verbs(spark, tmp_path, capsys):
    plan = {"reason": "first", "nodes": [{"op": "create", "id": "goal:s:a", "type": "Goal", "title": "Fast search", "state": "active"}], "edges": []}
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    (tmp_path / "vault" / "Goal").mkdir(parents=True)
    (tmp_path / "vault" / "Goal" / "b.md").write_text('---\nid: "goal:s:b"\ntype: "Goal"\ntitle: "Slow search"\n---\n')

    def run(*argv):
        assert cli.main([*argv, "--store", str(tmp_path / "store")]) == 0
        return json.loads(capsys.readouterr().out)

    assert run("vault-import", "--vault", str(tmp_path / "vault")) == {"version": 0, "errors": []}
    done = run("commit-mutation", "--plan", str(tmp_path / "plan.json"))
    assert done["version"] == 1 and done["warnings"][0].startswith("no-recent-ask") and {x["kind"] for x in done["suggestions"]} == {"debt"}
    assert [m["id"] for m in run("search", "--question", "fast search")["matches"]] == ["goal:s:a", "goal:s:b"]
    assert run("fsck")["findings"] == [] and len(run("log")["versions"]) == 2
    assert run("vault-build", "--vault", str(tmp_path / "out")) == {"files": 2}
    assert run("commit-mutation", "--plan", str(tmp_path / "plan.json"))["failures"][0]["rule"] == "create-existing-node"
    assert run("brief")["resume"][0]["id"] == "goal:s:a" and run("ask", "--question", "fast")["confidence"]


def test_more_verbs(spark, tmp_path, capsys):
    def run(*argv):
        assert cli.main([*argv, "--store", str(tmp_path / "store")]) == 0
        return json.loads(capsys.readouterr().out)

    def plan(name, nodes, edges=()):
        (tmp_path / name).write_text(json.dumps({"reason": name, "nodes": nodes, "edges": list(edges)}))
        return run("commit-mutation", "--plan", str(tmp_path / name), "--asked")

    src = tmp_path / "tree" / "src"
    src.mkdir(parents=True)
    for k in range(5):
        (src / f"m{k}.py").write_text(f"import src.m{(k + 1) % 5}\ndef f{k}():\n    pass  # FIXME later\n")
    first = plan("a.json", [{"id": "goal:s:a", "type": "Goal", "title": "Fast", "state": "active"}, {"id": "file:s:src/m0.py", "type": "File", "title": "m0", "path": "src/m0.py"}])
    assert first["version"] == 0 and first["warnings"] == []
    added = run("add", "--kind", "Constraint", "--system", "s", "--slug", "c", "--title", "Quick answers", "--summary", "x", "--link", "enforced_by=file:s:src/m0.py", "constrains=file:s:src/m0.py")
    assert added["version"] == 1
    again = plan("b.json", [{"id": "constraint:s:d", "type": "Constraint", "title": "quick  ANSWERS"}])
    assert [d["existing"] for d in again["duplicates"]] == ["constraint:s:c"] and again["duplicates"][0]["brief"]["title"] == "Quick answers"
    tree = str(tmp_path / "tree")
    assert {f["rule"] for f in run("constraint-check", "--tree", tree)["findings"]} == {"marker-missing"}
    assert [c["id"] for c in run("delta-check", "--tree", tree, "--paths", "src/m0.py")["connected"]] == ["constraint:s:c"]
    assert {e["path"]: e["status"] for e in run("frame-check", "--tree", tree, "--paths", "src/m0.py", "src/m9.py", "x.md")["entries"]} == {"src/m0.py": "known-unframed", "src/m9.py": "unclaimed", "x.md": "non-impl"}
    assert len(run("index", "--tree", tree)["files"]) == 5
    carved = run("carve", "--tree", tree)
    assert carved["files"] == 5 and {r["band"] for r in carved["layers"]} == {0} and len(carved["components"]) == 5
    assert run("vector-index", "--out", str(tmp_path / "v"))["index"][0]["rows"] == 3
    assert run("export", "--out", str(tmp_path / "json"))["nodes"] == 3
    assert {t["type"]: t["count"] for t in run("inspect")["types"]} == {"Constraint": 1, "File": 1, "Goal": 1}
    assert [e["id"] for e in run("evidence", "--id", "goal:s:a")["evidence"]] == ["goal:s:a"]
    (tmp_path / "commits.json").write_text("\n".join(json.dumps({"path": "src/m0.py", "ts": f"2024-01-0{k} 00:00:00"}) for k in (1, 2)))
    assert run("staleness-check", "--log", str(tmp_path / "commits.json"))["findings"] == []
    config_file = str(tmp_path / "allowed.json")
    assert run("carving-allow", "--config", config_file, "--paths", "a.py", "--reason", "generated", "--date", "2024-01-01") == {"allowed": 1}
    assert run("carving-allow", "--config", config_file, "--paths", "b*.py", "--reason", "generated", "--date", "2024-01-01")["errors"]
    assert run("checkpoint-mark", "--config", str(tmp_path / "mark.json"), "--text", "next: go on") == {"next": "go on"}
    assert len(run("log")["versions"]) == 2


def test_reports_are_whole(spark):
    out = io.StringIO()
    cli.emit({"n": 1, "rows": spark.range(1500).selectExpr("id", "if(id % 2 = 0, 'é\"', null) AS x"), "none": spark.range(0)}, out)
    read = json.loads(out.getvalue())
    assert len(read["rows"]) == 1500 and read["none"] == [] and read["rows"][0]["x"] == 'é"'


def test_merge_of_two_branches(spark, tmp_path):
    names = "id string, type string, title string, state string, generated_at string"
    links = "id string, type string, src string, dst string"
    graph = lambda n, e=(): KnowledgeGraph(spark.createDataFrame(n, names), spark.createDataFrame(list(e), links))
    old = [("goal:s:a", "Goal", "A", "active", "1"), ("goal:s:b", "Goal", "B", "active", "1"), ("decision:s:o", "Decision", "O", None, "1")]
    base = graph(old)
    branch = graph([("goal:s:a", "Goal", "A2", "active", "2"), ("goal:s:b", "Goal", "B", "achieved", "1"), old[2], ("decision:s:x", "Decision", "X", None, "2"), ("decision:s:y", "Decision", "Y", None, "2")], [("e1", "refines", "decision:s:y", "decision:s:o")])
    main = graph([("goal:s:a", "Goal", "A3", "active", "1"), ("goal:s:b", "Goal", "B2", "active", "1"), old[2], ("decision:s:z", "Decision", "Z", None, "2")], [("e2", "refines", "decision:s:z", "decision:s:o")])
    vectors = spark.createDataFrame([("decision:s:x", [1.0, 0.0]), ("decision:s:z", [1.0, 0.1]), ("decision:s:y", [0.0, 1.0])], "id string, vector array<double>")
    found = merge.merge_conflicts(base, branch, main, vectors)
    assert {(r.signal, r.subject, r["class"]) for r in found.collect()} == {
        ("node_co_modified", "goal:s:a", "semantic"),
        ("node_co_modified", "goal:s:b", "mechanical"),
        ("edge_target_co_added", "decision:s:o", "mechanical"),
        ("decision_without_lineage", "decision:s:x", "semantic"),
        ("decision_vector_similar", "decision:s:x", "semantic"),
    }
    packet = {r.subject: r for r in merge.judgment_packet(found, branch, main).filter("signal = 'node_co_modified'").collect()}
    assert json.loads(packet["goal:s:a"].branch) == {"id": "goal:s:a", "type": "Goal", "title": "A2", "state": "active"} and set(packet) == {"goal:s:a"}
    assert {(r.side, r.kind, r.change, r.n) for r in merge.merge_summary(base, branch, main).collect()} >= {("branch", "nodes", "added", 2), ("main", "nodes", "modified", 2), ("main", "edges", "added", 1)}
    merge.loss_gate(base, base)
    with pytest.raises(ValueError, match="missing decision:s:o"):
        merge.loss_gate(base, graph(old[:2]))
    assert {r.id for r in merge.changed_nodes(diff.diff(base.nodes, branch.nodes)).collect()} == {"goal:s:a", "goal:s:b", "decision:s:x", "decision:s:y"}


def test_assistance(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "c"), ("b", None)], "id string, other string")
    assert {r.id for r in assist.scope_ids(ids, edges).collect()} == {"a", "b", "c"}
    assert not assist.should_escalate("high", 2) and assist.should_escalate("high", 0) and assist.should_escalate("low", 3) and assist.should_escalate(None, 0)
    reasons = spark.createDataFrame([(["alias exact", "vector:0.7", "title", "state:superseded"],)], "r array<string>")
    assert reasons.select(assist.compact_reasons(F.col("r"))).first()[0] == ["alias exact", "vector:0.7", "state:superseded"]
    nodes = spark.createDataFrame([("decision:s:n", "Decision", "N", None), ("investigation:s:i", "Investigation", "I", "active"), ("goal:s:g", "Goal", "G", "active"), ("file:s:f", "File", "f.py", None), ("file:s:h", "File", "h.py", None)], "id string, type string, title string, state string")
    graph = KnowledgeGraph(nodes, spark.createDataFrame([], "id string, type string, src string, dst string"))
    vectors = spark.createDataFrame([("decision:s:n", [1.0, 0.0]), ("file:s:f", [1.0, 0.2]), ("file:s:h", [0.0, 1.0])], "id string, vector array<double>")
    out = assist.suggestions(graph, spark.createDataFrame([("decision:s:n",)], "id string"), SYSTEM, vectors, spark.createDataFrame([("goal:s:g",), ("decision:s:n",), ("file:s:f",)], "id string"))
    assert {(r.kind, r.id, r.other) for r in out.collect()} == {("debt", None, None), ("led_to", "investigation:s:i", None), ("premise", "goal:s:g", None), ("binding", "decision:s:n", "file:s:f")}
    assert assist.precheck(3, 4, True)[0].startswith("index-stale") and assist.precheck(4, 4, True) == []


def test_two_writers_at_one_head(spark, tmp_path):
    graph = lambda x: KnowledgeGraph(spark.createDataFrame([(x, "Goal")], "id string, type string"), spark.createDataFrame([], "id string, type string, src string, dst string"))
    one, two = SnapshotStore(spark, str(tmp_path / "s")), SnapshotStore(spark, str(tmp_path / "s"))
    assert one.commit(graph("a"), None, "first") == 0
    two.head = lambda: 0  # it looked before the other was done
    assert one.commit(graph("a").__class__(graph("a").nodes.union(graph("b").nodes), graph("a").edges), 0, "one") == 1
    with pytest.raises(Conflict):
        two.commit(graph("c"), 0, "two", may_lose=True)
    assert {r.id for r in one.read(1).nodes.collect()} == {"a", "b"} and one.head() == 1 and one.merge_base(0, 1) == 0


def test_depth_of_cyclic_imports(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("y", "x"), ("p", "q"), ("q", "p"), ("q", "a"), ("s", "s")], "src string, dst string")
    parts = {r.id: r.part for r in traverse.strong_components(links).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "x", "y": "y", "p": "p", "q": "p", "s": "s"}
    assert {r.id: r.depth for r in traverse.dependency_depth(links).collect()} == {"e": 0, "d": 1, "a": 2, "b": 2, "c": 2, "x": 3, "y": 4, "p": 3, "q": 3, "s": 0}


def test_blocks_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    rnd = random.Random(3)
    rows = [(k, "a" if k % 3 else "b", [rnd.random() - 0.5 for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, type string, vector array<double>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and cos(a[2], b[2]) >= 0.6)
    assert sorted((r.a, r.b) for r in similarity.vector_pairs(df, 0.6).collect()) == want
    near = similarity.top_matches(df, df, "type", 0.6, 100).select("id", "match").collect()
    assert sorted(map(tuple, near)) == sorted(want + [(b, a) for a, b in want])
    groups = spark.createDataFrame([("a", "f"), ("b", "f")], "type string, family string")
    cross = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and cos(a[2], b[2]) >= 0.6)
    assert sorted((r.a, r.b) for r in similarity.cross_type_pairs(df, groups, 0.6).collect()) == cross


def test_git_paths(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    (tmp_path / "d").mkdir()
    for name in ("a.py", "d/é b.py"):
        (tmp_path / name).write_text("1")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("2")
    (tmp_path / "new.py").write_text("3")
    own = lambda df: sorted(r.path for r in df.collect())
    assert own(history.tracked_files(spark, str(tmp_path))) == ["a.py", "d/é b.py"] and own(history.tracked_files(spark, str(tmp_path), "d")) == ["d/é b.py"]
    assert own(history.changed_files(spark, str(tmp_path))) == ["a.py", "new.py"]
    git("add", ".")
    git("commit", "-qm", "two")
    assert own(history.changed_files(spark, str(tmp_path), "HEAD~1..HEAD")) == ["a.py", "new.py"]


def test_embeddings_over_http():
    class Server(http.server.BaseHTTPRequestHandler):
        def _answer(self, value):
            raw = json.dumps(value).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._answer({"data": [{"id": "small:latest"}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._answer({"data": [{"index": k, "embedding": [len(x), 1]} for k, x in reversed(list(enumerate(asked["input"])))]})

        def log_message(self, *a):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_port}/v1"
        assert embedding_http.resolve_target("small", base) == (base, "small")
        with pytest.raises(embedding_http.EmbeddingError, match="has no large"):
            embedding_http.resolve_target("large", base)
        with pytest.raises(embedding_http.EmbeddingError, match="pinned"):
            embedding_http.resolve_target(None)
        assert embedding_http.http_embedder(base, "small")(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
        server.shutdown()


def test_write_permission_and_index_paths():
    assert config.vault_mode({"VAULT_MODE": "direct"}, {"VAULT_MODE": "readonly"}) == ("direct", "local")
    assert config.vault_mode({"VAULT_MODE": "odd"}, {"VAULT_MODE": "readonly"}) == ("readonly", "inherited") and config.vault_mode({}, {}) == (None, "none")
    config.assert_write_allowed("direct", "local", True)
    config.assert_write_allowed(None, "none", False)
    for mode, whence, external in (("readonly", "inherited", False), (None, "none", True), ("direct", "inherited", True)):
        with pytest.raises(PermissionError):
            config.assert_write_allowed(mode, whence, external)
    paths = lambda mode, *there: config.index_paths("/v", None, mode, "/own", lambda p: p in there)
    assert paths(None) == ("/v/.cache/vectors", "/v/.cache/vectors") and paths(None, "/v/.vectors") == ("/v/.vectors", "/v/.cache/vectors")
    read, write = paths("readonly", "/v/.vectors")
    assert read == "/v/.vectors" and write.startswith("/own/") and paths("readonly", write)[0] == write and config.index_paths("/v", "/x", "readonly", "/own", bool) == ("/x", "/x")


def test_lines_are_written_as_blocks(spark, tmp_path):
    texts = ["one\ntwo", "one\n\ntwo", "one\ntwo\n", "one\r\ntwo", " one\ntwo", "a: b\n--- c\n  d", "x \ny", "one"]
    nodes = spark.createDataFrame([(f"goal:s:n{k}", "Goal", f"t{k}", x) for k, x in enumerate(texts)], "id string, type string, title string, summary string")
    files = vault.render_files(KnowledgeGraph(nodes, spark.createDataFrame([], "id string, type string, src string, dst string")))
    assert sum("summary: |-\n  one\n  two" in r.content for r in files.collect()) == 1
    vault.write_files(files, str(tmp_path))
    read = vault.nodes_of(vault.parse_files(vault.read_files(spark, str(tmp_path))), ("title", "summary"))
    assert {r.id: r.summary for r in read.collect()} == {f"goal:s:n{k}": x for k, x in enumerate(texts)}


def test_export_lists(spark):
    text = "export function d() {}\nexport { a, b as c };\nexport {\n  e,\n  d as f,\n}\n"
    df = spark.createDataFrame([("typescript", text), ("python", "def a():\n  x = 'export { b }'\n")], "lang string, text string")
    assert [r[0] for r in df.select(code.symbols(F.col("lang"), F.col("text"), "exported")).collect()] == [["d", "a", "b", "e"], ["a"]]
    paths = {"src/config/x.test.ts": "test", "docs/a.json": "documentation", "README.md": "documentation", "src/pages/index.tsx": "ui_component", "api/index.ts": "api_route", "src/main.py": "entrypoint", ".env": "config", "a/types.ts": "config", "a/b.ts": "source"}
    roles = spark.createDataFrame([(p,) for p in paths], "path string").select("path", code.role(F.col("path")).alias("role"))
    assert {r.path: r.role for r in roles.collect()} == paths
