"""Queries over vaults, snapshots, branches, checks of sources and suggestions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ..functions import code
from ..graph import KnowledgeGraph
from ..operators import assist, brief, carving, checks, code_index, diff, duplicates, merge, mutate
from ..schema import SYSTEM
from ..session import checkpoint_dir, shared_checkpoint
from ..sources import vault, vault_source, vector_index
from ..sources.snapshots import SnapshotStore, changed_files, lost_nodes
from .projection import EDGES_SQL, NODES_SQL, edges, nodes, table, vectors
from .queries_carving import _FRAME_PATHS, _W, carved
from .registry import query

_FIELDS = ("title", "summary", "state", "path")


def _reimported(spark, sf_dir):
    return vault.parse_files(vault.render_files(KnowledgeGraph(nodes(spark, sf_dir).select("id", "type", *_FIELDS), edges(spark, sf_dir))))


@query(f"SELECT id, type, title, summary, state, path FROM ({NODES_SQL})")
def vault_roundtrip(spark, sf_dir):
    """Every node written as a file and parsed again."""
    return vault.nodes_of(_reimported(spark, sf_dir), _FIELDS).select("id", "type", *_FIELDS)


@query(f"SELECT id, type, src, dst FROM ({EDGES_SQL})")
def vault_roundtrip_edges(spark, sf_dir):
    return vault.edges_of(_reimported(spark, sf_dir)).select("id", "type", "src", "dst")


@query(f"SELECT id, type, title, summary FROM ({NODES_SQL}) WHERE type IN ('Customer', 'Nation')")
def vault_source_roundtrip(spark, sf_dir):
    """Customers, suppliers and nations written as files by commit; the folders of two types read back."""
    folder = f"{checkpoint_dir(spark)}/vault-{uuid.uuid4().hex}"
    own = nodes(spark, sf_dir).filter("type in ('Customer', 'Supplier', 'Nation')").select("id", "type", "title", "summary")
    links = edges(spark, sf_dir).filter("type in ('in_nation', 'in_region')")
    vault.write_files(vault.render_files(KnowledgeGraph(own, links)), folder)
    read = vault_source.read(spark, folder).filter(F.col("folder").isin("Customer", "Nation"))
    out = shared_checkpoint(vault.nodes_of(vault.parse_files(read), ("title", "summary")).select("id", "type", "title", "summary"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


@query(f"""
    WITH n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '-'), '^$', id) AS s FROM ({NODES_SQL}) WHERE type = 'Nation' OR type = 'Region')
    SELECT type || '/' || s || '.md' AS path FROM n
""")
def vault_paths(spark, sf_dir):
    own = nodes(spark, sf_dir).filter("type in ('Nation', 'Region')").select("id", "type", "title")
    return vault.render_files(KnowledgeGraph(own, edges(spark, sf_dir))).select("path")


@query("SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'create' WHEN c_custkey % 3 = 1 THEN 'delete' ELSE 'write' END AS action FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 2 = 0")
def vault_delta(spark, sf_dir):
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("path"), F.col("c_name").alias("content"), key)
    before = own.filter(key % 3 != 0).withColumn("content", F.when((key % 3 == 2) & (key % 2 == 0), F.lit("old")).otherwise(F.col("content")))
    return changed_files(own.filter(key % 3 != 1), before).select("path", "action")


@query(f"SELECT id, type, CASE WHEN id LIKE '%7' THEN 'new' ELSE title END AS title FROM ({NODES_SQL}) WHERE type IN ('Supplier', 'Nation', 'Region')")
def snapshot_read(spark, sf_dir):
    """Two versions committed to a store, the second read back."""
    own = nodes(spark, sf_dir).filter("type in ('Supplier', 'Nation', 'Region')").select("id", "type", "title")
    links = edges(spark, sf_dir).filter("type = 'in_region'")
    store = SnapshotStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.commit(KnowledgeGraph(own, links), None, "first")
    store.commit(KnowledgeGraph(own.withColumn("title", F.when(F.col("id").endswith("7"), "new").otherwise(F.col("title"))), links), 0, "second")
    return store.read().nodes.select("id", "type", "title")


@query(f"SELECT id FROM ({NODES_SQL}) WHERE type = 'Part' AND id LIKE '%3'")
def lost_after_rewrite(spark, sf_dir):
    own = nodes(spark, sf_dir).filter("type = 'Part'")
    return lost_nodes(own, own.filter("id not like '%3'"))


@query("""
    SELECT c_custkey AS id, c_name AS name, 'missing' AS side FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, c_name || '!', 'extra' FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, c_name, 'extra' FROM customer WHERE c_custkey % 5 = 1
""")
def fidelity_rows(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    other = own.withColumn("name", F.when(F.col("id") % 5 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))).union(own.filter("id % 5 = 1"))
    return diff.lost_rows(own, other)


@query("SELECT o_orderpriority AS query, o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0")
def recall_loss(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_orderkey").alias("id"))
    return diff.recall_loss(found, found.filter("id % 7 <> 0"))


_NAMES = "SELECT p_partkey AS k, 'part:' || (p_partkey % 3) || ':' || p_partkey AS id, p_name AS title FROM part"


@query(f"""
    WITH n AS (SELECT k, id, k % 3 AS system, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name FROM ({_NAMES})),
    s AS (SELECT c.id AS candidate, e.id AS existing, c.name FROM n c JOIN n e ON c.system = e.system AND c.name = e.name AND c.id <> e.id WHERE c.id LIKE '%9')
    SELECT candidate, CASE WHEN count(*) FILTER (existing LIKE '%1' OR existing LIKE '%2') = count(*) THEN 'acked' ELSE 'rejected' END AS status FROM s GROUP BY candidate
""")
def duplicate_gate(spark, sf_dir):
    key = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), key % 3, F.lit(":"), key).alias("id"), F.lit("Part").alias("type"), F.col("p_name").alias("title"))
    return duplicates.lexical_gate(own.filter("id like '%9'"), own, own.filter("id like '%1' or id like '%2'").select("id"))


_COS = "round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), {})"
_VEC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
_RAW = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"


_TYPES = ("Decision", "OperationalKnowledge", "Risk", "Constraint")


@query(f"""
    WITH v AS ({_VEC}) SELECT 'd:' || a.vec_id AS candidate, 'd:' || b.vec_id AS existing, {_COS.format(4)} AS similarity, CASE WHEN a.label % 4 = b.label % 4 THEN CASE WHEN {_RAW} >= 0.92 THEN 'duplicate' ELSE 'related' END ELSE 'cross-type' END AS kind
    FROM v a JOIN v b ON a.label % 4 // 2 = b.label % 4 // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE {_RAW} >= 0.92 OR (a.label % 4 = b.label % 4 AND {_RAW} >= 0.8)
""")
def vector_gate(spark, sf_dir):
    """Even vectors as candidates against odd ones; labels deal out the types, two to a family."""
    own = vectors(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("label") % 4 + 1).cast("int"))
    rows = own.select(F.col("node_id").alias("id"), kind.alias("type"), "vector", "vec_id")
    odd = own.filter("vec_id % 2 = 1")
    return duplicates.vector_suspects(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), odd)


@query(f"WITH v AS ({_VEC}) SELECT a.vec_id AS a, b.vec_id AS b, {_COS.format(6)} AS similarity FROM v a JOIN v b USING (label) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND {_RAW} >= 0.82")
def similar_decisions(spark, sf_dir):
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "vector")
    return diff.similar_decisions(own.filter("id % 2 = 0"), own.filter("id % 2 = 1"), key="label")


@query(f"""
    WITH v AS ({_VEC}) SELECT 'node-duplicate-suspect' AS rule, least('d:' || a.vec_id, 'd:' || b.vec_id) AS x, greatest('d:' || a.vec_id, 'd:' || b.vec_id) AS y
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_RAW} >= 0.92
""")
def vector_rule(spark, sf_dir):
    own = vectors(spark, sf_dir)
    typed = own.select(F.col("node_id").alias("id"), F.concat(F.lit("t"), F.col("label")).alias("type"))
    found = carving.vector_rules(typed, own, tuple(f"t{k}" for k in range(64)))
    return found.select("rule", F.col("subject_id").alias("x"), F.regexp_extract("detail", "^(d:[0-9]+):", 1).alias("y"))


@query(_W + " SELECT 'decision_without_lineage' AS signal, id AS subject FROM n WHERE type = 'Decision' AND id NOT IN (SELECT src FROM e WHERE type IN ('refines', 'supersedes'))")
def decisions_without_lineage(spark, sf_dir):
    g = carved(spark, sf_dir)
    return diff.decisions_without_lineage(g.nodes, g.edges).select("signal", "subject")


@query(
    _W
    + f""", p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({_FRAME_PATHS})),
    f AS (SELECT n.path, max(e.src IS NOT NULL) AS framed FROM n LEFT JOIN e ON e.dst = n.id AND e.type = 'evidenced_by' WHERE n.type = 'File' GROUP BY n.path),
    c AS (SELECT regexp_extract(n.path, '^(.*)/[^/]*$', 1) AS dir, min(e.src) AS component, count(DISTINCT e.src) AS claims FROM e JOIN n ON n.id = e.dst WHERE e.type = 'evidenced_by' AND e.src LIKE 'component:%' GROUP BY 1),
    s AS (SELECT p.path, p.dir, component, CASE WHEN p.path NOT LIKE '%.ts' THEN 'non-impl' WHEN framed THEN 'registered' WHEN framed IS NOT NULL THEN 'known-unframed' WHEN claims = 1 THEN 'unwired' ELSE 'unclaimed' END AS status FROM p LEFT JOIN f USING (path) LEFT JOIN c USING (dir))
    SELECT 'in-footprint-unwired' AS rule, path AS subject_id, 1::BIGINT AS n FROM s WHERE status = 'unwired'
    UNION ALL SELECT 'component-candidate', dir, count(*) FROM s WHERE status IN ('unwired', 'unclaimed', 'known-unframed') GROUP BY dir HAVING count(*) >= 5"""
)
def frame_findings(spark, sf_dir):
    key = F.col("l_partkey")
    path = F.concat(F.lit("src/d"), key % 60, F.lit("/f"), key, F.when(key % 11 == 0, ".md").when(key % 11 == 1, ".env").otherwise(".ts"))
    entries = checks.frame_entries(carved(spark, sf_dir), table(spark, sf_dir, "lineitem").select(path.alias("path")))
    return checks.frame_findings(entries).select("rule", "subject_id", "n")


@query(
    _W
    + """, f AS (SELECT p_partkey AS k, 'src/d' || (p_partkey % 40) || '/f' || p_partkey || CASE WHEN p_partkey % 50 = 0 THEN '.example.json' ELSE '.ts' END AS path FROM part),
    h AS (SELECT path, 'k:t:' || (k + 2) AS target FROM f), t AS (SELECT h.*, n.id AS found, n.state FROM h LEFT JOIN n ON n.id = target)
    SELECT 'marker-broken-ref' AS rule, path || ':2' AS subject_id FROM t WHERE found IS NULL AND target NOT LIKE '%5'
    UNION ALL SELECT 'marker-tombstoned-ref', path || ':2' FROM t WHERE found IS NULL AND target LIKE '%5'
    UNION ALL SELECT 'marker-superseded-ref', path || ':2' FROM t WHERE state = 'superseded'"""
)
def marker_findings(spark, sf_dir):
    """A marker in the second line of every file; targets that end in 5 have a tombstone."""
    g = carved(spark, sf_dir)
    key = F.regexp_extract("path", "/f([0-9]+)", 1).cast("long") + 2
    files = g.nodes.filter("type = 'File'").select("path", F.concat(F.lit("let a = 1\n// kg:see k:t:"), key).alias("content"))
    gone = table(spark, sf_dir, "part").select(F.concat(F.lit("k:t:"), F.col("p_partkey") + 2).alias("id"), F.lit("k:t:1").alias("final")).filter("id like '%5'")
    return checks.marker_findings(checks.marker_hits(files), g, gone).select("rule", "subject_id")


@query(
    _W
    + """, w AS (SELECT id, 'file:t:src/d' || (k % 40) || '/f' || k || CASE WHEN k % 50 = 0 THEN '.example.json' ELSE '.ts' END AS file, k FROM (SELECT id, CAST(split_part(id, ':', 3) AS BIGINT) AS k FROM n WHERE type = 'Constraint') WHERE k % 3 > 0),
    x AS (SELECT w.*, n.path FROM w LEFT JOIN n ON n.id = file)
    SELECT 'unguarded' AS rule, id AS subject_id FROM n WHERE type = 'Constraint' AND CAST(split_part(id, ':', 3) AS BIGINT) % 3 = 0
    UNION ALL SELECT 'enforcer-missing', id FROM x WHERE path IS NULL
    UNION ALL SELECT 'enforcer-skipped', id FROM x WHERE path IS NOT NULL AND k % 5 = 0
    UNION ALL SELECT 'marker-missing', id FROM x WHERE path IS NOT NULL AND k % 7 = 0"""
)
def constraint_findings(spark, sf_dir):
    """Constraints wired to the file of their number unless that is a multiple of 3; files that skip tests, and files without a marker."""
    g = carved(spark, sf_dir)
    k = F.split("id", ":")[2].cast("long")
    file = F.concat(F.lit("file:t:src/d"), k % 40, F.lit("/f"), k, F.when(k % 50 == 0, ".example.json").otherwise(".ts"))
    wired = g.nodes.filter("type = 'Constraint'").filter(k % 3 > 0).select(F.concat(F.lit("w"), "id").alias("id"), F.lit("enforced_by").alias("type"), F.col("id").alias("src"), file.alias("dst"))
    own = g.nodes.filter("type = 'Constraint'").filter((k % 3 > 0) & (k % 7 != 0)).select(F.col("id").alias("constraint"), file.alias("id"))
    files = g.nodes.filter("type = 'File'").join(own, "id", "left").withColumn("n", F.regexp_extract("path", "/f([0-9]+)", 1).cast("long"))
    content = F.concat_ws("\n", F.when(F.col("n") % 5 == 0, F.lit("it.skip('later')")).otherwise(F.lit("it('works')")), F.when(F.col("constraint").isNotNull(), F.concat(F.lit("// kg:enforces "), F.col("constraint"))))
    return checks.constraint_findings(KnowledgeGraph(g.nodes, wired), files.select("path", content.alias("content"))).select("rule", "subject_id")


@query("""
    WITH d AS (SELECT doc_id, source AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS alias FROM benchmark),
    a AS (SELECT 'decision:s:' || item_id AS id, alias, source AS home FROM i JOIN documents ON doc_id = item_id WHERE regexp_full_match(alias, '[A-Za-z_$][A-Za-z0-9_$]{2,}') AND NOT regexp_full_match(alias, '[a-z]+')),
    w AS (SELECT DISTINCT path, doc_id * 1000000 + pos AS line_no, unnest(regexp_extract_all(line, '[A-Za-z_$][A-Za-z0-9_$]*')) AS alias FROM d
          WHERE NOT regexp_matches(line, '^\\s*(import\\b|from\\s+\\S+\\s+import\\b|(const|let|var)\\s+.*=\\s*require\\(|use\\s|#include|require\\b|export\\s+.*\\bfrom\\b)'))
    SELECT id, alias, path, line_no::BIGINT AS line_no FROM w JOIN a USING (alias) WHERE path <> home
""")
def authority_echo_lines(spark, sf_dir):
    """Benchmark words as aliases of decisions whose home is the source of the document of their number."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    aliases = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0)))
    homes = items.select("item_id", aliases.alias("aliases")).join(docs.select(F.col("doc_id").alias("item_id"), "source"), "item_id")
    own = homes.select(F.concat(F.lit("decision:s:"), "item_id").alias("id"), F.lit("Decision").alias("type"), F.lit(None).cast("string").alias("path"), "aliases")
    files = docs.select(F.concat(F.lit("file:s:"), "source").alias("id"), F.lit("File").alias("type"), F.col("source").alias("path"), F.lit(None).cast("array<string>").alias("aliases")).distinct()
    links = homes.select(F.concat(F.lit("e"), "item_id").alias("id"), F.lit("documented_by").alias("type"), F.concat(F.lit("decision:s:"), "item_id").alias("src"), F.concat(F.lit("file:s:"), "source").alias("dst"))
    lines = docs.select("doc_id", F.col("source").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("path", (F.col("doc_id") * 1_000_000 + F.col("pos") + 1).alias("line_no"), "line")
    return checks.authority_echoes(KnowledgeGraph(own.unionByName(files), links), lines).select("id", "alias", "path", F.col("line_no").cast("long").alias("line_no"))


_ORDERS_SQL = """
    SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Investigation' ELSE 'Goal' END AS type, o_orderpriority AS title,
           CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'planned' ELSE 'closed' END AS state, o_orderdate AS made FROM orders
"""


def _work(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = F.when(p.startswith("1") | p.startswith("2"), "Investigation").otherwise("Goal")
    state = F.when(s == "O", "active").when(s == "P", "planned").otherwise("closed")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), kind.alias("type"), p.alias("title"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("generated_at"))


@query(f"""
    WITH o AS ({_ORDERS_SQL}),
    r AS (SELECT 'investigation' AS section, id, title, row_number() OVER (ORDER BY made DESC, id) AS rank FROM o WHERE type = 'Investigation' AND state = 'active'
    UNION ALL SELECT 'planned-goal', id, title, row_number() OVER (ORDER BY made, id) FROM o WHERE type = 'Goal' AND state = 'planned'
    UNION ALL SELECT 'active-goal', id, title, row_number() OVER (ORDER BY made, id) FROM o WHERE type = 'Goal' AND state = 'active')
    SELECT section, rank::INTEGER AS rank, id, title FROM r WHERE rank <= CASE section WHEN 'active-goal' THEN 1 ELSE 5 END
""")
def resume_sections(spark, sf_dir):
    return brief.resume(KnowledgeGraph(_work(spark, sf_dir), edges(spark, sf_dir))).select("section", "rank", "id", "title")


@query(f"SELECT type, count(*) AS n FROM ({_ORDERS_SQL}) WHERE state NOT IN ('closed') GROUP BY type")
def open_questions(spark, sf_dir):
    return brief.open_questions(KnowledgeGraph(_work(spark, sf_dir), edges(spark, sf_dir)))


@query(f"""
    WITH o AS ({_ORDERS_SQL}) SELECT id, type, CASE WHEN type = 'Investigation' THEN 'stale-active' WHEN state = 'planned' THEN 'stale-planned-goal' ELSE 'stale-active-goal' END AS signal FROM o
    WHERE (type = 'Investigation' AND state = 'active' AND made < TIMESTAMP '1996-06-01' - INTERVAL 14 DAY) OR (type = 'Goal' AND state = 'planned' AND made < TIMESTAMP '1996-06-01' - INTERVAL 14 DAY) OR (type = 'Goal' AND state = 'active' AND made < TIMESTAMP '1996-06-01' - INTERVAL 90 DAY)
""")
def lifecycle_signals(spark, sf_dir):
    found = checks.lifecycle_suspects(KnowledgeGraph(_work(spark, sf_dir), edges(spark, sf_dir)), datetime.datetime(1996, 6, 1))
    return found.select("id", "type", F.explode("signals").alias("signal"))


_BRANCHES = """
    WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS title, CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_mktsegment END AS summary FROM customer WHERE c_custkey % 11 > 0),
    m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN c_name || '?' ELSE c_name END AS title, CASE WHEN c_custkey % 15 = 0 THEN 'y' ELSE c_mktsegment END AS summary FROM customer),
    o AS (SELECT c_custkey AS k, c_name AS title, c_mktsegment AS summary FROM customer)
"""


def _branches(spark, sf_dir):
    key = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(key, F.concat(F.lit("c:"), key).alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("summary"))
    branch = own.filter(key % 11 > 0).withColumns({"title": F.when(key % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "summary": F.when(key % 6 == 0, "x").otherwise(F.col("summary"))})
    main = own.withColumns({"title": F.when(key % 10 == 0, F.concat("title", F.lit("?"))).otherwise(F.col("title")), "summary": F.when(key % 15 == 0, "y").otherwise(F.col("summary"))})
    links = edges(spark, sf_dir).filter("type = 'in_nation'")
    policy = lambda name, m: table(spark, sf_dir, "customer").filter(key % m == 0).select(F.concat(F.lit(name), key).alias("id"), F.lit("constrains").alias("type"), F.concat(F.lit("c:"), key).alias("src"), F.concat(F.lit("n:"), "c_nationkey").alias("dst"))
    graph = lambda n, extra: KnowledgeGraph(n.drop("c_custkey"), links if extra is None else links.unionByName(extra))
    return graph(own, None), graph(branch, policy("b", 50)), graph(main, policy("m", 70))


@query(
    _BRANCHES
    + """, s AS (SELECT b.k, (b.title <> o.title) AS bt, (b.summary <> o.summary) AS bs, (m.title <> o.title) AS mt, (m.summary <> o.summary) AS ms FROM b JOIN m USING (k) JOIN o USING (k))
    SELECT 'node_co_modified' AS signal, 'c:' || k AS subject, CASE WHEN (bt AND mt) OR (bs AND ms) THEN 'semantic' ELSE 'mechanical' END AS class, concat_ws(',', CASE WHEN bs AND ms THEN 'summary' END, CASE WHEN bt AND mt THEN 'title' END) AS detail FROM s WHERE (bt OR bs) AND (mt OR ms)
    UNION ALL SELECT 'edge_target_co_added', 'n:' || x.c_nationkey, 'mechanical', 'constrains:' || x.n || ':' || y.n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1) x JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey % 70 = 0 GROUP BY 1) y USING (c_nationkey)"""
)
def merge_conflicts(spark, sf_dir):
    return merge.merge_conflicts(*_branches(spark, sf_dir))


@query(
    _BRANCHES
    + """SELECT 'branch' AS side, 'nodes' AS kind, 'modified' AS change, count(*) AS n FROM b JOIN o USING (k) WHERE b.title <> o.title OR b.summary <> o.summary
    UNION ALL SELECT 'branch', 'nodes', 'removed', count(*) FROM o WHERE k % 11 = 0 UNION ALL SELECT 'main', 'nodes', 'modified', count(*) FROM m JOIN o USING (k) WHERE m.title <> o.title OR m.summary <> o.summary
    UNION ALL SELECT 'branch', 'edges', 'added', count(*) FROM o WHERE k % 50 = 0 UNION ALL SELECT 'main', 'edges', 'added', count(*) FROM o WHERE k % 70 = 0"""
)
def merge_summary(spark, sf_dir):
    return merge.merge_summary(*_branches(spark, sf_dir))


@query(_BRANCHES + "SELECT 'c:' || k AS id, b.title, b.summary FROM b JOIN o USING (k) WHERE b.title <> o.title OR b.summary <> o.summary")
def changed_nodes(spark, sf_dir):
    base, branch, _ = _branches(spark, sf_dir)
    return merge.changed_nodes(diff.diff(base.nodes, branch.nodes)).select("id", "title", "summary")


@query(
    _W
    + """ SELECT 'debt' AS kind, NULL AS id, count(*)::DOUBLE AS similarity FROM n WHERE type IN ('Decision', 'OperationalKnowledge', 'Risk') AND id NOT IN (SELECT src FROM e WHERE type IN ('sets_policy_for', 'documented_by') AND dst LIKE 'file:%')
    UNION ALL SELECT 'premise', id, NULL FROM n WHERE type IN ('Decision', 'Constraint', 'Goal', 'OperationalKnowledge') AND id LIKE '%7' AND id NOT LIKE '%17'"""
)
def write_suggestions(spark, sf_dir):
    g = carved(spark, sf_dir)
    recent = g.nodes.filter("id like '%7'").select("id")
    return assist.suggestions(g, g.nodes.filter("id like '%17'").select("id"), SYSTEM, None, recent).select("kind", "id", "similarity")


@query(f"SELECT id, type, title FROM ({NODES_SQL}) WHERE type = 'Region' OR id IN (SELECT src FROM ({EDGES_SQL}) WHERE type = 'in_region')")
def scope_of_answer(spark, sf_dir):
    regions = nodes(spark, sf_dir).filter("type = 'Region'")
    around = edges(spark, sf_dir).filter("type = 'in_region'").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return nodes(spark, sf_dir).join(assist.scope_ids(regions, around), "id", "left_semi").select("id", "type", "title")


@query("SELECT vec_id AS node_id, CASE WHEN vec_id % 7 = 0 THEN 'delta' ELSE 'base' END AS text_hash FROM embeddings")
def index_overlay(spark, sf_dir):
    own = vectors(spark, sf_dir).select(F.col("vec_id").alias("node_id"), "vector", F.lit("base").alias("text_hash"))
    info = vector_index.IndexInfo("p", "m", 64)
    return vector_index.overlay(own, own.filter("node_id % 7 = 0").withColumn("text_hash", F.lit("delta")), info, info).select("node_id", "text_hash")


_EXT = "(CASE p_partkey % 6 WHEN 0 THEN '.tsx' WHEN 1 THEN '.py' WHEN 2 THEN '.H' WHEN 3 THEN '.yml' WHEN 4 THEN '' ELSE '.xyz' END)"


@query(f"SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'c' WHEN 3 THEN 'yaml' ELSE 'text' END AS language, 'src/part_' || p_partkey || lower({_EXT}) AS slug FROM part")
def file_languages(spark, sf_dir):
    k = F.col("p_partkey")
    ext = F.when(k % 6 == 0, ".tsx").when(k % 6 == 1, ".py").when(k % 6 == 2, ".H").when(k % 6 == 3, ".yml").when(k % 6 == 4, "").otherwise(".xyz")
    path = F.concat(F.lit("src/Part_"), k, ext)
    return table(spark, sf_dir, "part").select(k.alias("id"), code.language(path).alias("language"), code_index.file_slug(path).alias("slug"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'unchanged' END AS status FROM orders")
def file_change_status(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"), F.col("o_orderkey").alias("k"))
    before = own.filter("k % 3 > 0").withColumn("content_hash", F.when(F.col("k") % 3 == 1, "old").otherwise(F.col("content_hash")))
    out = code_index.change_status(own.select("path", "content_hash"), before.select("path", "content_hash"))
    return out.select(F.col("path").cast("long").alias("id"), F.col("change").alias("status"))


@query("SELECT 'source-backing' AS rule, 'd:' || d.doc_id AS subject_id FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id WHERE p.page_id IS NULL OR p.url IS NULL")
def unsourced_documents(spark, sf_dir):
    """Documents as decisions, backed by the page of their number if it has a url."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), "doc_id").alias("id"), F.lit("Decision").alias("type"), F.lit(None).cast("string").alias("path"), F.lit("").alias("summary"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("file:"), "page_id").alias("id"), F.lit("File").alias("type"), F.col("url").alias("path"), F.lit("").alias("summary"))
    links = table(spark, sf_dir, "documents").select(F.concat(F.lit("e"), "doc_id").alias("id"), F.lit("documented_by").alias("type"), F.concat(F.lit("d:"), "doc_id").alias("src"), F.concat(F.lit("file:"), "doc_id").alias("dst"))
    return mutate.unsourced(docs.unionByName(pages), links, SYSTEM).select("rule", "subject_id")
