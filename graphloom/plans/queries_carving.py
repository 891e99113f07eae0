"""The test tables as a carved code base, and the carving rules over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.code import dirname
from ..graph import KnowledgeGraph
from ..operators import carving, checks
from .projection import table
from .registry import query

_PATH = "'src/d' || (p_partkey % 40) || '/f' || p_partkey || CASE WHEN p_partkey % 50 = 0 THEN '.example.json' ELSE '.ts' END"
CARVED_NODES_SQL = f"""
    SELECT 'file:t:' || {_PATH} AS id, 'File' AS type, CASE p_partkey % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'documentation' ELSE 'source' END AS role, {_PATH} AS path, p_name AS title, NULL::VARCHAR AS state, NULL::VARCHAR AS description, false AS candidate FROM part
    UNION ALL SELECT 'component:t:' || CASE WHEN s_suppkey % 10 = 0 THEN 'c' ELSE 'comp-' END || s_suppkey, 'Component', NULL, NULL, s_name || CASE WHEN s_suppkey % 20 = 3 THEN ' (3 files)' ELSE '' END, NULL, NULL, s_suppkey % 25 = 0 FROM supplier
    UNION ALL SELECT 'concern:t:' || n_nationkey, 'Concern', NULL, NULL, n_name, NULL, NULL, false FROM nation
    UNION ALL SELECT 'layer:t:' || CASE WHEN r_regionkey % 2 = 0 THEN 'band' ELSE 'lay-' END || r_regionkey, 'Layer', NULL, NULL, r_name, NULL, NULL, false FROM region
    UNION ALL SELECT 'k:t:' || c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Risk' WHEN 2 THEN 'Constraint' ELSE 'Goal' END, NULL, NULL, c_name,
        CASE WHEN c_custkey % 12 = 0 THEN 'superseded' WHEN c_custkey % 20 = 3 THEN 'abandoned' END, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END, false FROM customer
"""
_PART_ID = f"'file:t:' || {_PATH}"
CARVED_EDGES_SQL = f"""
    SELECT DISTINCT 'component:t:' || CASE WHEN l_suppkey % 10 = 0 THEN 'c' ELSE 'comp-' END || l_suppkey AS src, 'evidenced_by' AS type, {_PART_ID} AS dst FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT DISTINCT 'concern:t:' || s_nationkey, 'evidenced_by', {_PART_ID} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT 'layer:t:' || CASE WHEN p_partkey % 5 % 2 = 0 THEN 'band' ELSE 'lay-' END || (p_partkey % 5), 'evidenced_by', {_PART_ID} FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'k:t:' || c_custkey, 'has_premise', 'k:t:' || (c_custkey + 1) FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'k:t:' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'sets_policy_for' ELSE 'risks_in' END, 'concern:t:' || (c_custkey % 25) FROM customer WHERE c_custkey % 6 < 2
    UNION ALL SELECT 'k:t:' || c_custkey, 'documented_by', {_PART_ID} FROM customer JOIN part ON p_partkey = c_custkey WHERE c_custkey % 9 = 0
    UNION ALL SELECT 'k:t:' || c_custkey, 'refines', 'k:t:' || (c_custkey - 1) FROM customer WHERE c_custkey % 24 = 1
    UNION ALL SELECT 'k:t:' || c_custkey, 'constrains', 'k:t:' || (c_custkey - 2) FROM customer WHERE c_custkey % 8 = 2
"""


def carved(spark, sf_dir) -> KnowledgeGraph:
    none = F.lit(None).cast("string")
    key = F.col("p_partkey")
    path = F.concat(F.lit("src/d"), key % 40, F.lit("/f"), key, F.when(key % 50 == 0, ".example.json").otherwise(".ts"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", path.alias("path"), F.concat(F.lit("file:t:"), path).alias("file"))
    component = lambda k: F.concat(F.lit("component:t:"), F.when(F.col(k) % 10 == 0, "c").otherwise("comp-"), F.col(k))
    layer = lambda k: F.concat(F.lit("layer:t:"), F.when(k % 2 == 0, "band").otherwise("lay-"), k)
    know = lambda k: F.concat(F.lit("k:t:"), k)
    no = F.lit(False)
    role = F.when(key % 7 == 0, "test").when(key % 7 == 1, "documentation").otherwise("source")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    customer, supplier, item = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    kind = F.when(c % 4 == 0, "Decision").when(c % 4 == 1, "Risk").when(c % 4 == 2, "Constraint").otherwise("Goal")
    names = ("id", "type", "role", "path", "title", "state", "description", "candidate")
    node_parts = [
        part.select(F.col("file"), F.lit("File"), role, F.col("path"), F.col("p_name"), none, none, no),
        supplier.select(component("s_suppkey"), F.lit("Component"), none, none, F.concat("s_name", F.when(s % 20 == 3, " (3 files)").otherwise("")), none, none, s % 25 == 0),
        table(spark, sf_dir, "nation").select(F.concat(F.lit("concern:t:"), "n_nationkey"), F.lit("Concern"), none, none, F.col("n_name"), none, none, no),
        table(spark, sf_dir, "region").select(layer(F.col("r_regionkey")), F.lit("Layer"), none, none, F.col("r_name"), none, none, no),
        customer.select(know(c), kind, none, none, F.col("c_name"), F.when(c % 12 == 0, "superseded").when(c % 20 == 3, "abandoned"), F.when(c % 5 == 0, " ").otherwise(F.col("c_mktsegment")), no),
    ]
    sold = item.select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "file"), "p_partkey")
    edge_parts = [
        sold.select(component("l_suppkey"), F.lit("evidenced_by"), "file").distinct(),
        sold.join(supplier, F.col("l_suppkey") == s).select(F.concat(F.lit("concern:t:"), "s_nationkey"), F.lit("evidenced_by"), "file").distinct(),
        part.filter("p_partkey % 3 = 0").select(layer(key % 5), F.lit("evidenced_by"), "file"),
        customer.filter(c % 3 == 0).select(know(c), F.lit("has_premise"), know(c + 1)),
        customer.filter(c % 6 < 2).select(know(c), F.when(c % 2 == 0, "sets_policy_for").otherwise("risks_in"), F.concat(F.lit("concern:t:"), c % 25)),
        customer.filter(c % 9 == 0).join(part, c == key).select(know(c), F.lit("documented_by"), "file"),
        customer.filter(c % 24 == 1).select(know(c), F.lit("refines"), know(c - 1)),
        customer.filter(c % 8 == 2).select(know(c), F.lit("constrains"), know(c - 2)),
    ]

    def union(parts, columns):
        out = None
        for p in parts:
            p = p.toDF(*columns)
            out = p if out is None else out.union(p)
        return out

    edges = union(edge_parts, ("src", "type", "dst"))
    return KnowledgeGraph(union(node_parts, names), edges.select(F.concat_ws("__", "src", "type", "dst").alias("id"), "type", "src", "dst"))


_W = f"WITH n AS MATERIALIZED ({CARVED_NODES_SQL}), e AS MATERIALIZED ({CARVED_EDGES_SQL})"
_EXEMPT = "(role IN ('documentation', 'generated') OR regexp_matches(path, '\\.example\\.(json|ya?ml|toml)$'))"


def _f(rule: str, severity: str, subject: str, n: str, rest: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {subject} AS subject_id, CAST({n} AS BIGINT) AS n {rest}"


def _of(kind: str) -> str:
    return f"SELECT src AS grp, dst AS member FROM e JOIN n ON n.id = src WHERE e.type = 'evidenced_by' AND n.type = '{kind}'"


@query(
    _W
    + " UNION ALL ".join(
        [
            " " + _f("candidate-uncarved", "error", "id", "1", "FROM n WHERE candidate"),
            _f("placeholder-title", "error", "id", "1", "FROM n WHERE type = 'Component' AND title LIKE '%(3 files)'"),
            _f("meaningful-slug", "warn", "id", "1", "FROM n WHERE regexp_matches(id, '^(layer:t:band|component:t:c)[0-9]+$')"),
            _f("knowledge-description-missing", "warn", "id", "1", "FROM n WHERE type IN ('Decision', 'Risk', 'Constraint', 'Goal') AND trim(description) = ''"),
        ]
    )
)
def carving_text(spark, sf_dir):
    return carving.text_rules(carved(spark, sf_dir).nodes).drop("detail")


@query(
    _W
    + f""", cm AS ({_of("Component")}), om AS ({_of("Concern")}), lm AS ({_of("Layer")}), f AS (SELECT id, role, path FROM n WHERE type = 'File'),
    impl AS (SELECT id FROM f WHERE role <> 'test'), ci AS (SELECT * FROM cm WHERE member IN (SELECT id FROM impl)), oi AS (SELECT * FROM om WHERE member IN (SELECT id FROM impl)),
    cs AS (SELECT grp, count(*) AS n FROM ci GROUP BY grp), os AS (SELECT grp, count(*) AS n FROM oi GROUP BY grp),
    j AS (SELECT oi.grp AS o, ci.grp AS c, count(*) AS k FROM oi JOIN ci USING (member) GROUP BY ALL),
    home AS (SELECT member, max(grp) AS part FROM cm GROUP BY member), placed AS (SELECT grp, part, count(*) AS k FROM om JOIN home USING (member) WHERE grp IN (SELECT grp FROM om GROUP BY grp HAVING count(*) >= 3) GROUP BY ALL),
    un AS (SELECT count(*) AS k FROM f WHERE id NOT IN (SELECT member FROM cm) AND {_EXEMPT} AND role <> 'documentation'), tot AS (SELECT count(*) AS n FROM f WHERE role <> 'documentation')
    """
    + " UNION ALL ".join(
        [
            _f("layer-no-doc", "warn", "member", "1", "FROM lm JOIN f ON f.id = member WHERE role = 'documentation'"),
            _f("component-coverage", "error", "id", "1", f"FROM f WHERE id NOT IN (SELECT member FROM cm) AND NOT {_EXEMPT}"),
            _f("layer-coverage", "warn", "id", "1", f"FROM f WHERE id NOT IN (SELECT member FROM lm) AND NOT {_EXEMPT}"),
            _f("concern-component-duplicate", "warn", "o", "k", "FROM j JOIN cs ON cs.grp = c JOIN os ON os.grp = o WHERE k / (cs.n + os.n - k) >= 0.2"),
            _f("concern-component-dominance", "warn", "grp", "sum(k)", "FROM placed GROUP BY grp HAVING max(k) / sum(k) > 0.3"),
            _f("multi-concern-membership", "warn", "member", "count(*)", "FROM om GROUP BY member HAVING count(*) >= 3"),
            _f("exemption-ratio-high", "warn", "'exemptions'", "k", "FROM un, tot WHERE n > 0 AND k / n > 0.001"),
            _f("indexer-signal-missing", "info", "'files'", "count(*)", "FROM f"),
        ]
    )
)
def carving_structure(spark, sf_dir):
    g = carved(spark, sf_dir)
    return carving.structure_rules(g.nodes, g.edges, jaccard=0.2, share=0.3, exempt_share=0.001).drop("detail")


@query(
    _W
    + " UNION ALL ".join(
        [
            " " + _f("knowledge-impl-binding-missing", "warn", "id", "1", "FROM n WHERE type IN ('Decision', 'Risk') AND id NOT IN (SELECT src FROM e WHERE type IN ('sets_policy_for', 'documented_by') AND dst LIKE 'file:%')"),
            _f("crosscut-policy-hub", "warn", "dst", "count(*)", "FROM e WHERE type IN ('sets_policy_for', 'risks_in') AND dst LIKE 'concern:%' GROUP BY dst HAVING count(*) >= 8"),
            _f("goal-island", "warn", "id", "1", "FROM n WHERE type = 'Goal' AND id NOT IN (SELECT dst FROM e WHERE type = 'has_premise')"),
            _f("superseded-premise", "warn", "src", "1", "FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE e.type = 'has_premise' AND a.state IS NULL AND b.state IN ('superseded', 'abandoned')"),
            _f("superseded-no-successor", "warn", "id", "1", "FROM n WHERE state = 'superseded' AND id NOT IN (SELECT dst FROM e WHERE type = 'refines')"),
            _f("constraint-binding-missing", "warn", "id", "1", "FROM n WHERE type = 'Constraint' AND id NOT IN (SELECT src FROM e WHERE type = 'constrains')"),
        ]
    )
)
def carving_knowledge(spark, sf_dir):
    g = carved(spark, sf_dir)
    return carving.knowledge_rules(g.nodes, g.edges).drop("detail")


_FRAME_PATHS = "SELECT DISTINCT 'src/d' || (l_partkey % 60) || '/f' || l_partkey || CASE l_partkey % 11 WHEN 0 THEN '.md' WHEN 1 THEN '.env' ELSE '.ts' END AS path FROM lineitem"


@query(
    _W
    + f""", p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({_FRAME_PATHS})),
    f AS (SELECT n.path, max(e.src IS NOT NULL) AS framed FROM n LEFT JOIN e ON e.dst = n.id AND e.type = 'evidenced_by' WHERE n.type = 'File' GROUP BY n.path),
    c AS (SELECT regexp_extract(n.path, '^(.*)/[^/]*$', 1) AS dir, min(e.src) AS component, count(DISTINCT e.src) AS claims FROM e JOIN n ON n.id = e.dst WHERE e.type = 'evidenced_by' AND e.src LIKE 'component:%' GROUP BY 1)
    SELECT p.path, p.dir, CASE WHEN p.path NOT LIKE '%.ts' THEN 'non-impl' WHEN framed THEN 'registered' WHEN framed IS NOT NULL THEN 'known-unframed' WHEN claims = 1 THEN 'unwired' ELSE 'unclaimed' END AS status,
           CASE WHEN claims = 1 THEN component END AS component FROM p LEFT JOIN f USING (path) LEFT JOIN c USING (dir)"""
)
def frame_status(spark, sf_dir):
    key = F.col("l_partkey")
    path = F.concat(F.lit("src/d"), key % 60, F.lit("/f"), key, F.when(key % 11 == 0, ".md").when(key % 11 == 1, ".env").otherwise(".ts"))
    paths = table(spark, sf_dir, "lineitem").select(path.alias("path"))
    return checks.frame_entries(carved(spark, sf_dir), paths)


@query(
    _W
    + """, p AS (SELECT id, path FROM n WHERE type = 'File' AND path LIKE 'src/d1%'),
    w AS (SELECT e.src AS id, count(*) AS n FROM e JOIN p ON p.id = e.dst WHERE e.type = 'documented_by' GROUP BY e.src)
    SELECT id, n.type, title, w.n FROM w JOIN n USING (id) ORDER BY CASE n.type WHEN 'Constraint' THEN 0 WHEN 'Decision' THEN 1 WHEN 'Risk' THEN 3 WHEN 'Goal' THEN 4 ELSE 9 END, w.n DESC, id LIMIT 20"""
)
def delta_connected(spark, sf_dir):
    g = carved(spark, sf_dir)
    paths = g.nodes.filter("type = 'File' and path like 'src/d1%'").select("path")
    return checks.connected_knowledge(g, paths).select("id", "type", "title", "n")


@query(_W + " SELECT count(*) AS total, count(*) FILTER (id NOT IN (SELECT src FROM e WHERE type = 'enforced_by')) AS unguarded FROM n WHERE type = 'Constraint'")
def enforcement_debt(spark, sf_dir):
    return checks.enforcement_debt(carved(spark, sf_dir))


@query(_W + " SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, src AS component, count(*) AS n FROM e JOIN n ON n.id = dst WHERE e.type = 'evidenced_by' AND src LIKE 'component:%' GROUP BY ALL")
def component_claims(spark, sf_dir):
    g = carved(spark, sf_dir)
    return checks.claimants(KnowledgeGraph(g.nodes.withColumn("dir", dirname(F.col("path"))), g.edges))
