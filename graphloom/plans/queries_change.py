"""Change queries: diffs, merges, change sets, ledgers, references, keyed state."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import diff as di
from ..operators import mutate as mu
from ..operators import xref
from ..operators.rules import finding
from ..streaming import state
from .projection import EDGES_SQL, NODES_SQL, edges, nodes, table
from .registry import query

_BASE = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS priority FROM orders"
_BRANCH = f"SELECT id, status, CASE WHEN id % 10 = 1 THEN price + 1 ELSE price END AS price, priority FROM ({_BASE}) WHERE id % 10 <> 0"
_MAIN = f"SELECT id, CASE WHEN id % 10 IN (1, 2) THEN 'X' ELSE status END AS status, CASE WHEN id % 100 = 1 THEN price + 2 ELSE price END AS price, priority FROM ({_BASE}) UNION ALL SELECT -id - 1, status, price, priority FROM ({_BASE}) WHERE id % 10 = 3"
_DIFF = """
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
           CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END) END AS properties
    FROM ({}) a FULL JOIN ({}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price OR a.priority IS DISTINCT FROM b.priority
"""


def _snapshots(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    last = F.col("id") % 10
    branch = base.filter(last != 0).withColumn("price", F.when(last == 1, F.col("price") + 1).otherwise(F.col("price")))
    main = base.withColumns({"status": F.when(last.isin(1, 2), "X").otherwise(F.col("status")), "price": F.when(F.col("id") % 100 == 1, F.col("price") + 2).otherwise(F.col("price"))})
    return base, branch, main.unionByName(base.filter(last == 3).withColumn("id", -F.col("id") - 1))


@query(_DIFF.format(_BASE, _MAIN))
def snapshot_diff(spark, sf_dir):
    base, _, main = _snapshots(spark, sf_dir)
    return di.diff(base, main).select("id", "change", F.array_join("properties", ",").alias("properties"))


@query(f"""
    SELECT a.id, property, before, after FROM ({_BASE}) a JOIN ({_MAIN}) b ON a.id = b.id,
    LATERAL (SELECT 'status' AS property, a.status AS before, b.status AS after WHERE a.status IS DISTINCT FROM b.status) p
""")
def property_diff(spark, sf_dir):
    base, _, main = _snapshots(spark, sf_dir)
    return di.property_diff(di.diff(base, main)).filter("property = 'status'")


@query(f"SELECT 'node' AS kind, change, count(*) AS n FROM ({_DIFF.format(_BASE, _BRANCH)}) GROUP BY change")
def delta_summary(spark, sf_dir):
    base, branch, _ = _snapshots(spark, sf_dir)
    return di.summarize(di.diff(base, branch), "node")


_CONFLICTS = f"""
    SELECT 'node_co_modified' AS signal, a.id AS subject, CASE WHEN len(list_intersect(string_split(a.properties, ','), string_split(b.properties, ','))) > 0 THEN 'semantic' ELSE 'mechanical' END AS class,
           array_to_string(list_sort(list_intersect(string_split(a.properties, ','), string_split(b.properties, ','))), ',') AS detail
    FROM ({_DIFF.format(_BASE, _BRANCH)}) a JOIN ({_DIFF.format(_BASE, _MAIN)}) b ON a.id = b.id WHERE a.change = 'modified' AND b.change = 'modified'
"""


@query(_CONFLICTS)
def three_way_conflicts(spark, sf_dir):
    base, branch, main = _snapshots(spark, sf_dir)
    return di.co_modified(di.diff(base, branch), di.diff(base, main))


@query(f"SELECT class, count(*) AS n FROM ({_CONFLICTS}) GROUP BY class")
def conflict_class(spark, sf_dir):
    return three_way_conflicts(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""
    SELECT 'edge_target_co_added' AS signal, a.dst AS subject, 'mechanical' AS class, 'supplied_by:' || na || ':' || nb AS detail
    FROM (SELECT dst, count(*) AS na FROM ({EDGES_SQL}) WHERE type = 'supplied_by' AND src LIKE '%1' GROUP BY dst) a JOIN (SELECT dst, count(*) AS nb FROM ({EDGES_SQL}) WHERE type = 'supplied_by' AND src LIKE '%2' GROUP BY dst) b USING (dst)
""")
def edge_target_co_added(spark, sf_dir):
    own = edges(spark, sf_dir)
    return di.edge_target_co_added(own.filter(F.col("src").endswith("1")), own.filter(F.col("src").endswith("2")), ("supplied_by",))


@query(f"""
    SELECT id, CASE WHEN id % 10 = 2 THEN 'X' ELSE status END AS status, CASE WHEN id % 10 = 2 THEN NULL ELSE priority END AS priority, price FROM ({_BASE}) WHERE id % 10 <> 0
    UNION ALL SELECT -id - 1, 'N', NULL, 1.5 FROM ({_BASE}) WHERE id % 10 = 5
""")
def mutation_apply(spark, sf_dir):
    base, _, _ = _snapshots(spark, sf_dir)
    last = F.col("id") % 10
    none = F.array().cast("array<string>")
    changes = (
        base.filter(last == 0).select("id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), none.alias("nulls"))
        .unionByName(base.filter(last == 2).select("id", F.lit("update").alias("op"), F.lit("X").alias("status"), F.lit(None).cast("double").alias("price"), F.array(F.lit("priority")).alias("nulls")))
        .unionByName(base.filter(last == 5).select((-F.col("id") - 1).alias("id"), F.lit("create").alias("op"), F.lit("N").alias("status"), F.lit(1.5).alias("price"), none.alias("nulls")))
    )
    return mu.apply_changes(base, changes)


@query(f"""
    WITH g AS (SELECT id FROM ({NODES_SQL}) WHERE type = 'Customer' AND id LIKE '%7')
    SELECT e.id, type, src, dst, CASE WHEN src IN (SELECT id FROM g) AND dst IN (SELECT id FROM g) THEN least(src, dst) WHEN src IN (SELECT id FROM g) THEN src ELSE dst END AS deleted_with
    FROM ({EDGES_SQL}) e WHERE src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g)
""")
def cascade_delete(spark, sf_dir):
    gone = nodes(spark, sf_dir).filter("type = 'Customer' and id like '%7'").select("id")
    return mu.cascaded_edges(edges(spark, sf_dir), gone)


@query(f"""
    WITH n AS (SELECT id, type FROM ({NODES_SQL}) WHERE type = 'Customer'),
    c AS (SELECT id, type, 'create' AS op FROM n WHERE id LIKE '%1' UNION ALL SELECT id || 'x', type, 'update' FROM n WHERE id LIKE '%2' UNION ALL SELECT id, 'Supplier', 'update' FROM n WHERE id LIKE '%3' UNION ALL SELECT id, NULL, 'delete' FROM n WHERE id LIKE '%3')
    SELECT 'duplicate-node-change' AS rule, 'error' AS severity, id AS subject_id, '' AS detail, count(*) AS n FROM c GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'create-existing-node', 'error', id, '', 1 FROM c WHERE op = 'create' AND id IN (SELECT id FROM n)
    UNION ALL SELECT 'missing-node', 'error', id, '', 1 FROM c WHERE op <> 'create' AND id NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'immutable-type', 'error', c.id, '', 1 FROM c JOIN n USING (id) WHERE op = 'update' AND c.type <> n.type
""")
def plan_validation(spark, sf_dir):
    own = nodes(spark, sf_dir).filter("type = 'Customer'").select("id", "type")
    ends = F.substring("id", -1, 1)
    changes = (
        own.filter(ends == "1").select("id", "type", F.lit("create").alias("op"))
        .unionByName(own.filter(ends == "2").select(F.concat("id", F.lit("x")).alias("id"), "type", F.lit("update").alias("op")))
        .unionByName(own.filter(ends == "3").select("id", F.lit("Supplier").alias("type"), F.lit("update").alias("op")))
        .unionByName(own.filter(ends == "3").select("id", F.lit(None).cast("string").alias("type"), F.lit("delete").alias("op")))
    )
    return mu.plan_failures(own, changes)


@query(f"""
    SELECT 'source-backing' AS rule, 'error' AS severity, id AS subject_id, '' AS detail, 1::BIGINT AS n FROM ({NODES_SQL}) WHERE type = 'Order' AND id NOT IN (
        SELECT src FROM ({EDGES_SQL}) WHERE type = 'contains_part' AND dst IN (SELECT 'p:' || p_partkey FROM part WHERE p_size <= 5))
""")
def source_backing(spark, sf_dir):
    small = table(spark, sf_dir, "part").filter("p_size <= 5").select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("dst"))
    backed = edges(spark, sf_dir).filter("type = 'contains_part'").join(small, "dst", "left_semi").select(F.col("src").alias("id"))
    return finding(nodes(spark, sf_dir).filter("type = 'Order'").join(backed, "id", "left_anti"), "source-backing", "id")


@query("""
    SELECT user_id AS id, event_type AS reason, ts AS deleted_at, event_id AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def tombstone_last_wins(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("reason"), F.col("ts").alias("deleted_at"), F.col("event_id").alias("position"))
    return mu.latest(entries, "id", "deleted_at", "position")


@query("""
    WITH r AS (SELECT c_custkey AS edge_id, 'vault:' || CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE 'v' || (c_nationkey % 5) END || '/n:' || (c_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 100 ELSE 0 END) AS ref FROM customer),
    p AS (SELECT edge_id, ref, regexp_extract(ref, '^vault:([^/]+)/(.+)$', 1) AS slug, regexp_extract(ref, '^vault:([^/]+)/(.+)$', 2) AS node FROM r),
    v AS (SELECT DISTINCT 'v' || (n_nationkey % 5) AS slug FROM nation), n AS (SELECT 'v' || (n_nationkey % 5) AS slug, 'n:' || n_nationkey AS node FROM nation)
    SELECT edge_id, ref, CASE WHEN v.slug IS NULL THEN 'unresolvable' WHEN n.node IS NOT NULL THEN 'resolved' WHEN p.node IN ('n:100', 'n:101', 'n:102') THEN 'tombstoned' ELSE 'broken' END AS status
    FROM p LEFT JOIN v USING (slug) LEFT JOIN n ON n.slug = p.slug AND n.node = p.node
""")
def xref_resolution(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), F.col("n_nationkey") % 5).alias("slug"), F.concat(F.lit("n:"), F.col("n_nationkey")).alias("node"))
    slug = F.when(F.col("c_custkey") % 7 == 0, "nowhere").otherwise(F.concat(F.lit("v"), F.col("c_nationkey") % 5))
    node = F.concat(F.lit("n:"), F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 100).otherwise(0))
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("edge_id"), F.concat(F.lit("vault:"), slug, F.lit("/"), node).alias("ref"))
    vaults = nation.select("slug").distinct().withColumn("aliases", F.array().cast("array<string>"))
    gone = spark.createDataFrame([(f"v{s}", f"n:{100 + k}") for s in range(5) for k in range(3)], "slug string, node string")
    return xref.resolve(refs, vaults, nation, gone).select("edge_id", "ref", "status")


@query("SELECT user_id AS fingerprint, count(*) AS calls, max(ts) AS last_at FROM events GROUP BY user_id")
def ask_state_counter(spark, sf_dir):
    return state.call_counts(table(spark, sf_dir, "events"), "user_id", "ts")


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def stream_tumbling(spark, sf_dir):
    """The batch twin of the tumbling stream: one plan serves both."""
    return state.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM events),
    s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_session(spark, sf_dir):
    return state.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
    SELECT id, type, title, 'cleanup' AS reason, TIMESTAMP '1996-06-01' AS deleted_at, '1996-06' AS month, (SELECT count(*) FROM ({EDGES_SQL}) e WHERE (e.src = n.id OR e.dst = n.id)) AS cascaded FROM ({NODES_SQL}) n WHERE type = 'Supplier'
""")
def tombstone_entries(spark, sf_dir):
    gone = nodes(spark, sf_dir).filter("type = 'Supplier'").select("id", F.lit("cleanup").alias("reason"), F.lit(None).cast("string").alias("successor"))
    out = mu.tombstones(nodes(spark, sf_dir), edges(spark, sf_dir), gone, datetime.datetime(1996, 6, 1))
    return out.select("id", "type", "title", "reason", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"), "month", F.size("cascaded_edges").cast("long").alias("cascaded"))
