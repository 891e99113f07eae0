"""Rule queries: each gives findings over the projected graph."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import rules as ru
from ..schema import BENCH
from .projection import EDGES_SQL, NODES_SQL, edges, nodes, table
from .registry import query

NOW = datetime.datetime(2001, 12, 1)


def _finding_sql(rule: str, severity: str, subject: str, detail: str, n: str, rest: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {subject} AS subject_id, {detail} AS detail, CAST({n} AS BIGINT) AS n {rest}"


_SMALL_NODES = f"SELECT * FROM ({NODES_SQL}) WHERE type <> 'Part' OR id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size <= 25)"


def _large(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 25 or p_size is null").select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("id"))


def _small(spark, sf_dir):
    """Nodes without the large parts, so that edges dangle."""
    return nodes(spark, sf_dir).join(_large(spark, sf_dir), "id", "left_anti")


@query(_finding_sql("missing-dst", "error", "e.id", "dst", "1", f"FROM ({EDGES_SQL}) e WHERE dst NOT IN (SELECT id FROM ({_SMALL_NODES}))"))
def dangling_edges(spark, sf_dir):
    return ru.dangling_edges(_small(spark, sf_dir), edges(spark, sf_dir))


@query(_finding_sql("edge-rule", "error", "e.id", "a.type || ':' || e.type || ':' || b.type", "1", f"""
    FROM (SELECT id, CASE WHEN src LIKE 's:%' THEN 'placed_by' ELSE type END AS type, src, dst FROM ({EDGES_SQL})) e
    JOIN ({NODES_SQL}) a ON a.id = src JOIN ({NODES_SQL}) b ON b.id = dst WHERE src LIKE 's:%'
"""))
def edge_rule_violations(spark, sf_dir):
    wrong = edges(spark, sf_dir).withColumn("type", F.when(F.col("src").startswith("s:"), "placed_by").otherwise(F.col("type")))
    return ru.edge_rule_violations(nodes(spark, sf_dir), wrong, BENCH)


@query(_finding_sql("duplicate-node-id", "error", "id", "''", "n", "FROM (SELECT l_orderkey || ':' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)"))
def duplicate_ids(spark, sf_dir):
    return ru.repeated_ids(table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")))


@query(_finding_sql("bad-state", "error", "id", "type || ':' || state", "1", f"FROM (SELECT id, type, CASE WHEN type = 'Customer' THEN 'active' WHEN state = 'planned' THEN 'pending' ELSE state END AS state FROM ({NODES_SQL})) WHERE (type = 'Customer') OR state = 'pending'"))
def state_vocab_violations(spark, sf_dir):
    state = F.when(F.col("type") == "Customer", "active").when(F.col("state") == "planned", "pending").otherwise(F.col("state"))
    return ru.bad_states(nodes(spark, sf_dir).withColumn("state", state), BENCH)


@query(_finding_sql("customer-without-order", "warn", "id", "''", "1", f"FROM ({NODES_SQL}) WHERE type = 'Customer' AND id NOT IN (SELECT 'c:' || o_custkey FROM orders)"))
def anti_orphans(spark, sf_dir):
    own = nodes(spark, sf_dir).filter("type = 'Customer'")
    return ru.without_edge(own, edges(spark, sf_dir), "customer-without-order", "placed_by", end="dst")


@query(_finding_sql("superseded-premise", "warn", "'c:' || o_custkey", "'o:' || o_orderkey || ':closed'", "1", "FROM orders WHERE o_orderstatus = 'F'"))
def semi_terminal_premise(spark, sf_dir):
    turned = edges(spark, sf_dir).filter("type = 'placed_by'").select("id", "type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ru.ended_premises(nodes(spark, sf_dir), turned, "placed_by")


@query(_finding_sql("settled-premise", "warn", "'c:' || o_custkey", "''", "count(*)", "FROM orders GROUP BY o_custkey HAVING count(*) = count(*) FILTER (o_orderstatus IN ('F', 'P'))"))
def settled_premise(spark, sf_dir):
    turned = edges(spark, sf_dir).filter("type = 'placed_by'").select("id", "type", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return ru.settled_premises(nodes(spark, sf_dir), turned, "placed_by", ("closed", "planned"))


@query(_finding_sql("closed-without-successor", "warn", "id", "''", "1", f"FROM ({NODES_SQL}) WHERE type = 'Order' AND state = 'closed' AND id NOT IN (SELECT 'o:' || (o_orderkey - 1) FROM orders WHERE o_orderkey % 2 = 1)"))
def missing_successor(spark, sf_dir):
    follows = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 1").select(F.lit("supersedes").alias("type"), F.concat(F.lit("o:"), F.col("o_orderkey")).alias("src"), F.concat(F.lit("o:"), F.col("o_orderkey") - 1).alias("dst"))
    return ru.without_edge(nodes(spark, sf_dir).filter("type = 'Order' and state = 'closed'"), follows, "closed-without-successor", "supersedes", end="dst")


@query(_finding_sql("supplier-overload", "warn", "'s:' || l_suppkey", "''", "count(DISTINCT l_orderkey)", "FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 600"))
def supplier_overload(spark, sf_dir):
    return ru.overloaded(edges(spark, sf_dir), "supplier-overload", "supplied_by", 600, end="dst")


@query(_finding_sql("stale-active", "warn", "'o:' || o_orderkey", "CAST(date_diff('day', o_orderdate::DATE, DATE '2001-12-01') AS VARCHAR)", "1", "FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '2001-12-01') > 900"))
def stocktake_stale(spark, sf_dir):
    return ru.stale_nodes(nodes(spark, sf_dir), "stale-active", "active", 900, NOW)


@query(_finding_sql("stale-binding", "warn", "'o:' || o_orderkey", "CAST(l_orderkey AS VARCHAR)", "count(*)", "FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey, l_orderkey HAVING count(*) >= 5"))
def staleness_commits(spark, sf_dir):
    from ..operators.staleness import commits_since

    bound = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("generated_at"))
    commits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_shipdate").alias("ts"))
    return commits_since(bound, commits, 5)


@query("""
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.p IS NOT NULL THEN 'registered' WHEN p_size > 40 THEN 'exempt' ELSE 'unframed' END AS status
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey % 3 = 0) l ON l.p = p_partkey) GROUP BY status
""")
def unframed_paths(spark, sf_dir):
    framed = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("framed", F.lit(True))
    status = F.when(F.col("framed"), "registered").when(F.col("p_size") > 40, "exempt").otherwise("unframed")
    return table(spark, sf_dir, "part").join(framed, "p_partkey", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""
    SELECT p_brand AS area, count(*) AS total, count(*) FILTER (p_size > 40) AS exempt, round(count(*) FILTER (p_size > 40) / count(*), 4) AS ratio
    FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size > 40) / count(*) > 0.15
""")
def exemption_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("area")).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 40).alias("exempt"))
    return rows.filter(F.col("exempt") / F.col("total") > 0.15).select("*", F.round(F.col("exempt") / F.col("total"), 4).alias("ratio"))


@query(r"""
    SELECT 'progress-claim' AS rule, 'info' AS severity, CAST(conv_id AS VARCHAR) || ':' || turn AS subject_id,
           array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(the|and|with)\b'), lambda x: lower(x)))), ',') AS detail, 1::BIGINT AS n
    FROM conversations WHERE regexp_matches(text, '(?i)\b(the|and|with)\b')
""")
def progress_claims(spark, sf_dir):
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(the|and|with)\b"), F.lit(0)), F.lower)))
    rows = table(spark, sf_dir, "conversations").filter(F.col("text").rlike(r"(?i)\b(the|and|with)\b"))
    return ru.finding(rows, "progress-claim", F.concat_ws(":", "conv_id", "turn"), "info", F.array_join(found, ","))
