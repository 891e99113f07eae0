"""The test tables projected onto a graph, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate
from ..graph import KnowledgeGraph

NODE_COLUMNS = ("id", "type", "title", "summary", "state", "generated_at", "path")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ref(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per region, nation, customer, supplier, part, order, document and page."""
    none = F.lit(None).cast("string")
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "planned")
    shapes = [
        ("region", "r", "r_regionkey", "Region", {"title": F.col("r_name")}),
        ("nation", "n", "n_nationkey", "Nation", {"title": F.col("n_name")}),
        ("customer", "c", "c_custkey", "Customer", {"title": F.col("c_name"), "summary": F.col("c_mktsegment")}),
        ("supplier", "s", "s_suppkey", "Supplier", {"title": F.col("s_name")}),
        ("part", "p", "p_partkey", "Part", {"title": F.col("p_name"), "summary": F.col("p_type"), "path": F.col("p_brand")}),
        ("orders", "o", "o_orderkey", "Order", {"title": F.col("o_orderpriority"), "state": state, "generated_at": F.col("o_orderdate")}),
        ("documents", "d", "doc_id", "Document", {"title": truncate(F.col("text"), 60), "path": F.col("source")}),
        ("pages", "g", "page_id", "Page", {"path": F.col("url")}),
    ]
    out = None
    for name, kind, key, label, own in shapes:
        columns = {"title": none, "summary": none, "state": none, "generated_at": F.lit(None).cast("timestamp_ntz"), "path": none} | own
        rows = table(spark, sf_dir, name).select(_ref(kind, key).alias("id"), F.lit(label).alias("type"), *(columns[c].alias(c) for c in NODE_COLUMNS[2:]))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (type, src, dst) with an id made of them."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = [
        table(spark, sf_dir, "nation").select(F.lit("in_region").alias("type"), _ref("n", "n_nationkey").alias("src"), _ref("r", "n_regionkey").alias("dst")),
        table(spark, sf_dir, "customer").select(F.lit("in_nation").alias("type"), _ref("c", "c_custkey").alias("src"), _ref("n", "c_nationkey").alias("dst")),
        table(spark, sf_dir, "supplier").select(F.lit("in_nation").alias("type"), _ref("s", "s_suppkey").alias("src"), _ref("n", "s_nationkey").alias("dst")),
        orders.select(F.lit("placed_by").alias("type"), _ref("o", "o_orderkey").alias("src"), _ref("c", "o_custkey").alias("dst")),
        items.select("l_orderkey", "l_partkey").distinct().select(F.lit("contains_part").alias("type"), _ref("o", "l_orderkey").alias("src"), _ref("p", "l_partkey").alias("dst")),
        items.select("l_orderkey", "l_suppkey").distinct().select(F.lit("supplied_by").alias("type"), _ref("o", "l_orderkey").alias("src"), _ref("s", "l_suppkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.concat_ws("__", "src", "type", "dst").alias("id"), "type", "src", "dst")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, vec_id, vector, label): the embedding of the document with the same number."""
    return table(spark, sf_dir, "embeddings").select(_ref("d", "vec_id").alias("node_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def graph(spark: SparkSession, sf_dir: str) -> KnowledgeGraph:
    return KnowledgeGraph(nodes(spark, sf_dir), edges(spark, sf_dir), vectors(spark, sf_dir))


NODES_SQL = """
    SELECT 'r:' || r_regionkey AS id, 'Region' AS type, r_name AS title, NULL::VARCHAR AS summary, NULL::VARCHAR AS state, NULL::TIMESTAMP AS generated_at, NULL::VARCHAR AS path FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'Nation', n_name, NULL, NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'c:' || c_custkey, 'Customer', c_name, c_mktsegment, NULL, NULL, NULL FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'Supplier', s_name, NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'p:' || p_partkey, 'Part', p_name, p_type, NULL, NULL, p_brand FROM part
    UNION ALL SELECT 'o:' || o_orderkey, 'Order', o_orderpriority, NULL, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'active' WHEN 'P' THEN 'planned' END, o_orderdate, NULL FROM orders
    UNION ALL SELECT 'd:' || doc_id, 'Document', CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END, NULL, NULL, NULL, source FROM documents
    UNION ALL SELECT 'g:' || page_id, 'Page', NULL, NULL, NULL, NULL, url FROM pages
"""

EDGES_SQL = """
    SELECT src || '__' || type || '__' || dst AS id, type, src, dst FROM (
        SELECT 'in_region' AS type, 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst FROM nation
        UNION ALL SELECT 'in_nation', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
        UNION ALL SELECT 'in_nation', 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier
        UNION ALL SELECT 'placed_by', 'o:' || o_orderkey, 'c:' || o_custkey FROM orders
        UNION ALL SELECT DISTINCT 'contains_part', 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'supplied_by', 'o:' || l_orderkey, 's:' || l_suppkey FROM lineitem
    )
"""

VECTORS_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
