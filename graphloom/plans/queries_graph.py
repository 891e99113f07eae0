"""Graph queries: the projection, traversal, components, chains, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import similarity as sim
from ..operators import traverse as tr
from ..operators.components import connected_components
from ..operators.rules import dominance, overlapping_groups
from .projection import EDGES_SQL, NODES_SQL, VECTORS_SQL, edges, nodes, table, vectors
from .registry import query

KNN_LEAST, KNN_TOP = 0.30, 4


@query(NODES_SQL)
def graph_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(EDGES_SQL)
def graph_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"SELECT type, count(*) AS n FROM ({NODES_SQL}) GROUP BY type")
def count_by_type(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""
    SELECT type, count(*) AS n, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'closed') AS closed,
           count(*) FILTER (state IS NULL) AS stateless, count(DISTINCT path) AS paths FROM ({NODES_SQL}) GROUP BY type
""")
def cond_counts(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("state") == "active").alias("active"),
        F.count_if(F.col("state") == "closed").alias("closed"),
        F.count_if(F.col("state").isNull()).alias("stateless"),
        F.count_distinct("path").alias("paths"),
    )


@query(f"""
    WITH e AS ({EDGES_SQL}), d AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1)
    SELECT dst AS customer, count(*) AS orders, count(DISTINCT src) AS distinct_orders FROM e WHERE type = 'placed_by' GROUP BY dst HAVING count(*) >= 12
""")
def having_overload(spark, sf_dir):
    placed = edges(spark, sf_dir).filter("type = 'placed_by'")
    return placed.groupBy(F.col("dst").alias("customer")).agg(F.count("*").alias("orders"), F.count_distinct("src").alias("distinct_orders")).filter("orders >= 12")


@query(f"""
    SELECT id, count(DISTINCT other) AS neighbors, count(*) AS links FROM (
        SELECT src AS id, dst AS other FROM ({EDGES_SQL}) UNION ALL SELECT dst, src FROM ({EDGES_SQL})
    ) WHERE id LIKE 's:%' OR id LIKE 'n:%' GROUP BY id
""")
def distinct_neighbors(spark, sf_dir):
    around = tr.both_ways(edges(spark, sf_dir)).filter(F.col("node").startswith("s:") | F.col("node").startswith("n:"))
    return around.groupBy(F.col("node").alias("id")).agg(F.count_distinct("other").alias("neighbors"), F.count("*").alias("links"))


@query(f"""
    WITH d AS (SELECT dst AS id, count(*) AS degree FROM ({EDGES_SQL}) WHERE type = 'contains_part' GROUP BY dst),
    m AS (SELECT avg(degree) + 2 * stddev_pop(degree) AS cut FROM d)
    SELECT id, degree FROM d, m WHERE degree > cut
""")
def hub_nodes(spark, sf_dir):
    degree = edges(spark, sf_dir).filter("type = 'contains_part'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    cut = degree.agg((F.avg("degree") + 2 * F.stddev_pop("degree")).alias("cut"))
    return degree.join(F.broadcast(cut), F.lit(True)).filter("degree > cut").select("id", "degree")


@query(f"""
    WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({EDGES_SQL}) WHERE type IN ('in_region', 'in_nation') UNION SELECT dst, src FROM ({EDGES_SQL}) WHERE type IN ('in_region', 'in_nation')),
    w(id, distance) AS (SELECT 'c:1', 0 UNION SELECT b, distance + 1 FROM w JOIN e ON a = id WHERE distance < 4)
    SELECT id, min(distance) AS distance FROM w GROUP BY id
""")
def khop_distance(spark, sf_dir):
    seeds = spark.createDataFrame([("c:1",)], "id string")
    return tr.khop_distance(edges(spark, sf_dir).filter(F.col("type").isin("in_region", "in_nation")), seeds, 4)


@query(f"""
    WITH a AS (SELECT id, type, src AS node, dst AS other FROM ({EDGES_SQL}) UNION ALL SELECT id, type, dst, src FROM ({EDGES_SQL})),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS k FROM a WHERE node IN ('n:3', 'c:7', 's:5')),
    o AS (SELECT id, min(struct_pack(node := node, k := k)) AS m FROM r WHERE k <= 10 GROUP BY id)
    SELECT e.id, e.type, src, dst, 1 AS depth FROM o JOIN ({EDGES_SQL}) e USING (id) ORDER BY m.node, m.k LIMIT 40
""")
def neighbors_capped(spark, sf_dir):
    seeds = spark.createDataFrame([("n:3",), ("c:7",), ("s:5",)], "id string")
    return tr.neighbors_capped(edges(spark, sf_dir), seeds, depth=1)


@query(f"""
    WITH e AS (SELECT * FROM ({EDGES_SQL}) WHERE type IN ('in_region', 'in_nation', 'placed_by')),
    a AS (SELECT id, src AS node, dst AS other FROM e UNION ALL SELECT id, dst, src FROM e),
    r1 AS (SELECT 'c:' || c_custkey AS seed, a.*, row_number() OVER (PARTITION BY c_custkey ORDER BY a.id) AS k FROM customer JOIN a ON a.node = 'c:' || c_custkey),
    t1 AS (SELECT * FROM r1 WHERE k <= 10),
    r2 AS (SELECT f.seed, a.*, row_number() OVER (PARTITION BY f.seed, a.node ORDER BY a.id) AS k
           FROM (SELECT DISTINCT seed, other AS node FROM t1) f JOIN a ON a.node = f.node
           WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.seed = f.seed AND t1.id = a.id)),
    o2 AS (SELECT seed, id, min(struct_pack(node := node, k := k)) AS m FROM r2 WHERE k <= 10 GROUP BY seed, id),
    u AS (SELECT seed, id, node, k, 1 AS depth FROM t1 UNION ALL SELECT seed, id, m.node, m.k, 2 FROM o2),
    n AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node, k, id) AS place FROM u)
    SELECT seed, id, type, src, dst, CAST(depth AS INTEGER) AS depth FROM n JOIN e USING (id) WHERE place <= 40
""")
def neighbors_of_each(spark, sf_dir):
    """What each customer meets in two rounds, every customer with visited edges and caps of its own."""
    links = edges(spark, sf_dir).filter(F.col("type").isin("in_region", "in_nation", "placed_by"))
    return tr.neighbors_of_each(links, nodes(spark, sf_dir).filter("type = 'Customer'").select("id"), depth=2)


@query(f"""
    SELECT id, other, edge_type, CAST(rank AS INTEGER) AS rank FROM (
        SELECT dst AS id, src AS other, type AS edge_type, row_number() OVER (PARTITION BY dst ORDER BY src, id) AS rank FROM ({EDGES_SQL}) WHERE type = 'placed_by'
    ) WHERE rank <= 3
""")
def linked_nodes(spark, sf_dir):
    own = nodes(spark, sf_dir)
    return tr.linked_nodes(edges(spark, sf_dir), own, own.filter("type = 'Customer'").select("id"), "placed_by", "Order", 3)


def knn(spark, sf_dir):
    """Each vector's most similar ones of its label."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "vector")
    return sim.top_matches(rows, rows, "label", KNN_LEAST, KNN_TOP)


KNN_SQL = f"""
    SELECT id, match, round(c, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
        SELECT a.vec_id AS id, b.vec_id AS match, list_cosine_similarity(a.v, b.v) AS c,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank
        FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {KNN_LEAST}
    ) WHERE rank <= {KNN_TOP}
"""


@query(KNN_SQL)
def knn_graph(spark, sf_dir):
    return knn(spark, sf_dir)


@query(f"""
    WITH RECURSIVE k AS ({KNN_SQL}), e AS (SELECT id AS a, match AS b FROM k UNION SELECT match, id FROM k),
    r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node
""", name="connected_components")
def components(spark, sf_dir):
    return connected_components(knn(spark, sf_dir).select(F.col("id").alias("a"), F.col("match").alias("b")))


@query("""
    WITH RECURSIVE c(id, cur, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT id, cur // 2, steps + 1 FROM c WHERE cur > 0)
    SELECT id, 0::BIGINT AS final, CAST(max(steps) AS BIGINT) AS steps, false AS cyclic FROM c GROUP BY id
""")
def successor_chain(spark, sf_dir):
    key = F.col("p_partkey")
    return tr.successor_chain(table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 0, F.floor(key / 2)).alias("successor")))


@query("""
    WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 5 = 0 THEN ((n_nationkey + 5) % 25)::BIGINT ELSE (n_nationkey - 1)::BIGINT END AS parent FROM nation),
    w(id, cur, steps) AS (SELECT id, id, 0 FROM n UNION ALL SELECT w.id, n.parent, steps + 1 FROM w JOIN n ON n.id = w.cur WHERE steps < 64)
    SELECT id, max(steps) >= 64 AS cyclic FROM w GROUP BY id
""")
def parent_cycle(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    own = table(spark, sf_dir, "nation").select(key.alias("id"), F.when(key % 5 == 0, (key + 5) % 25).otherwise(key - 1).alias("successor"))
    return tr.successor_chain(own).select("id", "cyclic")


#: Parts as a tree of eight children a node, in which parts 3, 4 and 5 import each other in a ring.
_IMPORTS_SQL = "SELECT p_partkey::BIGINT AS src, (p_partkey // 8)::BIGINT AS dst FROM part WHERE p_partkey >= 8 UNION ALL SELECT p_partkey, CASE p_partkey WHEN 5 THEN 3 ELSE p_partkey + 1 END FROM part WHERE p_partkey BETWEEN 3 AND 5"


def _imports(spark, sf_dir):
    key = F.col("p_partkey").cast("long")
    part = table(spark, sf_dir, "part")
    tree = part.filter("p_partkey >= 8").select(key.alias("src"), F.floor(key / 8).alias("dst"))
    return tree.union(part.filter("p_partkey between 3 and 5").select(key, F.when(key == 5, 3).otherwise(key + 1)))


@query(f"""
    WITH RECURSIVE i AS ({_IMPORTS_SQL}),
    e AS (SELECT CASE WHEN src BETWEEN 3 AND 5 THEN 3 ELSE src END AS src, CASE WHEN dst BETWEEN 3 AND 5 THEN 3 ELSE dst END AS dst FROM i),
    d(id, depth) AS (SELECT dst, 0 FROM e UNION SELECT src, 0 FROM e UNION SELECT e.src, d.depth + 1 FROM d JOIN e ON e.dst = d.id WHERE e.src <> e.dst)
    SELECT n.id, max(depth) AS depth FROM (SELECT src AS id FROM i UNION SELECT dst FROM i) n JOIN d ON d.id = CASE WHEN n.id BETWEEN 3 AND 5 THEN 3 ELSE n.id END GROUP BY n.id
""")
def dependency_depth(spark, sf_dir):
    return tr.dependency_depth(_imports(spark, sf_dir))


@query(f"SELECT id, CASE WHEN id BETWEEN 3 AND 5 THEN 3 ELSE id END AS part FROM (SELECT src AS id FROM ({_IMPORTS_SQL}) UNION SELECT dst FROM ({_IMPORTS_SQL}))")
def strong_components(spark, sf_dir):
    return tr.strong_components(_imports(spark, sf_dir))


@query("""
    WITH d AS (SELECT p_partkey AS id, floor(log10(p_partkey + 0.5))::INTEGER AS depth FROM part WHERE p_partkey > 0)
    SELECT id, depth, least(depth * 4 // (SELECT max(depth) + 1 FROM d), 3)::INTEGER AS band FROM d
""")
def depth_bands(spark, sf_dir):
    digits = table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("id"), (F.length(F.col("p_partkey").cast("string")) - 1).alias("depth"))
    return tr.depth_bands(digits)


_ROUNDS = 10
_LABELS_SQL = f"WITH e AS MATERIALIZED (SELECT id AS a, match AS b FROM ({KNN_SQL}) UNION SELECT match, id FROM ({KNN_SQL})), l0 AS (SELECT DISTINCT a AS node, a AS label FROM e)" + "".join(
    f", l{k} AS MATERIALIZED (SELECT node, first(label ORDER BY n DESC, label) AS label FROM (SELECT a AS node, label, count(*) AS n FROM e JOIN l{k - 1} ON node = b GROUP BY ALL) GROUP BY node)" for k in range(1, _ROUNDS + 1)
)


@query(f"{_LABELS_SQL} SELECT node, label FROM l{_ROUNDS}")
def label_propagation(spark, sf_dir):
    return tr.label_propagation(knn(spark, sf_dir).select(F.col("id").alias("a"), F.col("match").alias("b")), _ROUNDS)


@query()
def label_propagation_exact(spark, sf_dir):
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    links = knn(spark, sf_dir).join(labels, "id").select("label", F.col("id").alias("a"), F.col("match").alias("b"))
    return tr.label_propagation_exact(links.withColumnRenamed("label", "grp"), "grp")


@query(f"""
    WITH m AS (SELECT DISTINCT l_suppkey % 20 AS grp, l_partkey AS member FROM lineitem), s AS (SELECT grp, count(*) AS n FROM m GROUP BY grp)
    SELECT a, b, k, round(k / (x.n + y.n - k), 4) AS jaccard FROM (SELECT p.grp AS a, q.grp AS b, count(*) AS k FROM m p JOIN m q ON p.member = q.member AND p.grp < q.grp GROUP BY ALL)
    JOIN s x ON x.grp = a JOIN s y ON y.grp = b WHERE k / (x.n + y.n - k) >= 0.05
""")
def jaccard_members(spark, sf_dir):
    return overlapping_groups(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("grp"), F.col("l_partkey").alias("member")), 0.05)


@query("""
    WITH c AS (SELECT l_suppkey AS grp, l_returnflag AS part, count(*) AS k FROM lineitem GROUP BY ALL),
    t AS (SELECT grp, CAST(sum(k) AS BIGINT) AS n, max(k) AS most, first(part ORDER BY k DESC, part) AS part FROM c GROUP BY grp)
    SELECT grp, part, n, round(most / n, 4) AS share FROM t WHERE n >= 3 AND most / n > 0.36
""")
def dominance_ratio(spark, sf_dir):
    return dominance(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("part")), 3, 0.36)


@query("""
    WITH c AS (SELECT n_name AS component, c_mktsegment AS folder, count(*) AS files FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment)
    SELECT *, round(files / sum(files) OVER (PARTITION BY component), 4) AS share FROM c
""")
def footprint_counts(spark, sf_dir):
    from pyspark.sql import Window

    joined = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy(F.col("n_name").alias("component"), F.col("c_mktsegment").alias("folder")).agg(F.count("*").alias("files"))
    return counts.withColumn("share", F.round(F.col("files") / F.sum("files").over(Window.partitionBy("component")), 4))


@query("""
    WITH f AS (SELECT p_brand AS area, count(*) AS files_total FROM part GROUP BY p_brand),
    s AS (SELECT p_brand AS area, count(DISTINCT p_partkey) AS files_in_scope FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_orderkey < 50 GROUP BY p_brand)
    SELECT area, coalesce(files_in_scope, 0) AS files_in_scope, files_total, CAST(row_number() OVER (ORDER BY coalesce(files_in_scope, 0) DESC, area) AS INTEGER) AS rank
    FROM f LEFT JOIN s USING (area) ORDER BY rank LIMIT 8
""")
def area_map(spark, sf_dir):
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    total = part.groupBy(F.col("p_brand").alias("area")).agg(F.count("*").alias("files_total"))
    used = table(spark, sf_dir, "lineitem").filter("l_orderkey < 50").select(F.col("l_partkey").alias("p_partkey"))
    scope = part.join(used, "p_partkey", "left_semi").groupBy(F.col("p_brand").alias("area")).agg(F.count_distinct("p_partkey").alias("files_in_scope"))
    top = total.join(scope, "area", "left").select("area", F.coalesce("files_in_scope", F.lit(0).cast("long")).alias("files_in_scope"), "files_total").orderBy(F.desc("files_in_scope"), "area").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("files_in_scope"), "area")))


@query(f"""
    WITH r AS (SELECT a.vec_id AS i, list_cosine_similarity(a.v, b.v) AS c FROM ({VECTORS_SQL}) a, ({VECTORS_SQL}) b WHERE b.vec_id IN (3, 11))
    SELECT i AS vec_id, round(max(c), 4) AS similarity FROM r GROUP BY i ORDER BY max(c) DESC, i LIMIT 20
""")
def cosine_multi_query_max(spark, sf_dir):
    own = vectors(spark, sf_dir)
    asked = [r["vector"] for r in own.filter(F.col("vec_id").isin(3, 11)).orderBy("vec_id").select("vector").collect()]
    best = F.greatest(*(vx.cosine(F.col("vector"), vx.literal(q)) for q in asked))
    return own.select("vec_id", best.alias("c")).orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 4).alias("similarity"))


@query(f"""
    SELECT vec_id, round(list_inner_product(v, (SELECT v FROM ({VECTORS_SQL}) WHERE vec_id = 3)), 4) AS similarity
    FROM ({VECTORS_SQL}) ORDER BY list_inner_product(v, (SELECT v FROM ({VECTORS_SQL}) WHERE vec_id = 3)) DESC, vec_id LIMIT 10
""")
def cosine_topk(spark, sf_dir):
    own = vectors(spark, sf_dir)
    asked = own.filter("vec_id = 3").select("vector").first()["vector"]
    return own.select("vec_id", vx.dot(F.col("vector"), vx.literal(asked)).alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 4).alias("similarity"))


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, a.label, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
    FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.40
""")
def dup_vector_pairs(spark, sf_dir):
    return sim.vector_pairs(vectors(spark, sf_dir), 0.40, key="label", id_col="vec_id")


@query(f"""
    SELECT a.vec_id AS a, b.vec_id AS b, a.label, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
    FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.30 AND list_cosine_similarity(a.v, b.v) < 0.40
""")
def relation_band(spark, sf_dir):
    return sim.vector_pairs(vectors(spark, sf_dir), 0.30, 0.40, key="label", id_col="vec_id")


@query(f"""
    WITH v AS (SELECT vec_id, label, v, label % 3 AS family FROM ({VECTORS_SQL}))
    SELECT a.vec_id AS a, b.vec_id AS b, a.label AS type_a, b.label AS type_b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
    FROM v a JOIN v b ON a.family = b.family AND a.label <> b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.36
""")
def cross_type_dup(spark, sf_dir):
    groups = spark.range(10).select(F.col("id").cast("int").alias("type"), (F.col("id") % 3).cast("int").alias("family"))
    return sim.cross_type_pairs(vectors(spark, sf_dir).withColumnRenamed("label", "type"), groups, 0.36, "vec_id")


@query(f"""
    SELECT id, match, round(c, 4) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
        SELECT a.vec_id AS id, b.vec_id AS match, list_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank
        FROM ({VECTORS_SQL}) a JOIN ({VECTORS_SQL}) b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_cosine_similarity(a.v, b.v) >= 0.30
    ) WHERE rank <= 5
""")
def binding_topn(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "vector")
    return sim.top_matches(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), "label", 0.30, 5)


#: The SQL's pairs: those of a table of 500 rows with ids from 0 on, as sf0.001 and sf0.01 have. The query draws over the rows present.
_PAIRS = sim.sampled_pairs(500)


@query(f"""
    WITH p(a, b) AS (VALUES {", ".join(f"({a}, {b})" for a, b in _PAIRS)}),
    c AS (SELECT list_sort(list(round(list_cosine_similarity(x.v, y.v), 6))) AS v FROM p JOIN ({VECTORS_SQL}) x ON x.vec_id = a JOIN ({VECTORS_SQL}) y ON y.vec_id = b)
    SELECT v[1 + least(len(v) - 1, floor(len(v) * 0.5)::INT)] AS median_cosine, v[1 + least(len(v) - 1, floor(len(v) * 0.9)::INT)] AS p90_cosine, len(v)::BIGINT AS n FROM c
""")
def noise_baseline(spark, sf_dir):
    return sim.noise_baseline(vectors(spark, sf_dir))
