"""Graphs of nearest vectors whose key fills many blocks."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import similarity, traverse
from graphloom.operators.components import connected_components


def links(spark, n=9000):
    """Clusters of three near vectors among ``n`` of one key: 40 million pairs."""
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(n // 3, 48))
    own = [(k, 0, (base[k // 3] + 0.02 * rnd.normal(size=48)).tolist()) for k in range(n)]
    rows = spark.createDataFrame(own, "id long, label int, vector array<double>")
    return similarity.top_matches(rows, rows, "label", 0.9, 4).select(F.col("id").alias("a"), F.col("match").alias("b"))


def test_components(spark):
    found = connected_components(links(spark)).collect()
    assert len(found) == 9000 and all(r.component == r.node - r.node % 3 for r in found)


def test_labels(spark):
    found = traverse.label_propagation(links(spark), 10).collect()
    assert len(found) == 9000 and all(r.label // 3 == r.node // 3 for r in found)


def test_labels_in_order(spark):
    found = traverse.label_propagation_exact(links(spark).withColumn("grp", F.lit(0)), "grp").collect()
    assert len(found) == 9000 and all(r.label // 3 == r.node // 3 for r in found)


def crowded(spark, n=6000):
    """Rows of one key of which every third is a copy of one vector, and another third nearly so."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(n, 48))
    base[::3] = base[0]
    base[1::3] = base[1] + 0.001 * rnd.normal(size=(len(base[1::3]), 48))
    return spark.createDataFrame([(k, 0, v) for k, v in enumerate(base.tolist())], "id long, label int, vector array<double>")


def sent(rows):
    """How often each row goes to a task for its best matches."""
    own = rows.select("id", "label", F.col("vector").alias("v"))
    return similarity._dealt(own, own.withColumnRenamed("id", "match"), "label", "id", "match")[0].count() / own.count()


def near(spark):
    rows = crowded(spark)
    assert sent(rows) == 2
    return similarity.top_matches(rows, rows, "label", 0.9, 4).select(F.col("id").alias("a"), F.col("match").alias("b"))


def test_components_of_copies(spark):
    pairs = near(spark).collect()
    least = {x: x for p in pairs for x in p}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    found = connected_components(near(spark)).collect()
    assert {(r.node, r.component) for r in found} == {(x, root(x)) for x in least}
    assert len(found) == 4000 and all(r.component == 0 for r in found if r.node % 3 == 0)


def test_labels_of_copies(spark):
    around = {}
    for a, b in near(spark).collect():
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    label = {x: x for x in around}
    for _ in range(3):
        votes = {x: Counter(label[y] for y in ys) for x, ys in around.items()}
        label = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
    found = traverse.label_propagation(near(spark), 3).collect()
    assert {r.node: r.label for r in found} == label and len(found) == 4000


def test_labels_of_copies_in_order(spark):
    found = traverse.label_propagation_exact(near(spark).withColumn("grp", F.lit(0)), "grp").collect()
    assert len(found) == 4000 and all(r.label % 3 == r.node % 3 for r in found)
    # The copies' matches are hubs, which are left out of the votes.
    assert all(r.label == r.node for r in found if r.node % 3 == 0)
