"""Vector joins by matrices: cosines as SQL sums them, blocks that meet, and what a task gives."""

import math

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import similarity, vector_join


def cosine(a, b):
    """Added up in the order of the dimensions, as SQL's list_cosine_similarity (sum() would mend rounding)."""
    dot = one = two = 0.0
    for x, y in zip(a, b, strict=True):
        dot, one, two = dot + x * y, one + x * x, two + y * y
    return dot / math.sqrt(one * two)


def rows(seed, n, size=12):
    rnd = np.random.default_rng(seed)
    return [(k, k % 2, (rnd.normal(size=size) * rnd.uniform(0.5, 20)).tolist()) for k in range(n)]


def table(spark, own):
    return spark.createDataFrame(own, "vec_id long, label int, vector array<double>")


def test_cosines_are_those_of_sql_to_the_last_bit(spark):
    own = rows(1, 150)
    met = table(spark, own).select(F.col("vec_id").alias("a"), "label", F.col("vector").alias("v"))
    found = {(min(r.a1, r.a2), max(r.a1, r.a2)): r.cosine for r in similarity.within(met, "label", 0.1).collect()}
    want = {(a, b): c for a, t, v in own for b, u, w in own if a < b and t == u and (c := cosine(v, w)) >= 0.1}
    assert found == want


def test_a_band_of_many_rows(spark):
    """12,000 rows of a key: 72 million pairs."""
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(12000, 24))
    found = similarity.vector_pairs(table(spark, [(k, 0, v) for k, v in enumerate(vectors.tolist())]), 0.7, 0.8, key="label", id_col="vec_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    n = sum(int(np.triu((c >= 0.7) & (c < 0.8), 1 + k).sum()) for k in range(0, 12000, 1000) for c in [unit[k : k + 1000] @ unit.T])
    assert found.count() == n > 1000


def test_types_of_a_family_that_meet_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    own = rows(3, 160)
    groups = spark.createDataFrame([(0, 0), (1, 0)], "type int, family int")
    found = similarity.cross_type_pairs(table(spark, own).withColumnRenamed("label", "type"), groups, 0.3, "vec_id")
    want = {(a, b, t, u, round(c, 4)) for a, t, v in own for b, u, w in own if a < b and t != u and (c := cosine(v, w)) >= 0.3}
    assert {tuple(r) for r in found.collect()} == want
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()


def test_odd_vectors(spark):
    """Vectors with a null, or null, match nothing; a zero vector's cosine is 0; another length is compared as far as both go."""
    own = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, None]), (3, 0, None), (4, 0, [0.0, 0.0]), (5, 0, [2.0, 0.0]), (6, 0, [3.0]), (7, None, [1.0, 0.0]), (8, 0, [])]
    found = lambda least: {(r.a, r.b) for r in similarity.vector_pairs(table(spark, own), least, key="label", id_col="vec_id").collect()}
    assert found(0.5) == {(1, 5), (1, 6), (5, 6)}
    assert (1, 4) in found(0.0) and (1, 4) not in found(0.1)


def test_a_task_gives_no_more_than_the_best(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 32)
    own = rows(4, 100)
    own += [(k + 100, t, v) for k, t, v in own]  # copies, whose cosines are equal wherever they meet
    sides = [table(spark, own).select(F.col("vec_id").alias(name), "label", F.col("vector").alias("v")) for name in ("id", "match")]
    blocks = -(-len(own) // 2 // 32)
    assert similarity.between_alike(*sides, "label", "id", "match", 0.1, 2).count() <= len(own) * blocks * 2
    found = similarity.top_matches(*[table(spark, own).withColumnRenamed("vec_id", "id")] * 2, "label", 0.1, 4)
    want = set()
    for a, t, v in own:
        near = sorted((-min(c, 1.0), b) for b, u, w in own if a != b and t == u and (c := cosine(v, w)) >= 0.1)
        want |= {(a, b, round(-c, 4), k) for k, (c, b) in enumerate(near[:4], 1)}
    assert {tuple(r) for r in found.collect()} == want
