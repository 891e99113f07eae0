"""The pruned vector join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import vectors as vx
from graphloom.operators import similarity, vector_join


def grouped(seed, groups, rows, size=16, spread=0.08):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(groups, size))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    return [(f"n{k:04d}", f"t{k % 3}", (centers[rnd.integers(groups)] + spread * rnd.normal(size=size)).tolist()) for k in range(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, vector array<double>")


def brute(rows, least):
    out = set()
    for k, (a, t, v) in enumerate(rows):
        for b, u, w in rows[:k]:
            if t == u and len(v) == len(w) and np.linalg.norm(v) * np.linalg.norm(w) > 0:
                c = np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))
                if c >= least:
                    out.add((min(a, b), max(a, b), t, round(float(c), 4)))
    return out


@pytest.mark.parametrize(("seed", "groups", "spread"), [(1, 12, 0.08), (2, 400, 2.0)])
def test_pairs_are_exact(spark, seed, groups, spread, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL", 7)
    rows = [*grouped(seed, groups, 240, spread=spread), ("zero", "t0", [0.0] * 16), ("short", "t0", [1.0, 0.0]), ("copy", "t1", grouped(seed, groups, 240, spread=spread)[1][2])]
    own = table(spark, rows)
    vectors = own.select(F.col("id").alias("a"), "type", vx.unit(F.col("vector")).alias("v"))
    for least in (0.5, 0.9):
        pivots = vector_join.useful_pivots(vectors, "a", least)
        found = {(r.a, r.b, r.type, r.similarity) for r in similarity.vector_pairs(own.filter("id <> 'short'"), least).collect()}
        assert found == brute(rows[:-2] + rows[-1:], least)
    assert (pivots is not None) == (groups == 12)


def test_every_cell_bound_holds(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "CELL", 5)
    rows = [*grouped(5, 6, 150), ("zero", "t0", [0.0] * 16), ("short", "t0", [1.0, 0.0]), ("short2", "t0", [1.0, 0.1])]
    own = table(spark, rows).select(F.col("id").alias("a"), F.col("type").alias("key"), vx.unit(F.col("vector")).alias("v"))
    pivots = vector_join.useful_pivots(own, "a", 0.8)
    found = {(min(r.a1, r.a2), max(r.a1, r.a2)) for r in vector_join.pairs_within(own, "key", 0.8, pivots).collect()}
    want = {(a, b) for a, b, _, _ in brute(rows, 0.8)}
    assert want <= found and ("short", "short2") in found
    assert found - want <= {x for x in found if "short" in x[0] or "short" in x[1]}


def test_few_pairs_meet(spark):
    own = table(spark, grouped(7, 40, 1200)).select(F.col("id").alias("a"), F.col("type").alias("key"), vx.unit(F.col("vector")).alias("v"))
    pivots = vector_join.useful_pivots(own, "a", 0.9)
    for r in vector_join.evaluated_pairs(own, "key", 0.9, pivots).collect():
        assert r.met < 0.4 * r.possible


def test_best_matches_between_tables(spark):
    rows = grouped(9, 10, 200)
    own = table(spark, rows)
    left, right = own.filter("id < 'n0060'"), own.filter("id >= 'n0040'")
    found = {(r.id, r.match, r.similarity, r.rank) for r in similarity.top_matches(left, right, "type", 0.7, 3).collect()}
    want = set()
    for a, t, v in rows[:60]:
        near = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), b) for b, u, w in rows[40:] if u == t and b != a]
        for rank, (c, b) in enumerate(sorted(x for x in near if -x[0] >= 0.7)[:3], 1):
            want.add((a, b, round(-c, 4), rank))
    assert found == want


def test_no_rows(spark):
    assert similarity.vector_pairs(table(spark, []), 0.5).collect() == []
    assert similarity.vector_pairs(table(spark, [("a", "t", [0.0, 0.0]), ("b", "t", [0.0, 0.0])]), 0.5).collect() == []
