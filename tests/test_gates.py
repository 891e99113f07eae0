"""The duplicate gate where many share a name, and its vectors against SQL's rounding."""

import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import duplicates


def test_lexical_gate_is_the_gate_of_the_pairs(spark):
    draw = random.Random(3)
    own = [(f"x:{draw.randrange(3)}:{draw.randrange(60)}", draw.choice(["A", "B", None]), draw.choice(["Big box", "big BOX!", "Lamp", None, ""]), draw.choice([["lamp"], [], None, ["Rare", "big box"]]), draw.choice(["active", "superseded", None])) for _ in range(120)]
    table = spark.createDataFrame([*own, (None, "A", "Lamp", None, None)], "id string, type string, title string, aliases array<string>, state string")
    for asked, known in (("id like '%1'", "id like '%2'"), ("id is not null", "id like 'x:1:%'"), ("id is null", "true")):
        new, ack = table.filter(asked), table.filter(known).select("id")
        want = sorted(map(tuple, duplicates.gate(duplicates.lexical_suspects(new, table), None, ack).collect()))
        assert sorted(map(tuple, duplicates.lexical_gate(new, table, ack).collect())) == want


def test_a_name_of_many(spark):
    """50,000 holders of one name, all of them candidates: 2.5 billion pairs."""
    own = spark.range(50000).select(F.concat(F.lit("p:s:"), "id").alias("id"), F.lit("Part").alias("type"), F.lit("Box").alias("title"))
    found = duplicates.lexical_gate(own, own, own.filter("id <> 'p:s:7'"))
    assert {(r.status, r["count"]) for r in found.groupBy("status").count().collect()} == {("rejected", 49999), ("acked", 1)}


def test_vector_suspects_of_many(spark):
    """6,000 candidates against 6,000 nodes of one family, with the limits as plain sums have them."""
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=(2, 6000, 6))
    kinds = ["Decision", "OperationalKnowledge"]
    asked = spark.createDataFrame([(f"a:{k}", kinds[k % 2], v) for k, v in enumerate(a.tolist())], "id string, type string, vector array<double>")
    there = spark.createDataFrame([(f"b:{k}", kinds[k % 2], v) for k, v in enumerate(b.tolist())], "id string, type string, vector array<double>")
    found = duplicates.vector_suspects(asked, there.select("id", "type"), there.select(F.col("id").alias("node_id"), "vector"))
    counts = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    c = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    same = (np.arange(6000)[:, None] - np.arange(6000)) % 2 == 0
    assert counts == {"duplicate": (same & (c >= 0.92)).sum(), "cross-type": (~same & (c >= 0.92)).sum(), "related": (same & (c >= 0.8) & (c < 0.92)).sum()}
