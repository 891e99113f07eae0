"""What a round of components and of label propagation reads and moves."""

import random
from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators import components, traverse


def graph(n, m, seed):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def counted(spark, pairs):
    """Links that count how often one of them is computed."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(pairs, "a long, b long").mapInArrow(touch, "a long, b long"), seen


def test_a_round_has_no_join(spark):
    links = spark.createDataFrame(graph(30, 60, 1), "u long, v long")
    assert "Join" not in components._round(links)._jdf.queryExecution().optimizedPlan().toString()


def test_components_of_odd_links(spark):
    for seed in range(3):
        pairs = graph(90, 45, seed) + [(200, 200), (7, 7), (None, 3), (4, None), (5, 6), (6, 5), (5, 6)]
        links, seen = counted(spark, pairs)
        least = {x: x for p in pairs if None not in p for x in p}
        while any(least[a] != least[b] for a, b in pairs if None not in (a, b)):
            for a, b in pairs:
                if None not in (a, b):
                    least[a] = least[b] = min(least[a], least[b])
        assert sorted(components.connected_components(links).collect()) == sorted(least.items())
        assert seen.value == len(pairs)


def test_propagation_computes_links_once(spark):
    pairs = graph(80, 200, 5) + [(3, 3), (None, 1)]
    links, seen = counted(spark, pairs)
    around = {}
    for a, b in pairs:
        if a is not None and a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)
    for rounds in (0, 1, 5, 12):
        label = {x: x for x in around}
        for _ in range(rounds):
            votes = {x: Counter(label[y] for y in ys) for x, ys in around.items()}
            label = {x: min(v, key=lambda k: (-v[k], k)) for x, v in votes.items()}
        seen.value = 0
        assert dict(map(tuple, traverse.label_propagation(links, rounds).collect())) == label
        assert seen.value == len(pairs)


def in_order(pairs, rounds=30):
    """Every node votes in every round, in order."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    degrees, hubs = {x: len(v) for x, v in near.items()}, set()
    if len(near) >= 25:
        mean = sum(degrees.values()) / len(near)
        spread = (sum((d - mean) ** 2 for d in degrees.values()) / len(near)) ** 0.5
        hubs = {x for x, d in degrees.items() if d > max(mean + 2 * spread, 0.12 * len(near))}
    label = {x: x for x in near}
    for _ in range(rounds):
        for x in sorted(set(near) - hubs):
            votes = Counter(label[y] for y in near[x] - hubs)
            if votes:
                label[x] = min(votes, key=lambda v: (-votes[v], v))
    return label


def test_propagation_in_order_is_spread(spark):
    graphs = {k: graph(60, 110, k) + [(0, x) for x in range(20 * (k % 2))] for k in range(6)} | {9: [(4, 4)]}
    rows = [(k, f"n{a}", f"n{b}") for k, pairs in graphs.items() for a, b in pairs] + [(0, None, "n1"), (1, "n2", None)]
    links = spark.createDataFrame(rows, "grp int, a string, b string")
    for rounds in (2, 30):
        found = traverse.label_propagation_exact(links, "grp", rounds)
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        theirs = {(k, x): v for k, pairs in graphs.items() for x, v in in_order([(f"n{a}", f"n{b}") for a, b in pairs], rounds).items()}
        assert {(r.grp, r.node): r.label for r in found.collect()} == theirs


def test_propagation_in_order_of_nothing(spark):
    none = spark.createDataFrame([], "grp int, a long, b long")
    assert traverse.label_propagation_exact(none, "grp").count() == traverse.label_propagation(none).count() == components.connected_components(none).count() == 0
    assert traverse.label_propagation_exact(none.select(F.lit(1).alias("grp"), "a", "b"), "grp").count() == 0
