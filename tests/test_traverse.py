"""Chains and depths of any length against plain Python."""

import random

import pytest

from graphloom.operators import traverse


def follow(successor):
    out = {}
    for node in successor:
        seen, at, steps = {node}, node, 0
        while successor.get(at) is not None:
            at, steps = successor[at], steps + 1
            if at in seen:
                at = steps = None
                break
            seen.add(at)
        out[node] = (at, steps, at is None)
    return out


def chains(spark, successor):
    rows = spark.createDataFrame(list(successor.items()), "id long, successor long")
    return {r.id: (r.final, r.steps, r.cyclic) for r in traverse.successor_chain(rows).collect()}


def test_long_chain_and_cycles(spark):
    successor = {k: k + 1 for k in range(10_000)}  # 10,000 is not listed
    successor |= {20_000 + k: 20_000 + (k + 1) % 777 for k in range(777)}  # a cycle of odd length
    successor |= {30_000 + k: 30_000 + k + 1 for k in range(500)} | {30_500: 20_005}  # a way into it
    successor |= {40_000: 40_000, 40_001: None, 40_002: 40_001, 40_003: 40_004, 40_004: 40_003}
    found = chains(spark, successor)
    assert found[0] == (10_000, 10_000, False) and found[40_001] == (40_001, 0, False) and found[40_000] == (None, None, True)
    assert all(found[k] == (10_000, 10_000 - k, False) for k in range(10_000))
    assert all(v == (None, None, True) for k, v in found.items() if 20_000 <= k < 40_000)


@pytest.mark.parametrize("seed", range(2))
def test_random_chains(spark, seed):
    rnd = random.Random(seed)
    successor = {k: rnd.choice([None, rnd.randrange(80), rnd.randrange(60), min(k + 1, 90)]) for k in range(60)}
    assert chains(spark, successor) == follow(successor)


def test_no_rows(spark):
    assert chains(spark, {}) == {}


def depth_of(links):
    """Depths by plain recursion over the graph whose cycles are one node each."""
    out, nodes = {}, {x for link in links for x in link}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    reach = {}
    for x in nodes:
        seen, todo = {x}, [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[x] = seen
    part = {x: min(y for y in nodes if y in reach[x] and x in reach[y]) for x in nodes}
    below = {}
    for a, b in links:
        if part[a] != part[b]:
            below.setdefault(part[a], set()).add(part[b])
    depth = {}
    for p in sorted(set(part.values()), key=lambda p: len({part[y] for y in reach[p]})):
        depth[p] = max((depth[q] + 1 for q in below.get(p, ())), default=0)
    return {x: depth[part[x]] for x in nodes}


def depths(spark, links):
    return {r.id: r.depth for r in traverse.dependency_depth(spark.createDataFrame(links, "src long, dst long")).collect()}


def test_deep_paths(spark):
    links = [(k, k + 1) for k in range(5000)] + [(k, k + 3) for k in range(0, 4000, 400)] + [(9000, 0), (9000, 4999), (9001, 2500), (9001, 9002)]
    found = depths(spark, links)
    assert found[0] == 5000 and found[9000] == 5001 and found[9001] == 2501 and found[9002] == 0 and found[5000] == 0
    assert all(found[k] == 5000 - k for k in range(5001))


def test_ladder_of_diamonds(spark):
    links = [x for k in range(0, 90, 3) for x in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))]
    assert depths(spark, links)[0] == 60


@pytest.mark.parametrize("seed", range(1))
def test_random_graphs_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(5, 40)
    links = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(n, 2 * n))} | {(100 + k, 101 + k) for k in range(9)} | {(109, 0), (1, 200), (200, 201)}
    assert depths(spark, sorted(links)) == depth_of(links)


def test_a_path_into_a_cycle(spark):
    links = [(k, k + 1) for k in range(60)] + [(60, 40), (50, 500), (500, 501)]
    assert depths(spark, links) == depth_of(set(links))


def test_every_seed_has_its_own_visits_and_caps(spark):
    """Each seed's edges are those of a traversal from it alone, on a random graph with a hub."""
    rnd = random.Random(9)
    kinds = ("supersedes", "refines", "discussed_in", "other")
    rows = [(f"e{i}", rnd.choice(kinds), "hub" if rnd.random() < 0.3 else f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for i in range(70)]
    edges = spark.createDataFrame(rows, "id string, type string, src string, dst string")
    seeds = ["hub", "n0", "n5", "nobody"]
    together = traverse.neighbors_of_each(edges, spark.createDataFrame([(s,) for s in [*seeds, "n0", None]], "id string"), 3, 3, 10).collect()
    for seed in seeds:
        alone = traverse.neighbors_capped(edges, spark.createDataFrame([(seed,)], "id string"), 3, 3, 10).collect()
        assert {(r.id, r.type, r.src, r.dst, r.depth) for r in together if r.seed == seed} == {tuple(r) for r in alone}
    assert len(together) > 20 and {r.seed for r in together} == set(seeds) - {"nobody"}
