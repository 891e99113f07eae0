import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.exact_dedup import cut_points, exact_duplicates
from graphloom.llm.minhash_dedup import near_duplicates

from .conftest import ODD, documents

UPPER = {i: i + 32 for i in range(65, 91)}


def test_exact_matches_brute_force(spark, corpus):
    rows = corpus + ODD
    groups = {}
    for i, x in rows:
        groups.setdefault((x or "").translate(UPPER), []).append(i)
    out = exact_duplicates(documents(spark, rows).repartition(3), bits=4, least=16, most=64)
    found = out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(found) == len(rows)
    best = {k: max((v for v in ids if v is not None), default=None) for k, ids in groups.items()}
    want = sorted((str(i), str(best[k]), len(ids), hashlib.sha256(k.encode()).hexdigest()) for k, ids in groups.items() for i in ids)
    assert sorted((str(r[0]), str(r[1]), r[2], r[4]) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_chunks_follow_content():
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 256, 200_000, dtype=np.uint8)
    b = np.concatenate([rnd.integers(0, 256, 777, dtype=np.uint8), a])
    ends_a, ends_b = cut_points(a, 8, 64, 4096), cut_points(b, 8, 64, 4096)
    assert ends_a[-1] == len(a) and ends_b[-1] == len(b)
    assert len({e + 777 for e in ends_a} & set(ends_b)) > 0.9 * len(ends_a)
    assert max(np.diff([0, *ends_a])) <= 4096
    assert cut_points(a[:0], 8, 64, 4096) == [0]


def brute_components(rows, width=5, percent=75):
    sets = []
    for _, x in rows:
        w = [y for y in re.split("[\x20\x09-\x0d]+", (x or "").translate(UPPER)) if y]
        n = min(len(w), width)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    part = list(range(len(rows)))

    def find(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                part[find(a)] = find(b)
    order = lambda i: -(1 << 63) if i is None else i
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 63), order(i))
    return sorted((order(i), len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), len(least)


def test_near_matches_brute_force(spark, corpus):
    rows = corpus + ODD
    found = near_duplicates(documents(spark, rows).repartition(3)).collect()
    want, parts = brute_components(rows)
    order = lambda i: -(1 << 63) if i is None else i
    assert sorted((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in found) == want
    assert sum(r.kept for r in found) == parts


def test_large_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        own = list(base)
        own[(i * 37) % 200] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = near_duplicates(documents(spark, rows)).agg(F.count_distinct("component_id"), F.count_if("kept")).first()
    assert tuple(found) == (1, 1)


def test_pairs_inside_a_template(spark):
    """Pages of one template, J 0.70 to each other, and 60 pairs of J 0.756 among them, each its own component."""
    rows = []
    for i in range(600):
        twin = i // 2 if i < 120 else 1000 + i
        rows.append((i, " ".join([*(f"t{k}" for k in range(164)), *(f"p{twin}_{k}" for k in range(7)), *(f"o{i}_{k}" for k in range(27))])))
    found = near_duplicates(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found)) == [(i, i // 2 * 2 if i < 120 else i) for i in range(600)]


def test_pairs_just_over_the_threshold_among_pages_just_under(spark):
    """400 pages, all pairs of J 0.733 but 200 planted ones of 0.765: exactly those are links."""
    rows = []
    for i in range(400):
        rows.append((i, " ".join([*(f"t{k}" for k in range(163)), *(f"p{i // 2}_{k}" for k in range(4)), *(f"o{i}_{k}" for k in range(25))])))
    want, parts = brute_components(rows[:40])
    assert parts == 20
    found = near_duplicates(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found)) == [(i, i // 2 * 2) for i in range(400)]


def test_empty_table(spark):
    empty = documents(spark, [])
    assert exact_duplicates(empty).count() == 0
    assert near_duplicates(empty).count() == 0
