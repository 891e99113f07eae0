"""What the vector joins sum in a task."""

import numpy as np
import pyarrow as pa

from graphloom.operators import vector_join


def column(vectors):
    return pa.chunked_array([pa.array(vectors, pa.list_(pa.float64()))])


def crowded(seed=5, n=300, copies=200):
    """Vectors of which many are copies of one, and as many nearly so."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.normal(size=(n, 12))
    vectors[50 : 50 + copies // 2] = vectors[0]
    vectors[150 : 150 + copies // 2] = vectors[0] + 0.01 * rnd.normal(size=(copies // 2, 12))
    return vectors


def best(pairs, top):
    """The cosines of the ``top`` most similar ones of each i."""
    out = {}
    for i, _, c in sorted(pairs, key=lambda x: -x[2]):
        out.setdefault(i, []).append(c)
    return {i: cs[:top] for i, cs in out.items()}


def test_only_pairs_that_may_be_best_are_summed(monkeypatch):
    vectors, summed = crowded(), []
    plain = vector_join._summed
    monkeypatch.setattr(vector_join, "_summed", lambda a, b, i, j: summed.append(len(i)) or plain(a, b, i, j))
    given = lambda *more: [x for i, j, c in vector_join._cosines(column(vectors.tolist()), column(vectors.tolist()), 0.3, *more) for x in zip(i.tolist(), j.tolist(), c.tolist(), strict=True)]
    every = [x for x in given() if x[0] != x[1]]
    whole = sum(summed)
    summed.clear()
    some = given(lambda i, j: i != j, 4)
    assert best(some, 4) == best(every, 4) and set(some) <= set(every)
    assert sum(summed) < whole / 2


def test_the_best_of_what_is_no_number():
    vectors = [[1.0, 0.0], [float("nan"), 1.0], [1.0, 0.1], [float("inf"), 1.0], [1.0, 0.2], [1.0, 0.3]]
    found = [(i, j) for x in vector_join._cosines(column(vectors), column(vectors), 0.5, lambda i, j: i != j, 2) for i, j in zip(x[0].tolist(), x[1].tolist(), strict=True)]
    assert {j for i, j in found if i == 0} == {1, 2, 3, 4} and {j for i, j in found if i == 1} == {0, 2, 3, 4, 5}
