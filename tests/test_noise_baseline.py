import math
import random

import pytest

from graphloom.operators import similarity as sim
from graphloom.plans import queries_graph


@pytest.mark.parametrize("n", [0, 1, 2, 1200])
def test_pairs_of_all_rows(spark, monkeypatch, n):
    """Ids with gaps, none below 500; rows without a vector are not numbered."""
    rnd = random.Random(3)
    rows = [(7000 + 3 * i, [rnd.gauss(i / n, 1) for _ in range(6)]) for i in range(n)]
    table = spark.createDataFrame([*rows, (1, None), (2, [])], "vec_id long, vector array<double>").repartition(5)
    monkeypatch.setattr(queries_graph, "vectors", lambda spark, sf_dir: table)
    found = queries_graph.noise_baseline(spark, "").first()

    def cosine(x, y):
        return sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)

    want = sorted(cosine(rows[a][1], rows[b][1]) for a, b in sim.sampled_pairs(n))
    assert found.n == len(want)
    if want:
        at = [want[min(len(want) - 1, math.floor(len(want) * q))] for q in (0.5, 0.9)]
        assert [found.median_cosine, found.p90_cosine] == pytest.approx(at, abs=1e-6)


def test_sample_reaches_large_tables():
    n = 1 << 27
    assert max(max(p) for p in sim.sampled_pairs(n)) > n // 2
