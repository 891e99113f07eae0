"""Every registered query of the library against its SQL in DuckDB."""

import math
import os

import pytest

from graphloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(theirs.columns, theirs.fetchall())


def test_what_has_no_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"label_propagation_exact"}


def test_label_propagation_exact_equals_plain_python(spark):
    """One pass after another over sorted nodes, each taking the label most of its neighbours have now."""
    from pyspark.sql import functions as F

    from graphloom.plans import queries_graph

    near = {}
    labels = {r.vec_id: r.label for r in queries_graph.vectors(spark, SF).select("vec_id", "label").collect()}
    for r in queries_graph.knn(spark, SF).select("id", "match").collect():
        near.setdefault(r.id, set()).add(r.match)
        near.setdefault(r.match, set()).add(r.id)
    want = {}
    for grp in {labels[x] for x in near}:
        own = sorted(x for x in near if labels[x] == grp)
        size = [len(near[x]) for x in own]
        mean = sum(size) / len(size)
        cut = max(mean + 2 * (sum((d - mean) ** 2 for d in size) / len(size)) ** 0.5, 0.12 * len(own)) if len(own) >= 25 else float("inf")
        voters = [x for x in own if len(near[x]) <= cut]
        state = {x: x for x in own}
        for _ in range(30):
            before = dict(state)
            for x in voters:
                seen = [state[y] for y in near[x] if y in set(voters)]
                if seen:
                    state[x] = min(set(seen), key=lambda v: (-seen.count(v), v))
            if state == before:
                break
        want |= state
    found = catalogue.QUERIES["label_propagation_exact"](spark, SF).select(F.col("node"), F.col("label")).collect()
    assert len(want) > 50 and {r.node: r.label for r in found} == want
