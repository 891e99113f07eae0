"""How vectors are dealt into blocks, and limits that 32 bits don't tell."""

from pyspark.sql import functions as F

from graphloom.operators import similarity

from .test_matrix_joins import cosine, rows, table


def test_limits_that_cosines_reach_exactly(spark):
    own = [(k, 0, v) for k, _, v in rows(6, 60)]
    limits = sorted({cosine(v, w) for k, (_, _, v) in enumerate(own) for _, _, w in own[:k]})[-40::8]
    for least in limits:
        found = {(r.a, r.b) for r in similarity.vector_pairs(table(spark, own), least, key="label", id_col="vec_id").collect()}
        assert found == {(a, b) for a, _, v in own for b, _, w in own if a < b and cosine(v, w) >= least}


def test_narrow_rows_fill_few_blocks(spark, monkeypatch):
    own = spark.range(9000).select(F.col("id").alias("a"), F.lit(0).alias("key"), F.array(F.lit(1.0), F.rand(1)).alias("v"))
    blocks = lambda: similarity._blocks(own, "key", "a", "b").agg(F.max("b_all")).first()[0]
    assert blocks() == 3
    monkeypatch.setattr(similarity, "NUMBERS", 2000)
    assert blocks() == 9
