"""The families of types are made by Spark, without a task in Python."""

from graphloom.plans import queries_graph

from .test_oracles import SF


def test_families_without_python_rows(spark):
    plan = queries_graph.cross_type_dup(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" in plan and "LogicalRDD" not in plan
