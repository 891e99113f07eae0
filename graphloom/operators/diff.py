"""Snapshot diffs, three-way merges and their conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .similarity import between

POLICY_EDGES = ("sets_policy_for", "constrains", "supersedes", "refines", "has_premise")


def diff(base: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """(key, change, before, after, properties): added, removed or modified rows.

    before and after are structs of all columns; properties are the names of
    those that differ, nulls being equal to nulls.
    """
    names = [c for c in base.columns if c != key]
    a = base.select(key, F.struct(*names).alias("before"))
    b = current.select(key, F.struct(*names).alias("after"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in names)))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    joined = a.join(b, key, "full_outer").select(key, kind.alias("change"), "before", "after", F.when(kind == "modified", changed).otherwise(F.array().cast("array<string>")).alias("properties"))
    return joined.filter("change <> 'modified' or size(properties) > 0")


def property_diff(changes: DataFrame, key: str = "id") -> DataFrame:
    """(key, property, before, after) as strings, for modified rows."""
    names = [f.name for f in changes.schema["before"].dataType.fields]
    rows = changes.filter("change = 'modified'").select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(f"before.{c}").cast("string").alias("before"), F.col(f"after.{c}").cast("string").alias("after")) for c in names))).alias("p"), "properties")
    return rows.filter(F.array_contains("properties", F.col("p.property"))).select(key, "p.property", "p.before", "p.after")


def summarize(changes: DataFrame, kind: str) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "change", "n")


def co_modified(branch: DataFrame, main: DataFrame, key: str = "id") -> DataFrame:
    """Rows that both sides modified: semantic if they share a property, else mechanical."""
    a = branch.filter("change = 'modified'").select(key, F.col("properties").alias("pa"))
    b = main.filter("change = 'modified'").select(key, F.col("properties").alias("pb"))
    shared = F.array_intersect("pa", "pb")
    return a.join(b, key).select(F.lit("node_co_modified").alias("signal"), F.col(key).alias("subject"), F.when(F.size(shared) > 0, "semantic").otherwise("mechanical").alias("class"), F.array_join(F.array_sort(shared), ",").alias("detail"))


def edge_target_co_added(branch_edges: DataFrame, main_edges: DataFrame, types: tuple[str, ...] = POLICY_EDGES) -> DataFrame:
    """Targets to which both sides added edges of one policy type: (signal, subject, class, detail)."""

    def side(edges, name):
        return edges.filter(F.col("type").isin(*types)).groupBy("type", "dst").agg(F.count("*").alias(name))

    both = side(branch_edges, "na").join(side(main_edges, "nb"), ["type", "dst"])
    return both.select(F.lit("edge_target_co_added").alias("signal"), F.col("dst").alias("subject"), F.lit("mechanical").alias("class"), F.concat_ws(":", "type", "na", "nb").alias("detail"))


def decisions_without_lineage(added_nodes: DataFrame, added_edges: DataFrame) -> DataFrame:
    """Added Decisions from which no added supersedes or refines edge leads."""
    heirs = added_edges.filter(F.col("type").isin("supersedes", "refines")).select(F.col("src").alias("id"))
    return added_nodes.filter("type = 'Decision'").join(heirs, "id", "left_anti").select(F.lit("decision_without_lineage").alias("signal"), F.col("id").alias("subject"), F.lit("semantic").alias("class"), F.lit("").alias("detail"))


def similar_decisions(branch: DataFrame, main: DataFrame, least: float = 0.82, key: str = "type") -> DataFrame:
    """Added on the two sides with cosine ``least`` or more: (a, b, similarity to 6 places)."""
    a = branch.select(F.col("id").alias("a"), key, vx.unit(F.col("vector")).alias("va"))
    b = main.select(F.col("id").alias("b"), key, vx.unit(F.col("vector")).alias("vb"))
    pairs = between(a, b, key, "a", "b").filter("a <> b").withColumn("c", vx.dot(F.col("va"), F.col("vb"))).filter(F.col("c") >= least)
    return pairs.select("a", "b", F.round("c", 6).alias("similarity"))


def lost_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What either side has that the other lacks, as often as it lacks it: columns plus side. One shuffle of both."""
    names = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(actual.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("extra")
    return left.select(*names, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))


def recall_loss(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query, id) found before and not after."""
    return before.select("query", "id").join(after.select("query", "id"), ["query", "id"], "left_anti")
