"""The duplicate gate of a change set: by name and by vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from .carving import with_columns
from .search import TERMINAL_STATES
from .similarity import between_alike

DUPLICATE, RELATED = 0.92, 0.80
# Types that can say the same.
FAMILIES = {"Decision": "rule", "OperationalKnowledge": "rule", "Risk": "limit", "Constraint": "limit"}


def system_of(node_id: Column) -> Column:
    return F.get(F.split(node_id, ":"), F.lit(1))


def normalized_names(nodes: DataFrame) -> DataFrame:
    """(id, type, system, name): titles and aliases, normalised, each once."""
    own = with_columns(nodes, title="string", aliases="array<string>")
    names = F.array_distinct(F.transform(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: normalize_text(x)))
    return own.select("id", "type", system_of(F.col("id")).alias("system"), F.explode(names).alias("name")).filter("name <> ''")


def lexical_suspects(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(candidate, existing, name): candidates that share a name with a living node of type and system."""
    living = with_columns(nodes, state="string").filter(F.coalesce(~F.col("state").isin(*TERMINAL_STATES), F.lit(True)))
    a = normalized_names(candidates).withColumnRenamed("id", "candidate")
    b = normalized_names(living).withColumnRenamed("id", "existing")
    return a.join(b, ["type", "system", "name"]).filter("candidate <> existing").groupBy("candidate", "existing").agg(F.min("name").alias("name"))


def vector_suspects(candidates: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(candidate, existing, similarity, kind): duplicate, cross-type or related by true cosine.

    ``candidates`` has (id, type, vector). Index rows without a node are left out.
    """
    family = F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair))
    rows = nodes.select("id", "type").join(vectors.select(F.col("node_id").alias("id"), "vector"), "id")
    side = lambda df, name: df.select(F.col("id").alias(name), F.col("type").alias(f"t_{name}"), F.coalesce(family[F.col("type")], "type").alias("family"), F.col("vector").alias("v"))
    pairs = between_alike(side(candidates, "candidate"), side(rows, "existing"), "family", "candidate", "existing", RELATED).filter("candidate <> existing").withColumnRenamed("cosine", "c")
    same = F.col("t_candidate") == F.col("t_existing")
    kind = F.when(same & (F.col("c") >= DUPLICATE), "duplicate").when(~same & (F.col("c") >= DUPLICATE), "cross-type").when(same & (F.col("c") >= RELATED), "related")
    return pairs.withColumn("kind", kind).filter("kind is not null").select("candidate", "existing", F.round("c", 4).alias("similarity"), "kind")


def lexical_gate(candidates: DataFrame, nodes: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """:func:`gate` of :func:`lexical_suspects` alone, from counts by name.

    Holders of a name are counted and never paired, so that a name that many
    share costs no more than others. A candidate among them doesn't count.
    """
    named = ["type", "system", "name"]
    living = with_columns(nodes, state="string").filter(F.coalesce(~F.col("state").isin(*TERMINAL_STATES), F.lit(True)))
    known = acknowledged.select("id").distinct().withColumn("ack", F.lit(True))
    held = normalized_names(living).filter("id is not null").distinct().join(known, "id", "left").withColumn("open", F.col("ack").isNull().cast("long")).drop("ack")
    counts = held.groupBy(*named).agg(F.count("*").alias("n"), F.sum("open").alias("k"))
    asked = normalized_names(candidates).distinct().filter("id is not null").join(counts, named)
    others = asked.join(held, ["id", *named], "left").select("id", (F.col("n") - F.col("open").isNotNull().cast("long")).alias("n"), (F.col("k") - F.coalesce("open", F.lit(0))).alias("k"))
    suspected = others.filter("n > 0").groupBy(F.col("id").alias("candidate")).agg(F.max("k").alias("open"))
    return suspected.select("candidate", F.when(F.col("open") == 0, "acked").otherwise("rejected").alias("status"))


def gate(lexical: DataFrame, by_vector: DataFrame | None, acknowledged: DataFrame) -> DataFrame:
    """(candidate, status): ok rows are absent; acked if each suspect pair's existing id is acknowledged (id), else rejected."""
    suspects = lexical.select("candidate", "existing")
    if by_vector is not None:
        suspects = suspects.union(by_vector.filter("kind = 'duplicate'").select("candidate", "existing"))
    known = acknowledged.select(F.col("id").alias("existing")).distinct().withColumn("ack", F.lit(True))
    open_ = suspects.distinct().join(known, "existing", "left").groupBy("candidate").agg(F.count_if(F.col("ack").isNull()).alias("open"))
    return open_.select("candidate", F.when(F.col("open") == 0, "acked").otherwise("rejected").alias("status"))
