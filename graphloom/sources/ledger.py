"""The deletion ledger: one JSON line per deleted node, in a folder per month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import latest
from ..operators.traverse import successor_chain

ENTRY = "id string, type string, title string, reason string, successor string, deleted_at string, cascaded_edges array<string>"


def append(entries: DataFrame, folder: str) -> None:
    """Add entries (as from ``tombstones``) to their months."""
    columns = [f.split()[0] for f in ENTRY.split(", ")]
    stamped = entries.withColumn("deleted_at", F.date_format("deleted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    stamped.select(*columns, "month").write.mode("append").partitionBy("month").json(folder)


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entries, and lines that are none (line)."""
    rows = spark.read.schema(f"{ENTRY}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder).select("*", F.col("_metadata.file_path").alias("file"))
    bad = rows.filter("_bad is not null or id is null or deleted_at is null").select(F.col("_bad").alias("line"))
    good = rows.filter("_bad is null and id is not null and deleted_at is not null").drop("_bad")
    return good.withColumn("deleted_at", F.try_to_timestamp("deleted_at")), bad


def current(entries: DataFrame) -> DataFrame:
    """The last entry per id."""
    return latest(entries, "id", "deleted_at", "reason", "successor")


def final_successors(entries: DataFrame) -> DataFrame:
    """(id, final): what took a node's place in the end; null if nothing did or the chain is a circle."""
    ends = successor_chain(current(entries).select("id", "successor"))
    return ends.select("id", F.when(F.col("final") != F.col("id"), F.col("final")).alias("final"))
