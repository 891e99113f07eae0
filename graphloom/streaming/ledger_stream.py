"""The deletion ledger as a stream: last entry per id, and final successors kept up from what changed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import latest
from ..operators.traverse import successor_chain
from ..session import shared_checkpoint
from ..sources.ledger import ENTRY
from ..sources.pointers import put_if_absent, read_lines

_STATE = "batch long, folder string"


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New ledger lines as they are appended; lines that are none are left out."""
    rows = spark.readStream.schema(ENTRY).option("recursiveFileLookup", True).json(folder)
    return rows.filter("id is not null and deleted_at is not null").withColumn("deleted_at", F.try_to_timestamp("deleted_at"))


def affected(current: DataFrame, changed: DataFrame) -> DataFrame:
    """(id): ``changed`` ids, and those whose chain of ``current`` (id, successor) leads through one."""
    found = shared_checkpoint(changed.select("id").distinct())
    frontier = found
    while not frontier.isEmpty():
        before = current.join(frontier.select(F.col("id").alias("successor")), "successor", "left_semi").select("id")
        frontier = shared_checkpoint(before.join(found, "id", "left_anti").distinct())
        found = shared_checkpoint(found.unionByName(frontier))
    return found


def updated_finals(finals: DataFrame, current: DataFrame, changed: DataFrame) -> DataFrame:
    """``finals`` (id, final) after the pointers of ``changed`` ids became those of ``current``.

    Chains are followed for affected ids only, as far as the first id that is
    not: from there the known end holds.
    """
    open_ = affected(current, changed)
    ends = successor_chain(current.join(open_, "id", "left_semi").select("id", "successor"))
    known = finals.join(open_, "id", "left_anti")
    beyond = known.select(F.col("id").alias("reached"), F.struct(F.col("final").alias("final")).alias("on"))
    told = ends.select("id", F.col("final").alias("reached")).join(beyond, "reached", "left")
    #: A known id without a final is where a chain ends, or turns in a circle.
    turning = known.join(current.filter("successor is not null"), "id", "left_semi").filter("final is null").select(F.col("id").alias("reached"), F.lit(True).alias("turns"))
    told = told.join(turning, "reached", "left")
    final = F.when(F.col("turns"), F.lit(None)).when(F.col("on").isNotNull(), F.coalesce("on.final", "reached")).otherwise(F.col("reached"))
    fresh = told.select("id", F.when(final != F.col("id"), final).alias("final"))
    return known.unionByName(fresh)


class LedgerFold:
    """A foreachBatch sink that holds each id's last entry and final successor under ``folder``.

    A batch writes both tables anew and then a pointer that no other run can
    make, so that readers see them before or after, and a batch that is run
    again does nothing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self) -> tuple[int, str | None]:
        row = read_lines(self.spark, f"{self.folder}/log", _STATE).agg(F.max(F.struct("batch", "folder")).alias("at")).first()
        return (-1, None) if row.at is None else (row.at["batch"], row.at["folder"])

    def read(self) -> tuple[DataFrame, DataFrame]:
        """Last entries, and (id, final)."""
        _, folder = self._at()
        if folder is None:
            raise ValueError("no batch yet")
        return self.spark.read.parquet(f"{self.folder}/{folder}/current"), self.spark.read.parquet(f"{self.folder}/{folder}/finals")

    def __call__(self, batch: DataFrame, number: int) -> None:
        last, folder = self._at()
        if last >= number:
            return
        fresh = shared_checkpoint(latest(batch, "id", "deleted_at", "reason", "successor"))
        if folder is None:
            before, finals = fresh.limit(0), self.spark.createDataFrame([], "id string, final string")
        else:
            before, finals = self.read()
        touched = before.join(fresh.select("id"), "id", "left_semi")
        newest = latest(touched.unionByName(fresh), "id", "deleted_at", "reason", "successor")
        current = shared_checkpoint(before.join(fresh.select("id"), "id", "left_anti").unionByName(newest))
        was = touched.select("id", F.struct(F.col("successor").alias("s")).alias("was"))
        moved = current.join(fresh.select("id"), "id", "left_semi").join(was, "id", "left").filter(F.col("was").isNull() | ~F.col("was.s").eqNullSafe(F.col("successor"))).select("id")
        ends = updated_finals(finals, current.select("id", "successor"), moved)
        to = f"b{number}-{uuid.uuid4().hex}"
        current.write.parquet(f"{self.folder}/{to}/current")
        ends.write.parquet(f"{self.folder}/{to}/finals")
        put_if_absent(self.spark, f"{self.folder}/log/{number:012d}.json", json.dumps({"batch": number, "folder": to}) + "\n")
