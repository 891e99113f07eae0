"""Queries over the events as asks: counts with a time to live, as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..streaming import asks
from .projection import table
from .registry import query

_COUNTS = """
    WITH p AS (SELECT user_id || ':' || event_type AS key, event_id AS id, ts, epoch_ms(ts) AS ms FROM events),
    f AS (SELECT *, CASE WHEN ms - lag(ms) OVER w >= 86400000 OR lag(ms) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY key ORDER BY ms, id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ms, id) AS run FROM f)
    SELECT key, id, row_number() OVER (PARTITION BY key, run ORDER BY ms, id) AS calls FROM r
"""


def _asks(events):
    return events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


@query(_COUNTS)
def ask_counts(spark, sf_dir):
    """Each event with how often its user did the like, a day's pause starting anew."""
    return asks.ask_counts(_asks(table(spark, sf_dir, "events"))).select("key", "id", "calls")


@query(_COUNTS)
def ask_counts_stream(spark, sf_dir):
    """The same rows from keyed stream state, read back from what the stream wrote."""
    source = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("recursiveFileLookup", True).parquet(source)
    folder = f"{checkpoint_dir(spark)}/asks-{uuid.uuid4().hex}"
    counted = asks.ask_counts_stream(_asks(stream)).select("key", "id", "calls")
    asks.run_available(spark, counted.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").format("parquet"), f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")
