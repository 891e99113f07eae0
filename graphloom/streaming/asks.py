"""Counted questions and one-time notes as keyed stream state with a time to live.

The state stands in RocksDB beside each task, with its changes in the stream's
checkpoint: a lost executor's state is rebuilt from there, and memory doesn't
grow with the keys. What counts is the time in the rows, to the
millisecond, so that a stream, its
restart and a batch over the same rows agree; the store's own time to live only
removes what nobody touches any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS, HOUR_MS = 24 * 3600 * 1000, 3600 * 1000
COUNT = "key string, id long, ms long, calls long"
NOTE = "folder string, ms long, text string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need; set before a stream starts."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def run_available(spark: SparkSession, writer, *where: str) -> None:
    """Run a stream of these operators over what has come so far, and end.

    State by processing time would have Spark go on with empty batches for
    ever; this query runs none. Nothing here waits for one.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        query = writer.trigger(availableNow=True).start(*where)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()


class _Counter(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "calls long, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, last = self.seen.get() or (0, None)
        batch = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")  # the asks of one question in one batch
        counted = []
        for at in batch["ms"].tolist():
            calls = 1 if last is None or at - last >= self.ttl_ms else calls + 1
            last = at if last is None else max(at, last)
            counted.append(calls)
        self.seen.update((calls, last))
        yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "ms": batch["ms"], "calls": counted})

    def close(self) -> None:
        pass


def ask_counts_stream(asks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """(key, id, at, calls) of a stream (key, id, at): each ask with how often its key came.

    A key that was not asked for ``ttl_ms`` starts anew; every ask prolongs it.
    Asks of one batch count in the order of at and id; one that comes in a
    later batch than younger ones counts when it comes.
    """
    use_rocksdb(asks.sparkSession)
    counted = asks.select("key", "id", F.unix_millis("at").alias("ms")).groupBy("key").transformWithStateInPandas(_Counter(ttl_ms), COUNT, "Append", "ProcessingTime")
    return counted.select("key", "id", F.timestamp_millis("ms").alias("at"), "calls")


def ask_counts(asks: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """:func:`ask_counts_stream` of a whole table at once."""
    order = Window.partitionBy("key").orderBy("at", "id")
    pause = F.unix_millis("at") - F.lag(F.unix_millis("at")).over(order)
    timed = asks.select("key", "id", F.timestamp_millis(F.unix_millis("at")).alias("at"))
    runs = timed.select("key", "id", "at", F.when(pause.isNull() | (pause >= ttl_ms), 1).otherwise(0).alias("fresh"))
    numbered = runs.withColumn("run", F.sum("fresh").over(order))
    return numbered.select("key", "id", "at", F.row_number().over(Window.partitionBy("key", "run").orderBy("at", "id")).cast("long").alias("calls"))


class _Notes(StatefulProcessor):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.note = handle.getValueState("note", "text string, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")
        held, given = self.note.get(), []
        for at, text in zip(batch["ms"].tolist(), batch["text"], strict=True):
            if isinstance(text, str):
                held = (text, at)
            elif held is not None:
                if at - held[1] <= self.ttl_ms:
                    given.append((key[0], at, held[0]))
                held = None
        if held is None:
            self.note.clear()
        else:
            self.note.update(held)
        yield pd.DataFrame(given, columns=["folder", "ms", "text"])

    def close(self) -> None:
        pass


def one_time_notes(actions: DataFrame, ttl_ms: int = HOUR_MS) -> DataFrame:
    """(folder, at, text): notes as they are given back, of a stream (folder, id, at, text).

    A row with a text leaves a note for its folder in place of the last; one
    without takes it, once, if it is at most ``ttl_ms`` old.
    """
    use_rocksdb(actions.sparkSession)
    given = actions.select("folder", "id", F.unix_millis("at").alias("ms"), "text").groupBy("folder").transformWithStateInPandas(_Notes(ttl_ms), NOTE, "Append", "ProcessingTime")
    return given.select("folder", F.timestamp_millis("ms").alias("at"), "text")
