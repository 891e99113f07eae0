"""Keyed state and windows over streams; each plan also runs over a batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, when: str, key: str, value: str, size: str, late: str | None = None) -> DataFrame:
    """(start, key, n, total) per window; with ``late`` as a watermark, for streams."""
    rows = events.withWatermark(when, late) if late else events
    return rows.groupBy(F.window(when, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, when: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, n) per session that a pause of ``gap`` ends."""
    rows = events.withWatermark(when, late) if late else events
    return rows.groupBy(key, F.session_window(when, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def call_counts(asks: DataFrame, key: str, when: str) -> DataFrame:
    """(fingerprint, calls, last_at) of a batch of asks."""
    return asks.groupBy(F.col(key).alias("fingerprint")).agg(F.count("*").alias("calls"), F.max(when).alias("last_at"))


def fingerprint(question):
    """Eight hex digits that name a question."""
    return F.substring(F.sha1(F.trim(question).cast("binary")), 1, 8)


def counted_asks(asks: DataFrame, key: str, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of (key, calls) after each ask; a key untouched for ``ttl_ms`` starts anew.

    Processing-time state with a timeout, as the store is touched on use.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def bump(name: tuple, batches: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        if own.hasTimedOut:
            own.remove()
            return
        calls = (own.get[0] if own.exists else 0) + sum(len(b) for b in batches)
        own.update((calls,))
        own.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"fingerprint": [name[0]], "calls": [calls]})

    kind = asks.schema[key].dataType.simpleString()
    return asks.groupBy(key).applyInPandasWithState(bump, f"fingerprint {kind}, calls long", "calls long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _pointer(spark, target: str) -> dict[int, int]:
    """Bucket to the version that holds it; at most as many entries as there are buckets."""
    try:
        rows = spark.read.parquet(f"{target}/pointer").groupBy("bucket").agg(F.max("version").alias("version")).collect()
    except Exception as e:  # the first batch has no pointer yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r.bucket: r.version for r in rows}


def read_latest(spark, target: str) -> DataFrame:
    """The rows that :func:`merge_latest` holds in ``target``."""
    held = [f"{target}/version={v}/bucket={b}" for b, v in _pointer(spark, target).items() if b >= 0]
    if not held:
        raise ValueError(f"nothing merged into {target}")
    return spark.read.option("basePath", target).parquet(*held).drop("version", "bucket")


def merge_latest(spark, target: str, key: str, when: str, buckets: int = 64):
    """A foreachBatch sink that keeps the last row per key in Parquet, in ``buckets`` by a hash of the key.

    A batch rewrites the buckets it touches and no others, in a new version,
    and then names them in the pointer, so that readers see a bucket before or
    after. A batch that is run again does nothing, or writes its own version
    anew. Of rows of one key and time the one whose JSON is greatest stays. A
    bucket's version before the last is removed with the next one.
    """
    from pyspark.sql import Window

    def sink(batch: DataFrame, number: int) -> None:
        known = _pointer(spark, target)
        if known and (made := spark.read.parquet(f"{target}/pointer").first().buckets) != buckets:
            raise ValueError(f"{target} has {made} buckets, not {buckets}")
        if max(known.values(), default=-1) >= number:
            return
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        held = [f"{target}/version={known[b]}/bucket={b}" for b in touched if b in known]
        if held:
            rows = rows.unionByName(spark.read.option("basePath", target).parquet(*held).select(*rows.columns))
        order = Window.partitionBy(key).orderBy(F.desc(when), F.desc(F.to_json(F.struct(*sorted(batch.columns)))))
        last = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        last.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        # A batch without rows still leaves its number, under no bucket.
        spark.createDataFrame([(number, b, buckets) for b in touched or [-1]], "version long, bucket int, buckets int").coalesce(1).write.mode("append").parquet(f"{target}/pointer")
        for b in touched:
            older = [r.version for r in spark.read.parquet(f"{target}/pointer").filter(F.col("bucket") == b).orderBy(F.desc("version")).limit(3).collect()][2:]
            for version in older:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version={version}/bucket={b}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return sink
