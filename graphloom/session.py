"""Where intermediate results go that must outlive lost executors."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where neither that setting nor the context names one, as in local
    tests, a temporary folder is set; on a cluster that is an error, since its
    machines don't see each other's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


#: Spark's setting by which a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """While it lasts, a query's shuffle files go when the query ends; then the session's setting is as before."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, whatever executors are lost.

    The shuffle files that led to it are removed at once: nothing reads them
    again, and iterations would pile them up until the driver collects garbage.
    """
    checkpoint_dir(df.sparkSession)
    with shuffle_cleanup(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, under this setting


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder: later reads take only the columns they need.

    The shuffle files that led to it go at once; see :func:`drop_table`.
    """
    spark, folder = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.select("*").write.parquet(folder)
    out = spark.read.parquet(folder)
    out.shared_folder = folder
    return out


def drop_table(table: DataFrame) -> None:
    """Remove what :func:`shared_table` wrote, once everything that reads it has been written itself."""
    drop_folder(table.sparkSession, table.shared_folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system, whichever Hadoop reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
