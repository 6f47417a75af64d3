"""Cutting lineage: a frame is written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = named.get() if named.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return at.rstrip("/")


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        system, where = files(spark, path)
        system.delete(where, True)
    except Exception:  # the session has ended already; the folder is the cluster's to clean
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again: what uses it twice doesn't compute it twice, and lost executors cost nothing."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _homes:
        _homes[app] = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove_at_exit, spark, _homes[app])
    path = f"{_homes[app]}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
