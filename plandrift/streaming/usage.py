"""Running totals of model calls over a log that is appended to: what a restart would replay, kept up by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import model_usage

CALLS = "provider string, model string, tokens long, cost double, status string"


def calls(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The log's rows as a stream; each trigger takes a bounded number of files."""
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", max_files).json(path)


def totals(rows: DataFrame) -> DataFrame:
    """Calls, tokens and cost by provider: the same aggregate for a stream and for a table."""
    return model_usage(rows, "provider")


def start(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return totals(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
