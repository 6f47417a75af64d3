"""Runs that were stored: their tables again, a listing, their metrics, the newest scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code, Failure
from ..functions.text import REQUEST_ID
from ..sinks.runs import TABLES, valid
from ..tables import files

REQUEST = "request_id string, pid_a string, pid_b string, mode string"
LISTED = 100


def load(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a run; a run without changes isn't there."""
    system, where = files(spark, f"{root}/{valid(run_id)}/changes")
    if not system.exists(where):
        raise Failure(Code.NOT_FOUND, f"no such run: {run_id}")
    return {n: spark.read.parquet(f"{root}/{run_id}/{n}") for n in TABLES if system.exists(files(spark, f"{root}/{run_id}/{n}")[1])}


def _small(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run, at, body) of the small files of one name below root's folders; none where there are none."""
    schema = "run string, at timestamp, body string"
    system, where = files(spark, f"{root}/*/{name}")
    found = system.globStatus(where)
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    read = spark.read.format("binaryFile").load(f"{root}/*/{name}")
    return read.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.col("modificationTime").alias("at"), F.decode("content", "UTF-8").alias("body"))


def listing(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """(request_id, at, pid_a, pid_b, mode) of the newest runs, the newest first; a request that can't be read leaves its columns null."""
    found = _small(spark, root, "request.json").filter(F.col("run").rlike(REQUEST_ID))
    parsed = found.withColumn("r", F.from_json("body", REQUEST))
    out = parsed.select(F.col("run").alias("request_id"), "at", "r.pid_a", "r.pid_b", "r.mode")
    return out.orderBy(F.desc("at"), "request_id").limit(max(1, min(LISTED, limit)))


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """(run, stage, value) of all runs' metrics.json, maps of numbers by stage; what can't be read is left out."""
    found = _small(spark, root, "metrics.json").withColumn("m", F.from_json("body", "map<string,double>"))
    return found.filter("m IS NOT NULL").select("run", F.explode("m").alias("stage", "value")).filter("value IS NOT NULL")


def latest_scorecard(spark: SparkSession, root: str, baseline: str | None = None) -> DataFrame:
    """One row (available, source, run_id, body): the newest scorecard of a run, else a baseline file, else none."""
    newest = _small(spark, root, "scorecard.json").groupBy().agg(F.max_by(F.struct("run", "body"), F.struct("at", "run")).alias("n"))
    kept = None
    if baseline is not None and files(spark, baseline)[0].exists(files(spark, baseline)[1]):
        text = spark.read.text(baseline, wholetext=True).select(F.col("value").alias("kept"))
        whole = F.when(F.get_json_object("kept", "$.summary").isNotNull(), F.col("kept")).otherwise(F.concat(F.lit('{"summary": '), "kept", F.lit("}")))
        kept = text.filter(F.try_parse_json("kept").isNotNull()).select(whole.alias("kept")).agg(F.first("kept").alias("kept"))
    both = newest.withColumn("_k", F.lit(0))
    both = both.join(kept.withColumn("_k", F.lit(0)), "_k", "left") if kept is not None else both.withColumn("kept", F.lit(None).cast("string"))
    source = F.when(F.col("n").isNotNull(), "run").when(F.col("kept").isNotNull(), "baseline")
    body = F.coalesce("n.body", "kept")
    return both.select(body.isNotNull().alias("available"), source.alias("source"), F.coalesce("n.run", F.get_json_object("kept", "$.summary.run_id")).alias("run_id"), body.alias("body"))
