"""Runs on disk: a folder for each, with its tables and small files, and scorecards beside them."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import Code, Failure
from ..functions.text import REQUEST_ID
from ..tables import files

TABLES = ("changes", "elements", "pages", "records", "summary", "compatibility", "warnings", "registration", "alignment")


def valid(run_id: str) -> str:
    if not re.match(REQUEST_ID, run_id.strip()):
        raise Failure(Code.REQUEST_ID, "a run's id has letters, digits, _ and -, 64 at most")
    return run_id.strip()


def new(spark: SparkSession, root: str, run_id: str | None = None) -> str:
    """A run's folder, made; an id that is taken is an error."""
    run_id = valid(run_id) if run_id is not None else uuid.uuid4().hex[:12]
    system, where = files(spark, f"{root}/{run_id}")
    if system.exists(where):
        raise Failure(Code.REQUEST_ID, f"run {run_id} exists")
    system.mkdirs(where)
    return run_id


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, through Spark's file system."""
    system, where = files(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def store(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], request: dict, metrics: dict | None = None) -> None:
    """A run's tables as Parquet, its request and its metrics as JSON."""
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{root}/{valid(run_id)}/{name}")
    write_text(spark, f"{root}/{run_id}/request.json", json.dumps({"request_id": run_id} | request, sort_keys=True))
    write_text(spark, f"{root}/{run_id}/metrics.json", json.dumps(metrics or {}, sort_keys=True))


def store_scorecard(spark: SparkSession, root: str, run_id: str, summary: dict, markdown: str) -> None:
    """A scorecard as JSON, below "summary", and as Markdown; latest.json names the newest."""
    body = json.dumps({"summary": {"run_id": valid(run_id)} | summary}, sort_keys=True, indent=1, default=str)
    write_text(spark, f"{root}/{run_id}/scorecard.json", body)
    write_text(spark, f"{root}/{run_id}/scorecard.md", markdown)
    write_text(spark, f"{root}/latest.json", body)
