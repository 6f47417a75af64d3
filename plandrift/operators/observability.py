"""What runs leave behind: spans, counters, logs without content, and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration_ms(start: Column, end: Column) -> Column:
    return F.round((end - start) * 1000, 2)


def trace_total(spans: DataFrame, *by: str) -> DataFrame:
    """Spans and their summed time. ``top_level_ms`` leaves out spans inside of others, which ``total_ms`` counts twice."""
    outer = F.when(F.col("parent").isNull(), F.col("duration_ms"))
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spans"), F.sum("duration_ms").alias("total_ms"), F.sum(outer).alias("top_level_ms"))


def last_latency(spans: DataFrame, run: str, stage: str) -> DataFrame:
    """Of each run's stage the latency of the last span."""
    return spans.groupBy(run, stage).agg(F.max_by("duration_ms", F.struct("start", "duration_ms")).alias("latency_ms"))


def errors_by_type(events: DataFrame, kind: str) -> DataFrame:
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n_errors"))


def without_content(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with a hash of 16 digits and a length in place of each text column."""
    out = rows
    for c in columns:
        own = F.coalesce(c, F.lit(""))
        out = out.withColumns({f"{c}_sha256": F.substring(F.sha2(own, 256), 1, 16), f"{c}_chars": F.length(own)}).drop(c)
    return out


# What of a file's detection may be logged
DETECTED = ("adapter", "format_family", "image_coverage_est", "page_count", "size", "text_chars_sample", "vector_count_sample")


def allowed_only(signals: Column, allowed: tuple[str, ...] = DETECTED) -> Column:
    """A map without the keys that may not be logged."""
    return F.map_filter(signals, lambda k, v: k.isin(*allowed))


def write_trace(spans: DataFrame, path: str, *run: str) -> None:
    """Spans (run, name, parent, start, end: seconds) with duration_ms, and each run's totals, as JSON lines below path."""
    timed = spans.withColumn("duration_ms", duration_ms(F.col("start"), F.col("end")))
    timed.write.mode("overwrite").json(f"{path}/spans")
    trace_total(timed, *run).write.mode("overwrite").json(f"{path}/totals")


def write_metrics(counters: DataFrame, latencies: DataFrame, path: str, run: str) -> None:
    """One JSON line for each run: its counters (run, counters: a map), added up, and the last latency of its stages (run, stage, latency_ms)."""
    added = counters.select(run, F.explode("counters").alias("k", "v")).groupBy(run, "k").agg(F.sum("v").alias("v"))
    maps = added.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("counters"))
    stages = latencies.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "latency_ms")))).alias("stage_latency_ms"))
    maps.join(stages, run, "full").write.mode("overwrite").json(path)


def merged_counters(a: Column, b: Column) -> Column:
    """Two maps of counts added up."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
