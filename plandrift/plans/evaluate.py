"""Scoring runs: changes against truth, answers against expectations, latencies against budgets, and the gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluation


def scorecard(found: DataFrame, truth: DataFrame, answered: DataFrame, gates: DataFrame, hits: DataFrame | None = None, verdicts: DataFrame | None = None, statuses: DataFrame | None = None) -> dict[str, DataFrame]:
    """cases, metrics (metric, value), gates, whether all passed, and failures of an evaluation.

    found and truth: (case, change_type and the p_ or g_ columns of ``evaluation.truth_score``). answered: the
    columns of ``evaluation.judged`` with qid. hits: of ``evaluation.retrieval_hits``. verdicts: (case, compatible,
    expect_compatible). statuses: of ``evaluation.statuses``.
    """
    pairs = evaluation.truth_matches(evaluation.truth_score(found.join(truth, ["case", "change_type"])), "case")
    n = lambda rows, name: rows.groupBy("case").agg(F.count(F.lit(1)).alias(name))
    counts = n(found, "n_found").join(n(truth, "n_truth"), "case", "full").join(n(pairs, "tp"), "case", "left").fillna(0)
    cases = evaluation.precision_recall(counts.select("case", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn")))
    total = evaluation.micro(cases)
    each = evaluation.judged(answered)
    means = evaluation.judge_means(each).drop("n_measured", "n_answers")
    measured = [(total, "delta_f1", F.col("f1")), *[(means, c, F.col(c)) for c in means.columns]]
    if hits is not None:
        measured.append((hits.agg(F.avg(F.col("hit").cast("double")).alias("v")), "retrieval_recall_at_5", F.col("v")))
    if verdicts is not None:
        right = F.avg((F.col("compatible") == F.col("expect_compatible")).cast("double"))
        measured.append((verdicts.agg(F.coalesce(right, F.lit(1.0)).alias("v")), "pair_mismatch_accuracy", F.col("v")))
    metrics = reduce(DataFrame.union, [rows.select(F.lit(name).alias("metric"), v.cast("double").alias("value")) for rows, name, v in measured])
    gated = evaluation.gates(metrics, gates)
    told = cases.select("case", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")) if statuses is None else statuses
    by_case = each if "case" in each.columns else each.withColumn("case", F.lit("all"))
    return {"cases": cases, "metrics": metrics, "gates": gated, "all_gates": evaluation.all_gates(gated), "failures": evaluation.failures(told, cases, by_case)}


def summary(card: dict[str, DataFrame], settings: str, dataset: str) -> dict:
    """What of a scorecard is stored as JSON: its few metrics and gates, with the fingerprints of settings and questions."""
    gates = {r["metric"]: r["passed"] for r in card["gates"].collect()}
    return {r["metric"]: r["value"] for r in card["metrics"].collect()} | {"gates": gates, "all_gates_passed": all(gates.values()), "config_hash": settings, "dataset_hash": dataset}


def markdown(card: dict[str, DataFrame]) -> str:
    """A scorecard to read; metrics and gates are few, failures are cut at FAILURES."""
    lines = ["# Scorecard", "", "| Metric | Value |", "|---|---:|", *[f"| {r['metric']} | {'—' if r['value'] is None else round(r['value'], 4)} |" for r in card["metrics"].orderBy("metric").collect()]]
    lines += ["", "## Gates", "", *[f"- {r['metric']}: {'passed' if r['passed'] else '**failed**'}" for r in card["gates"].orderBy("metric").collect()]]
    lines += ["", "## Failures", "", *[f"- {r['kind']}: {r['subject']} ({r['detail']})" for r in card["failures"].orderBy("kind", "subject").limit(FAILURES).collect()]]
    return "\n".join(lines) + "\n"


#: Failures that a scorecard lists.
FAILURES = 200

CASE = "id string, pid_a string, pid_b string, required boolean, needs string, expect_compatible boolean, truth string, retrieval array<struct<query:string,must:string,families:array<string>>>, qa array<struct<id:string,question:string,facts:array<string>,prefixes:array<string>,unsupported:boolean>>"


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The cases (CASE) of a JSON object with "cases", and a hash of 16 digits of its text."""
    text = spark.read.text(path, wholetext=True)
    cases = text.select(F.explode(F.from_json(F.get_json_object("value", "$.cases"), f"array<struct<{', '.join(c for c in _fields(CASE))}>>")).alias("c")).select("c.*")
    return cases, text.select(F.substring(F.sha2("value", 256), 1, 16)).first()[0]


def _fields(schema: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields]


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The true changes (case, g_id and the g_ columns of ``evaluation.truth_score``) of JSON lines."""
    return spark.read.schema("case string, g_id string, change_type string, g_entity_type string, g_before string, g_after string, g_x0 double, g_y0 double, g_x1 double, g_y1 double").json(path)
