"""Scoring runs: precision and recall, judges, latency percentiles against budgets, comparison of scorecards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, similarity, text
from .assignment import best_pairs, weights
from .folds import ddl, fold

# Tolerances of the metrics that are compared; for all of them more is better
TOLERANCES = {
    "native_delta_f1": 0.02,
    "scanned_delta_f1": 0.05,
    "cad_delta_f1": 0.02,
    "pair_mismatch_accuracy": 0.0,
    "citation_groundedness": 0.0,
    "unsupported_refusal_accuracy": 0.0,
    "chat_fact_accuracy": 0.05,
    "retrieval_recall_at_5": 0.05,
    "citation_precision": 0.05,
}
LATENCY_RATIO = 1.5
TEXTUAL = ("instrument_tag", "table_cell", "note", "line_tag", "geometry_region")


def precision_recall(counts: DataFrame) -> DataFrame:
    """(tp, fp, fn) with precision, recall and f1. No truth and no prediction is perfect; predictions without truth, or truth without any, score as that."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = (tp + fp == 0) & (tp + fn == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    recall = F.when(none | (tp + fn == 0), 1.0).otherwise(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    out = counts.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f1", F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))))


def micro(cases: DataFrame) -> DataFrame:
    """precision, recall and f1 over all cases' counts."""
    total = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return total.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def truth_score(pairs: DataFrame, tolerance: float = 0.08, least_iou: float = 0.05) -> DataFrame:
    """pairs of a prediction (p_*) and a truth (g_*) of one change type with their agreement, 0 if the entity types don't go together."""
    pt, gt = F.col("p_entity_type"), F.col("g_entity_type")
    loose = gt.isin(*TEXTUAL, "text") | (gt == pt) | pt.isin("geometry_region", "text", "geometry_cluster")
    fits = F.coalesce(gt, F.lit("")).eqNullSafe("") | F.coalesce(pt, F.lit("")).eqNullSafe("") | loose

    def agreement(key: str) -> Column:
        p, g = F.col(f"p_{key}"), F.col(f"g_{key}")
        full = (F.coalesce(p, F.lit("")) != "") & (F.coalesce(g, F.lit("")) != "")
        return F.when(full, 0.25 * similarity.partial_ratio(p, g) / 100).when(p.isNull() & g.isNull(), 0.1).otherwise(0.0)

    a, b = geometry.box("p_"), geometry.box("g_")
    located = F.greatest(*[F.abs(v) for v in b]) > 0
    iou, distance = geometry.iou(a, b), geometry.distance(a, b)
    base = 0.4 + agreement("before") + agreement("after")
    near = (iou >= least_iou) | (distance <= tolerance)
    score = F.when(~located, base).when(near, base + 0.3 * F.greatest(iou, 1.0 - distance / tolerance)).otherwise(base * 0.5)
    return pairs.withColumn("score", F.when(fits, F.least(F.lit(1.0), score)).otherwise(0.0))


def truth_matches(scored: DataFrame, key: str, least: float = 0.45) -> DataFrame:
    """(key, p_id, g_id, score): the best one-to-one pairs of a case whose score is high enough."""

    def best(rows: list[dict]) -> list[dict]:
        ends = [np.array([str(r[c]) for r in rows]) for c in ("p_id", "g_id")]
        score = np.array([r["score"] for r in rows])
        ties = np.array([int(hashlib.md5(f"{r['p_id']}|{r['g_id']}".encode()).hexdigest()[:4], 16) for r in rows])
        return [rows[k] for k in best_pairs(*ends, weights(score, ties)) if score[k] >= least]

    wanted = scored.select(key, "p_id", "g_id", "score")
    return fold(wanted, [key], ["p_id", "g_id"], ddl(wanted), best)


#: Buckets of the values of a key.
BUCKETS = 65536


def percentiles(samples: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(key, sample_size, p50_ms, ..., max_ms) by nearest rank, where the rank is half-even rounded percent / 100 * n + 0.5."""
    # Equal values are counted first. Buckets of values, fine where there are many, then say which bucket holds a rank:
    # only the counts of buckets are added up in one place, and only the values of one bucket are put in order.
    counted = samples.select(key, F.col(value).alias("_v")).filter("_v IS NOT NULL").groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counted.groupBy(key).agg(F.sum("_c").alias("_n"), F.min("_v").cast("double").alias("_low"), F.max("_v").cast("double").alias("_high"), F.max("_v").alias("max_ms"))
    spread = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v").cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS)).otherwise(0).cast("int")
    placed = counted.join(sizes, key).withColumn("_bucket", spread)
    buckets = placed.groupBy(key, "_bucket").agg(F.sum("_c").alias("_b"))
    before = F.sum("_b").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_b")
    held = buckets.withColumn("_before", before).select(key, "_bucket", "_before", "_b")
    rank = lambda p: F.greatest(F.lit(1), F.least(F.col("_n"), F.rint(p / 100 * F.col("_n") + 0.5).cast("long")))
    ranks = sizes.select(key, "_n", F.explode(F.array(*[F.struct(F.lit(p).alias("_p"), rank(p).alias("_k")) for p in percents])).alias("_r")).select(key, "_r._p", "_r._k")
    wanted = ranks.join(held, key).filter((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_b")))
    inside = wanted.join(placed.select(key, "_bucket", "_v", "_c"), [key, "_bucket"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(key, "_p").orderBy("_v"))
    hit = inside.withColumn("_upto", upto).filter((F.col("_k") <= F.col("_upto")) & (F.col("_k") > F.col("_upto") - F.col("_c")))
    at = hit.groupBy(key).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(f"p{p}_ms") for p in percents])
    return sizes.join(at, key).select(key, F.col("_n").alias("sample_size"), *[f"p{p}_ms" for p in percents], "max_ms")


def end_to_end(samples: DataFrame, run: str, value: str) -> DataFrame:
    """Percentiles of each run's sum over its stages."""
    totals = samples.groupBy(run).agg(F.sum(value).alias(value)).withColumn("stage", F.lit("end_to_end"))
    return percentiles(totals, "stage", value)


def overruns(report: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """Stages whose 95th percentile is over budget (key, budget_p95_ms), and by how much."""
    return report.join(budgets, key).filter(F.col("p95_ms") > F.col("budget_p95_ms")).select(key, "p95_ms", "budget_p95_ms", (F.col("p95_ms") - F.col("budget_p95_ms")).alias("over_by_ms"))


def model_usage(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost; the cost of calls that report none is unknown, not zero."""
    cost = F.sum("cost").alias("total_cost")
    out = calls.groupBy(*by).agg(F.count(F.lit(1)).alias("llm_calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), cost)
    return out.withColumn("cost_status", F.when(F.col("total_cost").isNull(), "unavailable").otherwise("estimated"))


def compared(baseline: DataFrame, current: DataFrame, tolerances: DataFrame) -> DataFrame:
    """(metric, baseline, current, status) for each metric of tolerances (metric, tolerance); values are (metric, value)."""
    both = baseline.withColumnRenamed("value", "baseline").join(current.withColumnRenamed("value", "current"), "metric", "full")
    delta = F.col("current") - F.col("baseline")
    status = (
        F.when(F.col("baseline").isNull() & F.col("current").isNull(), "absent")
        .when(F.col("baseline").isNull(), "new")
        .when(F.col("current").isNull(), "missing")
        .when(delta < -F.col("tolerance"), "regressed")
        .when(delta > F.col("tolerance"), "improved")
        .otherwise("unchanged")
    )
    return tolerances.join(both, "metric", "left").select("metric", "baseline", "current", status.alias("status"))


def latency_status(baseline: Column, current: Column) -> Column:
    return F.when(current > LATENCY_RATIO * baseline, "regressed").otherwise("ok")


def judged(answers: DataFrame) -> DataFrame:
    """answers (answer, unsupported, cited, quotes, facts, expect_unsupported, prefixes) with fact_ok, refusal_ok, citation_precision, groundedness, groundedness_measured."""
    facts, quotes, cited, prefixes = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("facts", "quotes", "cited", "prefixes"))
    refused = F.coalesce("expect_unsupported", F.lit(False))
    good = F.size(F.filter(cited, lambda c: F.exists(prefixes, lambda p: F.startswith(c, p))))
    grounded = F.size(F.filter(facts, lambda f: F.exists(quotes, lambda q: text.fact_present(f, q))))
    return answers.withColumns(
        {
            "fact_ok": refused | F.forall(facts, lambda f: text.fact_present(f, F.col("answer"))),
            "refusal_ok": F.col("unsupported") == refused,
            "citation_precision": F.when((F.size(cited) > 0) & (F.size(prefixes) > 0), good / F.size(cited)).otherwise(1.0),
            "groundedness": F.when(refused, 1.0).when(F.size(quotes) == 0, 0.0).when(F.size(facts) == 0, 1.0).otherwise(grounded / F.greatest(F.lit(1), F.size(facts))),
            "groundedness_measured": (F.size(facts) > 0) & ~refused,
        }
    )


def gates(scores: DataFrame, least: DataFrame) -> DataFrame:
    """(metric, value, gate, passed) for scores (metric, value) and gates (metric, gate)."""
    return scores.join(least, "metric").withColumn("passed", F.coalesce(F.col("value") >= F.col("gate"), F.lit(False)))


def retrieval_hits(hits: DataFrame, expected: DataFrame, first: int = 5, upper: Callable[[Column], Column] = F.upper) -> DataFrame:
    """(check_id, hit) for expected (check_id, must, families): whether one of the first hits (check_id, position, text,
    identifiers, source_family) has the text, without regard to case (by upper), spaces and hyphens, and is of a family asked for."""
    bare = lambda c: F.regexp_replace(upper(c), "[ -]", "")
    blob = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.array_join(F.coalesce("identifiers", F.array().cast("array<string>")), " "))
    asked = F.coalesce(F.size("families"), F.lit(0)) <= 0
    good = F.contains(bare(blob), bare(F.col("must"))) & (asked | F.array_contains("families", F.col("source_family")))
    near = hits.filter(F.col("position") <= first).join(expected, "check_id").groupBy("check_id").agg(F.max(good).alias("hit"))
    return expected.select("check_id").join(near, "check_id", "left").select("check_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def judge_means(judged_: DataFrame) -> DataFrame:
    """One row of means over judged answers; a question that doesn't say whether it should be refused counts for no refusal."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    told = F.col("expect_unsupported").isNotNull()
    return judged_.agg(
        F.coalesce(share("fact_ok"), F.lit(0.0)).alias("chat_fact_accuracy"),
        F.coalesce(F.avg("citation_precision"), F.lit(0.0)).alias("citation_precision"),
        F.coalesce(F.avg("groundedness"), F.lit(0.0)).alias("citation_groundedness"),
        F.count_if("groundedness_measured").alias("n_measured"),
        F.coalesce(F.avg(F.when(told, F.col("refusal_ok").cast("double"))), F.lit(1.0)).alias("unsupported_refusal_accuracy"),
        F.count(F.lit(1)).alias("n_answers"),
    )


def all_gates(gated: DataFrame) -> DataFrame:
    """One row: whether all gates passed, and the names of those that didn't. No gate at all passes."""
    lost = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric"))))
    return gated.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("all_gates_passed"), lost.alias("failed"))


def statuses(cases: DataFrame, available: DataFrame) -> DataFrame:
    """cases (case, required, needs, error) with status: ok, error, or skipped where a reader they need isn't there, and whether that fails the run.

    available: (reader), those that are there.
    """
    there = available.select(F.col("reader").alias("needs"), F.lit(True).alias("_there")).distinct()
    status = F.when(F.col("needs").isNotNull() & F.col("_there").isNull(), F.concat(F.lit("skipped_"), "needs")).when(F.col("error").isNotNull(), F.concat(F.lit("error_"), "error")).otherwise("ok")
    out = cases.join(there, "needs", "left").withColumn("status", status).drop("_there")
    return out.withColumn("failed", F.coalesce("required", F.lit(True)) & (F.col("status") != "ok"))


def failures(cases: DataFrame, counts: DataFrame, judged_: DataFrame) -> DataFrame:
    """(kind, subject, n, detail): all that went wrong, whatever the gates say.

    cases: (case, status, error). counts: (case, fp, fn). judged_: (case, qid and the columns of ``judged``). A groundedness of
    0 counts as a failure like any below 1.
    """
    subject = F.concat_ws("/", F.col("case").cast("string"), F.col("qid").cast("string"))
    part = lambda rows, kind, who, n, detail: rows.select(F.lit(kind).alias("kind"), who.cast("string").alias("subject"), n.cast("long").alias("n"), detail.alias("detail"))
    one, case = F.lit(1), F.col("case")
    parts = [
        part(cases.filter("status <> 'ok'"), "case_status", case, one, F.concat_ws(": ", "status", F.col("error").cast("string"))),
        part(counts.filter("fp > 0"), "delta_false_positive", case, F.col("fp"), F.lit("changes that no truth has")),
        part(counts.filter("fn > 0"), "delta_missed_change", case, F.col("fn"), F.lit("changes of the truth that were not found")),
        part(judged_.filter("NOT fact_ok"), "chat_fact_miss", subject, one, F.lit("the answer lacks an expected fact")),
        part(judged_.filter("coalesce(groundedness, 1.0) < 1.0"), "citation_not_grounded", subject, one, F.lit("the cited evidence lacks an expected fact")),
        part(judged_.filter("NOT refusal_ok"), "refusal_miss", subject, one, F.lit("refused or answered against expectation")),
    ]
    return reduce(DataFrame.union, parts)


def scorecard_values(texts: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, metric, value) of scorecards (run, body: a JSON object, bare or below "summary"); what is no number is left out, true and false too."""
    bare = F.coalesce(F.get_json_object("body", "$.summary"), "body")
    number = lambda c: F.when(c.rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$"), c).try_cast("double")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), number(F.get_json_object(bare, f"$.{m}")).alias("value")) for m in metrics])
    return texts.select("run", F.explode(pairs).alias("p")).select("run", "p.*").filter("value IS NOT NULL")


def scorecards_compared(texts: DataFrame, baseline: str, current: str, tolerances: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Two scorecards of texts (run, body) held against each other: rows of metrics, gates that were passed and no longer are,
    the latency, and one row that says whether there is a regression, and whether other questions were asked."""
    tolerances = tolerances or TOLERANCES
    spark, latency = texts.sparkSession, "budget.end_to_end.p95_ms"
    side = lambda rows, run: rows.filter(F.col("run") == run).drop("run")
    values = scorecard_values(texts, [*tolerances, latency])
    rows = compared(side(values, baseline), side(values, current), spark.createDataFrame(list(tolerances.items()), "metric string, tolerance double"))
    whole = F.coalesce(F.get_json_object("body", "$.summary"), "body")
    gates_ = texts.select("run", F.explode(F.from_json(F.get_json_object(whole, "$.gates"), "map<string,boolean>")).alias("gate", "passed"))
    lost = side(gates_, baseline).filter("passed").select("gate").join(side(gates_, current).filter("NOT passed").select("gate"), "gate")
    slow = side(values, baseline).withColumnRenamed("value", "baseline").join(side(values, current).withColumnRenamed("value", "current"), "metric").filter(F.col("metric") == latency)
    slow = slow.select("metric", "baseline", "current", F.round(F.col("current") / F.nullif("baseline", F.lit(0.0)), 2).alias("ratio"), latency_status(F.col("baseline"), F.col("current")).alias("status"))
    hashes = texts.select("run", F.get_json_object(whole, "$.dataset_hash").alias("h"))
    n = rows.filter("status IN ('regressed', 'missing')").select(F.lit(1)).union(lost.select(F.lit(1))).union(slow.filter("status = 'regressed'").select(F.lit(1))).agg(F.count(F.lit(1)).alias("regressions"))
    asked = hashes.agg((F.max(F.when(F.col("run") == baseline, F.col("h"))) != F.max(F.when(F.col("run") == current, F.col("h")))).alias("c")).select(F.coalesce("c", F.lit(False)).alias("dataset_changed"))
    verdict = n.withColumn("_k", F.lit(0)).join(asked.withColumn("_k", F.lit(0)), "_k").drop("_k").withColumns({"has_regression": (F.col("regressions") > 0) & ~F.col("dataset_changed"), "not_attributable": (F.col("regressions") > 0) & F.col("dataset_changed")})  # one row each
    return {"metrics": rows, "gates": lost, "latency": slow, "verdict": verdict}
