"""Answering from retrieved evidence: support, extraction, citation checks, refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..limits import WEAK_SUPPORT, WEAK_TOP


def support_score(question: Column, top_score: Column, evidence: Column) -> Column:
    """How far the evidence's text, lower-cased, has the question's distinctive words: next to nothing if half are missing."""
    tokens = text.content_tokens(question)
    long = F.filter(tokens, lambda t: F.length(t) >= 4)
    content = F.when(F.size(long) > 0, long).otherwise(tokens)
    present = F.size(F.filter(content, lambda t: F.contains(evidence, t)))
    n = F.size(content)
    missing = n - present
    few = (missing > 0) & (missing >= F.greatest(F.lit(1), F.floor((n + 1) / 2)))
    return F.when(F.size(tokens) == 0, top_score).when(few, F.least(F.lit(0.04), 0.2 * top_score)).otherwise(0.45 * top_score + 0.55 * present / F.greatest(F.lit(1), n))


def weak(hits: Column, support: Column, top_score: Column) -> Column:
    return (hits == 0) | (support < WEAK_SUPPORT) | (top_score < WEAK_TOP)


# What a line of evidence is worth for a shared word, a word of the question within it and a number; what a line
# with a number, of the changes, or of the later revision is worth where a question's words ask for it; and less for its place
SHARED, WITHIN, NUMBER, PLACE = 3.0, 2.0, 6.0, 0.01
ASKS_NUMBER, HAS_NUMBER = ("value", "duty", "setpoint", "how many"), 2.0
ASKS_CHANGE, IS_CHANGE = ("change", "changed", "added", "removed", "moved"), 1.5
ASKS_LATER, IS_LATER = ("revision b", "rev b", "current", "after", "new"), 2.5
# The words of questions that the changes alone answer
SURE, LOOKED_UP = ("high-confidence", "high confidence"), ("show", "what is", "change")


def extractive_score(question: Column, source_id: Column, snippet: Column, position: Column) -> Column:
    """How well one evidence line answers a question, less a little for its position."""
    q, low = F.lower(question), F.lower(snippet)
    words = lambda t: F.array_distinct(text.all_of(t, r"[a-z0-9\-]{2,}", any_case=False))
    asked = F.filter(words(q), lambda t: ~t.isin(*text.EXTRACTIVE_STOP_WORDS))
    numbers = F.array_distinct(text.all_of(q, r"\d+(?:[.,]\d+)?", any_case=False))
    in_text = lambda tokens: F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    extra = lambda test, n: F.when(test, n).otherwise(0.0)
    return (
        SHARED * F.size(F.array_intersect(asked, words(low)))
        + WITHIN * in_text(asked)
        + NUMBER * in_text(numbers)
        + extra(text.has_any(q, ASKS_NUMBER) & snippet.rlike(r"(?U)\d"), HAS_NUMBER)
        + extra(text.has_any(q, ASKS_CHANGE) & source_id.startswith("D:"), IS_CHANGE)
        + extra(text.has_any(q, ASKS_LATER) & source_id.startswith("B:"), IS_LATER)
        - PLACE * position
    )


def supports(answer: Column, evidence: Column) -> Column:
    """Whether evidence backs an answer: a shared number if the answer has any, and shared words."""
    a, e = text.token_set(answer), text.token_set(evidence)
    numbers = text.lower_numbers(answer)
    shared = F.size(F.array_intersect(a, e)) / F.greatest(F.lit(1), F.size(a))
    long = F.filter(F.slice(F.array_sort(a), 1, 8), lambda t: F.length(t) > 4)
    close = (shared >= 0.12) | F.exists(long, lambda t: F.contains(F.lower(evidence), t))
    numbered = (F.size(numbers) == 0) | F.arrays_overlap(numbers, text.lower_numbers(evidence))
    return F.when((F.size(a) == 0) | (F.size(e) == 0), (F.size(e) > 0) & (F.size(a) == 0)).otherwise(numbered & close)


def validated(cited: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Of each answer (key, answer, source_id cited): how many citations are unknown, unsupported and valid, and the status.

    retrieved: (key, source_id, quote). An unknown citation fails the answer even beside valid ones; unsupported
    ones only if none is valid.
    """
    known = cited.join(retrieved.withColumn("_known", F.lit(True)), [key, "source_id"], "left")
    backed = F.coalesce(supports(F.col("answer"), F.substring("quote", 1, 240)), F.lit(False))
    counts = known.groupBy(key).agg(F.count_if(F.col("_known").isNull()).alias("n_unknown"), F.count_if(F.col("_known") & ~backed).alias("n_unsupported"), F.count_if(F.col("_known") & backed).alias("n_valid"))
    status = F.when(F.col("n_unknown") > 0, "unknown_citation").when((F.col("n_valid") == 0) & (F.col("n_unsupported") > 0), "unsupported_claim").when(F.col("n_valid") == 0, "no_citation").otherwise("ok")
    return counts.withColumn("status", status)


def extracted(evidence: DataFrame, key: str, blocks: int = 12) -> DataFrame:
    """The best line of each question's evidence (key, question, source_id, text, position from 0), with its score."""
    snippet = F.substring(F.get(F.split(F.trim("text"), r"\n"), F.lit(0)), 1, 240)
    rows = evidence.filter(F.col("position") < blocks).withColumn("snippet", snippet)
    rows = rows.withColumn("score", extractive_score(F.col("question"), F.col("source_id"), F.col("snippet"), F.col("position")))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "position")
    return rows.withColumn("rank", F.row_number().over(order))


def deterministic_route(question: Column) -> Column:
    """Which questions are answered from the change table alone, or null."""
    q = F.trim(F.lower(question))
    item = text.has(question, r"\b(D-[A-F0-9]+)\b") & text.has_any(q, LOOKED_UP)
    return F.when(text.has_any(q, SURE), "deterministic_high_conf").when(F.contains(q, F.lit("how many")) & F.contains(q, F.lit("added")), "deterministic_count").when(item, "deterministic_item")
