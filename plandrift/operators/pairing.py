"""Whether two revisions are a plausible pair, and which of their pages belong together."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Code, failing
from ..functions import similarity, text
from ..limits import COMPATIBLE
from .folds import ddl, fold


def signature(elements: DataFrame, key: str) -> DataFrame:
    """(key, tokens, equipment): what names a revision. elements: (key, kind, normalized_text, identifiers)."""
    ids = F.transform("identifiers", F.upper)
    primary = F.filter(ids, lambda i: i.rlike(f"(?i){text.PRIMARY_EQUIPMENT}") | (F.col("kind") == "equipment_tag"))
    own = elements.select(key, F.array_distinct(F.concat(ids, text.stable_tokens(F.col("normalized_text")))).alias("t"), primary.alias("e"))
    gathered = own.groupBy(key).agg(F.collect_set("t").alias("t"), F.collect_set("e").alias("e"))
    return gathered.select(key, F.array_sort(F.array_distinct(F.flatten("t"))).alias("tokens"), F.array_sort(F.array_distinct(F.flatten("e"))).alias("equipment"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)).otherwise(0.0)


def title_words(page_text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.substring(page_text, 1, 400)), r"(?U)\s+"), lambda w: w != ""))


def assess(pairs: DataFrame, threshold: float = COMPATIBLE) -> DataFrame:
    """pairs (underlying_a/b, tokens_a/b, equipment_a/b, title_a/b) with token_overlap, title_overlap, score, compatible, reasons."""
    out = pairs.withColumns(
        {
            "token_overlap": jaccard(F.col("tokens_a"), F.col("tokens_b")),
            "title_overlap": jaccard(title_words(F.col("title_a")), title_words(F.col("title_b"))),
            "_differs": ~F.col("underlying_a").eqNullSafe(F.col("underlying_b")),
            "_disjoint": (F.size("equipment_a") > 0) & (F.size("equipment_b") > 0) & ~F.arrays_overlap("equipment_a", "equipment_b"),
        }
    )
    titled = (F.coalesce("title_a", F.lit("")) != "") & (F.coalesce("title_b", F.lit("")) != "") & (F.col("title_overlap") < 0.15)
    low, moderate = F.col("token_overlap") < 0.25, F.col("token_overlap") < 0.5
    lost = lambda test, n: F.when(test, F.lit(n)).otherwise(0.0)
    score = 1.0 - lost(F.col("_differs"), 0.45) - F.when(low, 0.25).when(moderate, 0.1).otherwise(0.0) - lost(F.col("_disjoint"), 0.25) - lost(titled, 0.1)
    reasons = [
        F.when(F.col("_differs"), "underlying_document_id differs"),
        F.when(low, "stable-token overlap is low").when(moderate, "stable-token overlap is moderate"),
        F.when(F.col("_disjoint"), "primary equipment tag differs"),
        F.when(titled, "title/block text differs strongly"),
    ]
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.withColumns({"compatible": F.col("score") >= threshold, "reasons": F.array_compact(F.array(*reasons))}).drop("_differs", "_disjoint")


def enforce(assessed: DataFrame, mode: str = "warn") -> DataFrame:
    """Adds the action that a mode takes; in mode strict, reading an incompatible pair raises."""
    other = {"force": F.lit("forced_continue"), "strict": failing(Code.MISMATCH, F.lit("not a plausible revision pair"))}.get(mode, F.lit("continue_with_warning"))
    return assessed.withColumn("action", F.when(F.col("compatible"), "continue").otherwise(other))


def page_similarity(pairs: DataFrame) -> DataFrame:
    """pairs of pages (sheet_id, page_number, width, height, page_text, each _a and _b) with their similarity."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    named = (F.coalesce(a("sheet_id"), F.lit("")) != "") & (a("sheet_id") == b("sheet_id"))
    sized = (a("width") != 0) & (b("width") != 0) & (a("height") != 0) & (b("height") != 0)
    aspect = F.greatest(F.lit(0.0), 1.0 - F.abs(a("width") / F.greatest(a("height"), F.lit(1e-6)) - b("width") / F.greatest(b("height"), F.lit(1e-6))))
    ta, tb = (F.substring(F.coalesce(c("page_text"), F.lit("")), 1, 800) for c in (a, b))
    words = F.when((ta != "") & (tb != ""), 0.35 * similarity.token_set_ratio(ta, tb) / 100).otherwise(0.0)
    score = F.when(named, 0.35).otherwise(0.0) + F.when(a("page_number") == b("page_number"), 0.15).otherwise(0.0) + F.when(sized, 0.15 * aspect).otherwise(0.0) + words
    return pairs.withColumn("similarity", F.least(F.lit(1.0), score))


def align(similar: DataFrame, key: list[str], least: float = 0.25) -> DataFrame:
    """(key, page_a, page_b, similarity): each page of a, in order, with the best page of b that is left, the first of equals.

    similar: (key, page_a, page_b, similarity). The choice depends on those before it, so a pair's pages go
    through one fold; a revision has a bounded number of pages.
    """

    def taken(rows: list[dict]) -> list[dict]:
        used, out = set(), []
        for _, own in groupby(rows, lambda r: r["page_a"]):
            best = max((r for r in own if r["page_b"] not in used), key=lambda r: r["similarity"], default=None)
            if best and best["similarity"] >= least:
                used.add(best["page_b"])
                out.append(best)
        return out

    wanted = similar.select(*key, "page_a", "page_b", "similarity")
    return fold(wanted, key, ["page_a", "page_b"], ddl(wanted), taken)
