"""From matches to changes: classification, confidence, suppression, descriptions, ids, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..limits import HIGH, MEDIUM, MOVE_TOLERANCE
from ..tables import stored
from .matching import assigned, candidates, scored, unmatched


def change_type(text_a: Column, text_b: Column, distance: Column, text_score: Column, shape: Column, ocr: Column | None = None, tolerance: float = MOVE_TOLERANCE) -> Column:
    """unchanged, moved, modified or moved_modified. A changed number always counts; white space that OCR placed never does."""
    differ = (text_a != text_b) & ((text.numbers(text_a) != text.numbers(text_b)) | (text_score < 0.92))
    if ocr is not None:
        differ = differ & ~(ocr & text.whitespace_only_difference(text_a, text_b))
    differ = F.when((text_a == "") & (text_b == ""), shape < 0.7).otherwise(differ)
    moved = distance > tolerance
    return F.when(moved & differ, "moved_modified").when(moved, "moved").when(differ, "modified").otherwise("unchanged")


def confidence(kind: Column, match: Column, identifier: Column, text_score: Column, spatial: Column, extraction: Column, registration: Column, pair: Column) -> Column:
    """How sure a change is, from 0 to 1. A match score of exactly 0 counts as unknown."""
    known = F.when(F.coalesce(match, F.lit(0.0)) != 0, match).otherwise(F.when(kind.isin("added", "removed"), 0.8).otherwise(0.5))
    base = 0.15 * pair + 0.15 * registration + 0.20 * extraction + 0.30 * known + 0.10 * identifier + 0.10 * (0.5 * (text_score + spatial))
    lifted = F.when(kind.isin("added", "removed") & (identifier >= 1), F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    return geometry.clamp(lifted)


def band(value: Column) -> Column:
    return F.when(value >= HIGH, "high").when(value >= MEDIUM, "medium").otherwise("low")


def description(kind: Column, entity: Column, before: Column, after: Column, page: Column, grid: Column) -> Column:
    place = F.concat(F.lit("sheet "), F.coalesce(F.when(page != 0, page), F.lit(1)).cast("string"), F.when(F.coalesce(grid, F.lit("")) != "", F.concat(F.lit(", grid "), grid)).otherwise(""))
    filled = lambda v: F.when(F.coalesce(v, F.lit("")) == "", F.lit("(geometry)")).otherwise(v)
    quoted = lambda verb: F.concat(F.lit(verb), entity, F.lit(" from '"), F.coalesce(before, F.lit("None")), F.lit("' to '"), F.coalesce(after, F.lit("None")), F.lit("' on "), place, F.lit("."))
    return (
        F.when(kind == "added", F.concat(F.lit("Added "), entity, F.lit(": "), filled(after), F.lit(" at "), place, F.lit(".")))
        .when(kind == "removed", F.concat(F.lit("Removed "), entity, F.lit(": "), filled(before), F.lit(" at "), place, F.lit(".")))
        .when(kind == "moved", F.concat(F.lit("Moved "), entity, F.lit(": "), F.coalesce(F.nullif(after, F.lit("")), before, F.lit("")), F.lit(" on "), place, F.lit(".")))
        .when(kind == "moved_modified", quoted("Moved and modified "))
        .otherwise(quoted("Modified "))
    )


def item_id(pid_a: Column, pid_b: Column, kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("D-"), F.upper(F.substring(F.sha1(F.concat_ws("|", pid_a, pid_b, kind, payload)), 1, 8)))


def page_changes(a: DataFrame, b: DataFrame, key: list[str], pid_a: Column, pid_b: Column) -> DataFrame:
    """A change for each page that one revision lacks: key names a page on both sides."""
    pages = lambda rows: rows.select(*key).distinct()
    lacking = lambda rows, others: pages(rows).join(pages(others), key, "left_anti")
    return whole_pages(lacking(a, b), key, "removed", pid_a, pid_b).unionByName(whole_pages(lacking(b, a), key, "added", pid_a, pid_b))


def whole_pages(pages: DataFrame, key: list[str], kind: str, pid_a: Column, pid_b: Column, page: str | None = None) -> DataFrame:
    """A change, added or removed, for each page that the other revision lacks."""
    number = F.col(page or key[-1]).cast("string")
    name, none = F.concat(F.lit("page "), number), F.lit(None).cast("string")
    return pages.select(
        *key,
        F.lit(kind).alias("change_type"),
        F.lit("page").alias("entity_type"),
        (name if kind == "removed" else none).alias("before"),
        (name if kind == "added" else none).alias("after"),
        F.concat(F.lit({"added": "Added page ", "removed": "Removed page "}[kind]), number, F.lit(".")).alias("description"),
        F.lit(0.9).alias("confidence"),
        F.lit("high").alias("confidence_band"),
        F.lit(False).alias("review_required"),
        item_id(pid_a, pid_b, F.lit(kind), F.concat(F.lit("page-"), number)).alias("delta_item_id"),
        *[F.lit(None).cast("double").alias(c) for c in BOX],
        F.lit(None).cast(FEATURES).alias("features"),
    )


BOX, FEATURES = ("x0", "y0", "x1", "y1"), "map<string,double>"


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _judged(confidence_: Column) -> list[Column]:
    return [F.round(confidence_, 4).alias("confidence"), band(confidence_).alias("confidence_band"), (band(confidence_) != "high").alias("review_required")]


def _named(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def classified(matches: DataFrame) -> DataFrame:
    """Matches with change_type and with noise: whether a change would be between labels that say nothing."""
    ta, tb = F.col("normalized_text_a"), F.col("normalized_text_b")
    labels = text.is_noise(ta) & text.is_noise(tb) | (F.upper(ta).startswith("REV:") & F.upper(tb).startswith("REV:"))
    return matches.withColumns({"change_type": change_type(ta, tb, F.col("distance"), F.col("text"), F.col("geometry")), "noise": labels})


def matched_changes(matches: DataFrame, key: list[str], pid_a: Column, pid_b: Column, extraction: Column | float = 1.0, registration: Column | float = 0.9, pair: Column | float = 1.0, page: str | None = None) -> DataFrame:
    """A change for each match that differs and is no noise."""
    ta, tb = F.col("normalized_text_a"), F.col("normalized_text_b")
    typed = classified(matches).filter("change_type <> 'unchanged' AND NOT noise")
    sure = confidence(F.col("change_type"), F.round("score", 4), F.col("identifier"), F.col("text"), F.col("spatial"), *map(_column, (extraction, registration, pair)))
    out = typed.withColumns({"_sure": sure, "_grid": text.grid_label(*geometry.box(suffix="_b"))})
    payload = F.concat_ws("|", "element_id_a", "element_id_b", "change_type", ta, tb)
    return out.select(
        *key,
        "change_type",
        F.col("kind_b").alias("entity_type"),
        ta.alias("before"),
        tb.alias("after"),
        description(F.col("change_type"), F.col("kind_b"), ta, tb, F.col(page or key[-1]), F.col("_grid")).alias("description"),
        *_judged(F.col("_sure")),
        item_id(pid_a, pid_b, F.col("change_type"), payload).alias("delta_item_id"),
        *[F.col(f"{c}_b").alias(c) for c in BOX],
        _named(**{c: F.col(c) for c in ("identifier", "text", "spatial", "type", "geometry")}, centroid_distance=F.col("distance"), match_score=F.round("score", 4)).alias("features"),
    )


def silent(kind: Column, normalized: Column) -> Column:
    """Whether an element without a match says nothing: geometry without text, or noise."""
    return (kind == "geometry_cluster") & (normalized == "") | text.is_noise(normalized)


def one_sided_changes(elements: DataFrame, key: list[str], kind: str, pid_a: Column, pid_b: Column, extraction: Column | float = 1.0, registration: Column | float = 0.9, pair: Column | float = 1.0, page: str | None = None) -> DataFrame:
    """A change, added or removed, for each element without a match that is no noise."""
    own, none = F.col("normalized_text"), F.lit(None).cast("string")
    known = F.when(F.size("identifiers") > 0, 1.0).otherwise(0.0)
    sure = confidence(F.lit(kind), F.lit(0.75), known, F.lit(0.5), F.lit(0.5), *map(_column, (extraction, registration, pair)))
    out = elements.filter(~silent(F.col("kind"), own)).withColumns({"_sure": sure, "_grid": text.grid_label(*geometry.box())})
    before, after = (own, none) if kind == "removed" else (none, own)
    return out.select(
        *key,
        F.lit(kind).alias("change_type"),
        F.col("kind").alias("entity_type"),
        before.alias("before"),
        after.alias("after"),
        description(F.lit(kind), F.col("kind"), before, after, F.col(page or key[-1]), F.col("_grid")).alias("description"),
        *_judged(F.col("_sure")),
        item_id(pid_a, pid_b, F.lit(kind), F.concat("element_id", own)).alias("delta_item_id"),
        *BOX,
        F.lit(None).cast(FEATURES).alias("features"),
    )


def residual_changes(residuals: DataFrame, key: list[str], pid_a: Column, pid_b: Column, registration: Column | float, pair: Column | float, page: str) -> DataFrame:
    """A change for each reported residual (key, place from 0, change_type, area, box) of an image difference."""
    region, none = F.lit("geometry region"), F.lit(None).cast("string")
    before, after = F.when(F.col("change_type") == "removed", region).otherwise(none), F.when(F.col("change_type") != "removed", region).otherwise(none)
    sure = confidence(F.col("change_type"), F.lit(0.55), F.lit(0.0), F.lit(0.5), F.lit(0.6), F.lit(0.6), *map(_column, (registration, pair)))
    out = residuals.withColumns({"_sure": sure, "_grid": text.grid_label(*geometry.box())})
    place = F.concat(F.lit("geo-"), F.col(page).cast("string"), F.lit("-"), F.col("place").cast("string"), F.lit("-["), F.concat_ws(", ", *[F.col(c).cast("string") for c in BOX]), F.lit("]"))
    return out.select(
        *key,
        "change_type",
        F.lit("geometry_region").alias("entity_type"),
        before.alias("before"),
        after.alias("after"),
        description(F.col("change_type"), F.lit("geometry_region"), before, after, F.col(page), F.col("_grid")).alias("description"),
        F.round("_sure", 4).alias("confidence"),
        band(F.col("_sure")).alias("confidence_band"),
        F.lit(True).alias("review_required"),
        item_id(pid_a, pid_b, F.col("change_type"), place).alias("delta_item_id"),
        *BOX,
        _named(area=F.col("area")).alias("features"),
    )


def compared(a: DataFrame, b: DataFrame, key: list[str], pid_a: Column, pid_b: Column, pages: DataFrame | None = None, page_a: str | None = None, page_b: str | None = None) -> dict[str, DataFrame]:
    """Changes between the elements of two revisions, page by page, of pages that both have.

    pages: (key, registration, pair, m0 .. m5), how sure each page's registration and its pair are and how a maps onto
    b; without it the pages lie on each other. Gives matches, changes, suppressed (key, n: what is unchanged or noise)
    and explained (key, box: where known changes and unchanged elements account for a difference of images).
    """
    shared = lambda rows, others: rows.join(others.select(*key).distinct(), key, "left_semi")
    ours, theirs = shared(a, b), shared(b, a)
    near, sure = candidates(ours, theirs, key), {"registration": 0.9, "pair": 1.0}
    matrix = None
    if pages is not None:
        near, ours, theirs = (rows.join(pages, key) for rows in (near, ours, theirs))
        matrix, sure = [F.col(f"m{k}") for k in range(6)], {"registration": F.col("registration"), "pair": F.col("pair")}
    matches = stored(assigned(scored(near, matrix=matrix), key), "matches")
    gone, new = unmatched(ours, matches, key, "a"), unmatched(theirs, matches, key, "b")
    own = lambda rows: rows["extraction_confidence"] if "extraction_confidence" in rows.columns else 1.0
    both = F.least("extraction_a", "extraction_b") if "extraction_a" in matches.columns else 1.0
    parts = (
        matched_changes(matches, key, pid_a, pid_b, both, page=page_b, **sure),
        one_sided_changes(gone, key, "removed", pid_a, pid_b, own(gone), page=page_a, **sure),
        one_sided_changes(new, key, "added", pid_a, pid_b, own(new), page=page_b, **sure),
    )
    told = classified(matches)
    quiet = [told.filter("change_type = 'unchanged' OR noise"), *[x.filter(silent(F.col("kind"), F.col("normalized_text"))) for x in (gone, new)]]
    suppressed = union([x.select(*key) for x in quiet]).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    laid = lambda suffix: [v.alias(c) for v, c in zip(geometry.affine(geometry.box(suffix=suffix), matrix) if matrix else geometry.box(suffix=suffix), BOX)]
    differ = told.filter("change_type <> 'unchanged' AND NOT noise")
    explained = [told.filter("change_type = 'unchanged'").select(*key, *[F.col(f"{c}_b").alias(c) for c in BOX]), differ.select(*key, *[F.col(f"{c}_b").alias(c) for c in BOX]), differ.select(*key, *laid("_a"))]
    explained += [x.filter(~silent(F.col("kind"), F.col("normalized_text"))).select(*key, *place) for x, place in ((gone, laid("")), (new, BOX))]
    return {"matches": matches, "changes": union(parts), "suppressed": suppressed, "explained": union(explained)}


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def compare(a: DataFrame, b: DataFrame, key: list[str], pid_a: Column, pid_b: Column) -> DataFrame:
    """All changes between two revisions whose pages go by one number: of pages, of matches, removed, added."""
    return page_changes(a, b, key, pid_a, pid_b).unionByName(compared(a, b, key, pid_a, pid_b)["changes"])


def in_order(changes: DataFrame, page: str) -> DataFrame:
    """Changes in reading order."""
    return changes.orderBy(*reading_order(page))


def reading_order(page: str) -> list[Column]:
    return [F.coalesce(page, F.lit(0)), F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), F.col("entity_type"), F.col("delta_item_id")]


def fingerprint(changes: DataFrame, pid_a: Column, pid_b: Column, config: str, *key: str) -> DataFrame:
    """(key, n_changes, delta_id): a hash that names a set of changes."""
    ids = F.array_join(F.array_sort(F.collect_list("delta_item_id")), "|")
    counted = changes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_changes"), ids.alias("_ids"))
    whole = F.concat_ws("|", pid_a, pid_b, F.lit(config), F.col("n_changes").cast("string"), F.col("_ids"))
    return counted.select(*key, "n_changes", F.substring(F.sha1(whole), 1, 12).alias("delta_id"))


def summary(changes: DataFrame) -> DataFrame:
    """Counts by change type, by confidence band and in all, with level 0 for neither's total: grouping sets of one pass."""
    return changes.groupingSets([["change_type"], ["confidence_band"], []], "change_type", "confidence_band").agg(F.count(F.lit(1)).alias("n"))
