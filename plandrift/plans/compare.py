"""Comparing many pairs of revisions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Code, failing
from ..functions import geometry
from ..limits import COMPATIBLE, PAGE_WORK
from ..operators import changes, elements, matching, pairing, raster, residual, retrieval
from ..tables import stored

PAIR, PAGES = ["pid_a", "pid_b"], ["pid_a", "pid_b", "page_a", "page_b"]


def looked_up(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """pairs (pid_a, pid_b) with underlying_a/b, label_a/b and title_a/b from the registry; an unknown id can't be read without an error."""

    def of(side: str) -> DataFrame:
        known = registry.select(F.col("pid").alias(f"pid_{side}"), F.col("underlying_document_id").alias(f"underlying_{side}"), F.col("revision_label").alias(f"label_{side}"), F.coalesce("display_name", F.lit("")).alias(f"title_{side}"))
        return known.withColumn(f"_known_{side}", F.lit(""))

    out = pairs.select(*PAIR).join(of("a"), "pid_a", "left").join(of("b"), "pid_b", "left")
    for side in "ab":
        out = out.filter(F.coalesce(f"_known_{side}", failing(Code.NOT_FOUND, F.col(f"pid_{side}"))) == "").drop(f"_known_{side}")
    return out


def page_texts(rows: DataFrame) -> DataFrame:
    """(pid, page_number, page_text) of elements, in reading order. A revision's pages and their elements have a bound."""
    lines = F.array_sort(F.collect_list(F.struct(F.coalesce("y0", F.lit(0.0)).alias("y"), F.coalesce("x0", F.lit(0.0)).alias("x"), F.col("normalized_text").alias("t"))))
    return rows.groupBy("pid", "page_number").agg(F.array_join(F.transform(F.filter(lines, lambda r: r["t"] != ""), lambda r: r["t"]), "\n").alias("page_text"))


def described_pages(built: DataFrame, pages: DataFrame | None) -> DataFrame:
    """(pid, page_number, sheet_id, width, height, page_text); what pages doesn't say comes from the elements."""
    texts = page_texts(built)
    if pages is None:
        return texts.select("pid", "page_number", F.lit(None).cast("string").alias("sheet_id"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"), "page_text")
    own = pages.select("pid", "page_number", "sheet_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.col("page_text").alias("_text"))
    return own.join(texts, ["pid", "page_number"], "full").select("pid", "page_number", "sheet_id", F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("height", F.lit(0.0)).alias("height"), F.coalesce("_text", "page_text", F.lit("")).alias("page_text"))


def aligned(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(PAGES, similarity): which page of b each page of a becomes. A revision has a bounded number of pages, so a pair's pages meet each other."""

    def of(side: str) -> DataFrame:
        own = pages.withColumnRenamed("pid", f"pid_{side}")
        return own.select(f"pid_{side}", *[F.col(c).alias(f"{c}_{side}") for c in ("page_number", "sheet_id", "width", "height", "page_text")])

    met = pairs.select(*PAIR).join(of("a"), "pid_a").join(of("b"), "pid_b")
    similar = pairing.page_similarity(met).select(*PAIR, F.col("page_number_a").alias("page_a"), F.col("page_number_b").alias("page_b"), "similarity")
    return pairing.align(similar, PAIR)


def within_work(a: DataFrame, b: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """a and b; a page that would take more than ``most`` comparisons can't be read without an error."""
    over = matching.page_work(a, b, key, most).filter("exceeded").select(*key, F.col("comparisons").cast("string").alias("_n"))
    stopped = F.when(F.col("_n").isNotNull(), failing(Code.LIMIT, F.concat(F.col("_n"), F.lit(" comparisons on a page")))).otherwise("")
    checked = lambda rows: rows.join(over, key, "left").withColumn("_n", stopped).filter("_n = ''").drop("_n")
    return checked(a), checked(b)


def registered(matched: DataFrame, renders: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(PAGES, method, registration, accepted, m0 .. m5) of matched pages, and their images (PAGES, width, height, pixels_a, pixels_b).

    renders: (pid, page_number, width, height, pixels: grey bytes). Where an image is missing or the registration is
    rejected, the pages lie on each other and nothing is known of how well.
    """
    still = [F.lit(float(v)).alias(f"m{k}") for k, v in enumerate(raster.STILL)]
    if renders is None:
        return matched.select(*PAGES, F.lit("none").alias("method"), F.lit(0.0).alias("registration"), F.lit(False).alias("accepted"), *still), None
    side = lambda s: renders.select(F.col("pid").alias(f"pid_{s}"), F.col("page_number").alias(f"page_{s}"), F.col("width").alias(f"width_{s}"), F.col("height").alias(f"height_{s}"), F.col("pixels").alias(f"pixels_{s}"))
    images = matched.select(*PAGES).join(side("a"), ["pid_a", "page_a"]).join(side("b"), ["pid_b", "page_b"]).filter("width_a = width_b AND height_a = height_b")
    images = images.select(*PAGES, F.col("width_a").alias("width"), F.col("height_a").alias("height"), "pixels_a", "pixels_b")
    found = raster.page_registrations(images, PAGES)
    pixels = [F.col(f"p{k}") for k in range(6)]
    fine = F.col("accepted") & geometry.plausible(pixels, F.lit(0.0), 1.0)
    unit = geometry.pixel_affine(pixels, F.col("width"), F.col("height"))
    found = found.select(*PAGES, "method", F.col("confidence").alias("registration"), fine.alias("accepted"), *[F.when(fine, v).otherwise(F.lit(float(s))).alias(f"m{k}") for k, (v, s) in enumerate(zip(unit, raster.STILL))], *[F.col(f"p{k}") for k in range(6)])
    out = matched.select(*PAGES).join(found.drop(*[f"p{k}" for k in range(6)]), PAGES, "left")
    default = {"method": F.lit("none"), "registration": F.lit(0.0), "accepted": F.lit(False)} | {f"m{k}": F.lit(float(v)) for k, v in enumerate(raster.STILL)}
    return out.select(*PAGES, *[F.coalesce(F.col(c), v).alias(c) for c, v in default.items()]), images.join(found.filter("accepted").select(*PAGES, *[f"p{k}" for k in range(6)]), PAGES)


def run_pairs(
    pairs: DataFrame,
    rows: DataFrame,
    config: str = "default",
    mode: str = "warn",
    registry: DataFrame | None = None,
    pages: DataFrame | None = None,
    renders: DataFrame | None = None,
    page_work: int = PAGE_WORK,
) -> dict[str, DataFrame]:
    """Everything about pairs (pid_a, pid_b, underlying_a/b, title_a/b, optionally label_a/b; with a registry, the ids alone).

    rows: (pid, page_number, raw_text, box, optionally extraction_confidence) of all revisions. Each pair is handled by
    itself, so thousands are one job: compatibility, pages aligned, images registered, elements matched and classified,
    what the images show beside that, counts, warnings, fingerprints and the records to search.
    """
    pairs = looked_up(pairs, registry) if registry is not None else pairs
    built = stored(elements.build(rows, F.col("pid")), "elements")
    signed = pairing.signature(built, "pid")
    named = lambda s: signed.select(F.col("pid").alias(f"pid_{s}"), F.col("tokens").alias(f"tokens_{s}"), F.col("equipment").alias(f"equipment_{s}"))
    assessed = pairing.enforce(pairing.assess(pairs.join(named("a"), "pid_a").join(named("b"), "pid_b"), COMPATIBLE), mode)

    assessed, sheets = stored(assessed, "compatibility"), stored(described_pages(built, pages), "pages")
    matched = stored(aligned(pairs, sheets), "alignment")
    registration, images = registered(matched, renders)
    registration = stored(registration, "registration")
    laid = registration.join(assessed.select(*PAIR, F.col("score").alias("pair")), PAIR)

    def side(s: str) -> DataFrame:
        own = built.withColumnRenamed("pid", f"pid_{s}").withColumnRenamed("page_number", f"page_{s}").join(matched.select(*PAGES), [f"pid_{s}", f"page_{s}"])
        return matching.semantic(own, *PAGES)

    ours, theirs = within_work(side("a"), side("b"), PAGES, page_work)
    ids = (F.col("pid_a"), F.col("pid_b"))
    sure = laid.select(*PAGES, "registration", "pair", *[f"m{k}" for k in range(6)])
    found = changes.compared(ours, theirs, PAGES, *ids, pages=sure, page_a="page_a", page_b="page_b")

    everything = [found["changes"], *unmatched_pages(pairs, sheets, matched, ids)]
    peers = None
    if images is not None:
        left = residual.unexplained(raster.page_residuals(images, PAGES), found["explained"], PAGES)
        shown = residual.reported(left, PAGES).withColumn("place", F.row_number().over(Window.partitionBy(*PAGES).orderBy(F.desc("area"), *residual.BOX, "change_type")) - 1)
        peers = shown.groupBy(*PAIR).agg(F.sum("suppressed_peers").alias("n"))
        everything.append(changes.residual_changes(shown.join(sure, PAGES), PAGES, *ids, F.col("registration"), F.col("pair"), "page_b"))
    whole = stored(changes.union(everything).withColumn("page_number", F.coalesce("page_b", "page_a")), "changes")

    quiet = found["suppressed"].groupBy(*PAIR).agg(F.sum("n").alias("n"))
    quiet = (quiet if peers is None else quiet.unionByName(peers)).groupBy(*PAIR).agg(F.sum("n").alias("suppressed"))
    counts = summarised(pairs, whole, quiet, assessed)
    prints = changes.fingerprint(whole, *ids, config, *PAIR)
    return {
        "elements": built,
        "pages": sheets,
        "compatibility": assessed,
        "alignment": matched,
        "registration": registration,
        "matches": found["matches"],
        "changes": whole,
        "summary": counts,
        "warnings": warnings(assessed, registration),
        "fingerprints": prints,
        "records": records(pairs, built, sheets, whole, prints, counts),
    }


def unmatched_pages(pairs: DataFrame, sheets: DataFrame, matched: DataFrame, ids: tuple[Column, Column]) -> list[DataFrame]:
    """A change for each page of a and of b that has no page of the other."""
    out = []
    for side, other, kind in (("a", "b", "removed"), ("b", "a", "added")):
        own = pairs.select(*PAIR).join(sheets.select(F.col("pid").alias(f"pid_{side}"), F.col("page_number").alias(f"page_{side}")), f"pid_{side}")
        alone = own.join(matched.select(*PAIR, f"page_{side}"), [*PAIR, f"page_{side}"], "left_anti")
        alone = alone.withColumn(f"page_{other}", F.lit(None).cast(sheets.schema["page_number"].dataType))
        out.append(changes.whole_pages(alone, PAGES, kind, *ids, page=f"page_{side}"))
    return out


def summarised(pairs: DataFrame, whole: DataFrame, quiet: DataFrame, assessed: DataFrame) -> DataFrame:
    """(PAIR, total_changes, by_change_type, by_confidence_band, suppressed, cross_document) of each pair."""

    def counted(column: str, name: str) -> DataFrame:
        own = whole.groupBy(*PAIR, column).agg(F.count(F.lit(1)).alias("n"))
        return own.groupBy(*PAIR).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name), F.sum("n").alias("total_changes"))

    none = F.create_map().cast("map<string,bigint>")
    out = pairs.select(*PAIR).join(counted("change_type", "by_change_type"), PAIR, "left").join(counted("confidence_band", "by_confidence_band").drop("total_changes"), PAIR, "left")
    out = out.join(quiet, PAIR, "left").join(assessed.select(*PAIR, (~F.col("compatible")).alias("cross_document")), PAIR, "left")
    return out.select(*PAIR, F.coalesce("total_changes", F.lit(0)).alias("total_changes"), F.coalesce("by_change_type", none).alias("by_change_type"), F.coalesce("by_confidence_band", none).alias("by_confidence_band"), F.coalesce("suppressed", F.lit(0)).alias("suppressed"), F.coalesce("cross_document", F.lit(False)).alias("cross_document"))


def warnings(assessed: DataFrame, registration: DataFrame) -> DataFrame:
    """(PAIR, warning): why a pair isn't plausible, and pages whose images don't lie on each other."""
    reasons = assessed.filter(~F.col("compatible")).select(*PAIR, F.explode("reasons").alias("r")).select(*PAIR, F.concat(F.lit("pair_mismatch: "), "r").alias("warning"))
    lost = registration.filter(~F.col("accepted")).select(*PAIR, F.concat(F.lit("page "), F.col("page_b").cast("string"), F.when(F.col("method") == "none", ": registration not run").otherwise(": registration rejected")).alias("warning"))
    return reasons.unionByName(lost)


def records(pairs: DataFrame, built: DataFrame, sheets: DataFrame, whole: DataFrame, prints: DataFrame, counts: DataFrame) -> DataFrame:
    """(PAIR, the columns of retrieval.RECORD): both revisions, the changes with the identifiers around them, and the summary, each id once."""

    def of(side: str) -> DataFrame:
        own = pairs.select(*PAIR)
        rows = own.join(built.withColumnRenamed("pid", f"pid_{side}"), f"pid_{side}")
        texts = own.join(sheets.withColumnRenamed("pid", f"pid_{side}"), f"pid_{side}")
        return retrieval.records(rows.dropDuplicates([*PAIR, "page_number", "element_id"]), texts, f"rev_{side}", PAIR)

    around = []
    placed = whole.filter(F.col("x0").isNotNull())
    for side in "ab":
        asked = placed.filter(F.col(f"page_{side}").isNotNull()).select(*PAIR, F.col(f"page_{side}").alias("page_number"), F.col("delta_item_id").alias("change_id"), *changes.BOX)
        named = pairs.select(*PAIR).join(built.withColumnRenamed("pid", f"pid_{side}"), f"pid_{side}")
        around.append(retrieval.nearby_identifiers(asked.dropDuplicates([*PAIR, "page_number", "change_id"]), named, [*PAIR, "page_number"]).select(*PAIR, "change_id", "nearby"))
    nearby = around[0].unionByName(around[1]).groupBy(*PAIR, F.col("change_id").alias("delta_item_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("nearby")))).alias("nearby"))
    told = retrieval.change_records(whole.dropDuplicates([*PAIR, "delta_item_id"]).join(nearby, [*PAIR, "delta_item_id"], "left"), PAIR)
    lines = retrieval.summary_records(counts.join(prints.select(*PAIR, "delta_id"), PAIR, "left"), PAIR)
    return elements.require_unique(changes.union([of("a"), of("b"), told, lines]), *PAIR, "source_id")
