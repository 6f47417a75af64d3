"""Reports of changes: JSON, Markdown, HTML, and boxes to draw, as rows and as SVG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html

# What a change's box is drawn in; low confidence is grey
COLOURS = {"added": "#00b333", "removed": "#e62626", "modified": "#f2a61a", "moved": "#f2a61a", "moved_modified": "#f2a61a"}
LOW = "#808080"


def write_json(rows: DataFrame, path: str, *without: str) -> None:
    """Rows as JSON lines with their keys in order; without: columns, such as time stamps, to leave out."""
    kept = sorted(c for c in rows.columns if c not in without)
    rows.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def annotations(changes: DataFrame) -> DataFrame:
    """A box for each change with its colour, dash and label."""
    colour = F.when(F.col("confidence_band") == "low", LOW)
    for kind, own in COLOURS.items():
        colour = colour.when(F.col("change_type") == kind, own)
    return changes.filter(F.col("x0").isNotNull()).select(
        "delta_item_id", F.coalesce(F.col("page_number"), F.lit(1)).alias("page"), "x0", "y0", "x1", "y1", colour.otherwise(LOW).alias("colour"), (F.col("change_type") == "removed").alias("dashed"), F.concat_ws(" ", "delta_item_id", "change_type").alias("label")
    )


def svg(boxes: DataFrame, width: int = 1191, height: int = 842) -> DataFrame:
    """(page, svg): a drawing for each page."""
    at = lambda c, n: F.round(F.col(c) * n, 2).cast("string")
    shape = F.concat(
        F.lit('<rect x="'), at("x0", width), F.lit('" y="'), at("y0", height), F.lit('" width="'), F.round((F.col("x1") - F.col("x0")) * width, 2).cast("string"), F.lit('" height="'), F.round((F.col("y1") - F.col("y0")) * height, 2).cast("string"),
        F.lit('" fill="none" stroke="'), F.col("colour"), F.when(F.col("dashed"), '" stroke-dasharray="4 3"/>').otherwise('"/>'), F.lit("<title>"), escape_html(F.col("label")), F.lit("</title>"),
    )
    drawn = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("delta_item_id", shape.alias("s")))), lambda r: r["s"]), "")
    legend = "".join(f'<text x="8" y="{height - 10 - 14 * k}" font-size="11" fill="{colour}">{name}</text>' for k, (name, colour) in enumerate([*COLOURS.items(), ("low confidence", LOW)]))
    return boxes.groupBy("page").agg(drawn.alias("_s")).select("page", F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">'), F.col("_s"), F.lit(f"{legend}</svg>")).alias("svg"))


def _joined(rows: DataFrame, key: list[str], order: list[str], line: Column, name: str, separator: str = "\n") -> DataFrame:
    gathered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(gathered, lambda r: r["_line"]), separator).alias(name))


ORDER = ["page_number", "y0", "x0", "entity_type", "delta_item_id"]


def markdown(changes: DataFrame, *key: str, compatibility: DataFrame | None = None, warnings: DataFrame | None = None, summary: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """(key, markdown): a report for each pair: whether it is plausible, warnings, counts, sure changes, all, those to review, metrics.

    compatibility: (key, score, compatible, reasons). warnings: (key, warning). summary: (key, total_changes, by_change_type,
    by_confidence_band, suppressed). metrics: (key, name, value). A part that isn't given isn't shown.
    """
    short = F.concat(F.lit("- `"), F.col("delta_item_id"), F.lit("` **"), F.col("change_type"), F.lit("** ("), F.col("entity_type"), F.lit("): "), F.col("description"))
    value = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n- {label}: `"), F.col(c), F.lit("`"))).otherwise("")
    whole = F.concat(F.lit("### "), F.col("delta_item_id"), F.lit(" — "), F.col("change_type"), F.lit(" / "), F.col("entity_type"), F.lit("\n- "), F.col("description"), F.lit("\n- Confidence: "), F.round("confidence", 4).cast("string"), F.lit(" ("), F.col("confidence_band"), F.lit(")"), value("Before", "before"), value("After", "after"), F.lit("\n"))
    review = F.concat(F.lit("- `"), F.col("delta_item_id"), F.lit("`: "), F.col("description"))
    keys = list(key)
    out = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(_joined(changes, keys, ORDER, whole, "_all"), keys, "left")
    for band, line, name in (("high", short, "_high"), ("low", review, "_low")):
        out = out.join(_joined(changes.filter(F.col("confidence_band") == band), keys, ORDER, line, name), keys, "left")
    part = lambda title, c: F.concat(F.lit(f"\n\n## {title}\n\n"), F.coalesce(c, F.lit("_None_")))
    parts = [F.lit("# Change report\n\n- Total changes: **"), F.col("n").cast("string"), F.lit("**")]
    if compatibility is not None:
        told = F.concat(F.lit("- Score: "), F.round("score", 4).cast("string"), F.when(F.col("compatible"), " (plausible)").otherwise(" (not plausible)"), F.when(F.size("reasons") > 0, F.concat(F.lit("\n- "), F.array_join("reasons", "\n- "))).otherwise(""))
        out = out.join(compatibility.select(*keys, told.alias("_told")), keys, "left")
        parts.append(part("Pair compatibility", "_told"))
    if warnings is not None:
        out = out.join(_joined(warnings.distinct(), keys, ["warning"], F.concat(F.lit("- "), F.col("warning")), "_warned"), keys, "left")
        parts.append(part("Warnings", "_warned"))
    if summary is not None:
        listed = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ")
        counts = F.concat(F.lit("- By type: "), listed("by_change_type"), F.lit("\n- By confidence: "), listed("by_confidence_band"), F.lit("\n- Suppressed: "), F.col("suppressed").cast("string"))
        out = out.join(summary.select(*keys, counts.alias("_counts")), keys, "left")
        parts.append(part("Summary", "_counts"))
    parts += [part("High-confidence changes", "_high"), part("All changes", "_all"), part("Low-confidence review queue", "_low")]
    if metrics is not None:
        out = out.join(_joined(metrics, keys, ["name"], F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("value").cast("string")), "_metrics"), keys, "left")
        parts.append(part("Metrics", "_metrics"))
    return out.select(*keys, F.concat(*parts, F.lit("\n")).alias("markdown"))


def canvas(pages: DataFrame) -> DataFrame:
    """pages (source_uri, render_uri or null) with base, what a page's boxes are drawn on: source, render or blank."""
    return pages.withColumn("base", F.when(F.col("source_uri").isNotNull(), "source").when(F.col("render_uri").isNotNull(), "render").otherwise("blank"))


#: Pages of a preview, at most.
PREVIEWS = 3


def previews(drawn: DataFrame, *key: str, most: int = PREVIEWS) -> DataFrame:
    """The first pages of ``svg`` of each pair."""
    from pyspark.sql import Window

    order = Window.partitionBy(*key, F.lit(0)).orderBy("page")
    return drawn.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def budget_markdown(stages: DataFrame, usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """One row (markdown): a table of stages (stage, sample_size, p50_ms, p95_ms, max_ms) against budgets (stage, budget_p95_ms), and
    what models cost (llm_calls, total_tokens, total_cost, cost_status)."""
    shown = lambda c: F.coalesce(F.round(c, 2).cast("string"), F.lit("—"))
    fine = F.when(F.col("budget_p95_ms").isNull(), "—").when(F.col("p95_ms") <= F.col("budget_p95_ms"), "yes").otherwise("**no**")
    line = F.concat(F.lit("| "), F.col("stage"), F.lit(" | "), F.col("sample_size").cast("string"), *[x for c in ("p50_ms", "p95_ms", "max_ms", "budget_p95_ms") for x in (F.lit(" | "), shown(c))], F.lit(" | "), fine, F.lit(" |"))
    rows = stages.join(budgets, "stage", "left")
    over = F.count_if(F.coalesce(F.col("p95_ms") > F.col("budget_p95_ms"), F.lit(False)))
    table = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", line.alias("l")))), lambda r: r["l"]), "\n").alias("t"), over.alias("over"))
    total = usage.agg(F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.sum("total_cost").alias("cost"))
    both = table.withColumn("_k", F.lit(0)).join(total.withColumn("_k", F.lit(0)), "_k")
    head = F.lit("## Latency and cost\n\n| Stage | n | p50 ms | p95 ms | max ms | budget p95 | within |\n|---|---:|---:|---:|---:|---:|:--:|\n")
    foot = F.concat(F.lit("\n\nWithin all budgets: "), F.when(F.col("over") == 0, "yes").otherwise("no"), F.lit(". Model calls: "), F.col("calls").cast("string"), F.lit(", tokens: "), F.col("tokens").cast("string"), F.lit(", cost: "), F.coalesce(F.round("cost", 4).cast("string"), F.lit("unavailable")), F.lit(".\n"))
    return both.select(F.concat(head, "t", foot).alias("markdown"))


def comparison_text(rows: DataFrame) -> DataFrame:
    """One row (text): metrics (metric, baseline, current, status), a line for each, in ASCII."""
    shown = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("-"))
    line = F.concat(F.rpad("metric", 32, " "), F.lpad(shown("baseline"), 12, " "), F.lit(" -> "), F.lpad(shown("current"), 12, " "), F.lit("  "), F.col("status"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", line.alias("l")))), lambda r: r["l"]), "\n").alias("text"))


def html(changes: DataFrame, *key: str) -> DataFrame:
    """(key, html): a table for each pair, with every value escaped and texts cut at 80 characters."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    cells = [cell(F.col(c)) for c in ("delta_item_id", "change_type", "entity_type", "confidence_band", "description")] + [cell(F.substring(c, 1, 80)) for c in ("before", "after")]
    rows = _joined(changes, list(key), ORDER, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")), "_rows", "")
    head = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Changes</title></head><body><table><tr>" + "".join(f"<th>{t}</th>" for t in ("Id", "Type", "Entity", "Band", "Description", "Before", "After")) + "</tr>"
    return rows.select(*key, F.concat(F.lit(head), F.col("_rows"), F.lit("</table></body></html>")).alias("html"))


def write_reports(changes: DataFrame, path: str, *key: str) -> None:
    """JSON lines, Markdown and HTML below path."""
    write_json(changes, f"{path}/json")
    markdown(changes, *key).select("markdown").write.mode("overwrite").text(f"{path}/markdown")
    html(changes, *key).select("html").write.mode("overwrite").text(f"{path}/html")
