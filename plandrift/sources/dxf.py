"""Drawing exchange files in ASCII: entities, their extents and texts, and elements in the unit square."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as text_
from ..limits import DEFAULTS

# Entity types by what becomes of them
TEXTS, DIMENSIONS = ("TEXT", "MTEXT", "ATTRIB", "ATTDEF"), ("DIMENSION",)
GEOMETRY = ("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "ELLIPSE", "SPLINE", "SOLID")
ENTITIES = "path string, at int, dxf_type string, layer string, handle string, name string, raw_text string, measurement double, xs array<double>, ys array<double>, height double, width double, radius double, scale_x double, scale_y double, axis_x double, axis_y double"
# The height of text that has none, a character's width as a share of it, and half the size of inserts and dimensions
HEIGHT, CHARACTER, INSERT, DIMENSION = 2.5, 0.62, 2.0, (5.0, 2.0)
_TAGS = {1: "raw_text", 2: "name", 5: "handle", 8: "layer"}
_NUMBERS = {40: "height", 41: "width", 42: "measurement"}


def _entities(path: str, content: bytes) -> Iterator[dict]:
    """The entities of the model space, from pairs of a group code and a value; attributes join their insert's text."""
    lines = content.decode("utf-8", "replace").splitlines()
    section, row, at, polyline = "", None, 0, None
    for code, value in zip(lines[::2], lines[1::2]):
        try:
            code, value = int(code), value.strip()
        except ValueError:
            continue
        if code == 0:
            if row and section == "ENTITIES":
                if row["dxf_type"] == "VERTEX" and polyline is not None:
                    polyline["xs"] += row["xs"][:1]
                    polyline["ys"] += row["ys"][:1]
                elif row["dxf_type"] == "ATTRIB" and polyline is not None and polyline["dxf_type"] == "INSERT":
                    polyline["raw_text"] = " ".join(x for x in (polyline["raw_text"], row["raw_text"]) if x)
                elif row["dxf_type"] not in ("SEQEND", "SECTION"):
                    if polyline is not None:
                        yield polyline
                    polyline = row
            row = dict(path=path, at=at, dxf_type=value, layer="", handle=None, name=None, raw_text="", measurement=None, xs=[], ys=[], height=None, width=None, radius=None, scale_x=None, scale_y=None, axis_x=None, axis_y=None)
            at += 1
            if value == "ENDSEC":
                section = ""
        elif row and row["dxf_type"] == "SECTION" and code == 2:
            section = value
        elif row:
            if code in _TAGS:
                row[_TAGS[code]] = value
            elif code == 3 and row["dxf_type"] == "MTEXT":
                row["raw_text"] += value
            else:
                try:
                    number = float(value)
                except ValueError:
                    continue
                kind = row["dxf_type"]
                if 10 <= code <= 18:
                    (row.__setitem__("axis_x", number) if kind == "ELLIPSE" and code == 11 else row["xs"].append(number))
                elif 20 <= code <= 28:
                    (row.__setitem__("axis_y", number) if kind == "ELLIPSE" and code == 21 else row["ys"].append(number))
                elif code == 40 and kind in ("CIRCLE", "ARC"):
                    row["radius"] = number
                elif kind == "INSERT" and code in (41, 42):
                    row["scale_x" if code == 41 else "scale_y"] = number
                elif code in _NUMBERS:
                    row[_NUMBERS[code]] = number
    if polyline is not None:
        yield polyline


def read_dxf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ENTITIES of the files at path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [e for p, c in zip(batch["path"], batch["content"]) for e in _entities(p, c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ENTITIES)


def extents(entities: DataFrame) -> DataFrame:
    """entities with the box x0, y0, x1, y1 of each in drawing units; those without a finite one are dropped."""
    kind, x, y = F.col("dxf_type"), F.get("xs", F.lit(0)), F.get("ys", F.lit(0))
    h = F.when(F.coalesce("height", F.lit(0.0)) != 0, F.col("height")).otherwise(HEIGHT)
    chars = F.greatest(F.lit(1), F.length("raw_text"))
    span = F.when(F.coalesce("width", F.lit(0.0)) != 0, F.col("width")).otherwise(h * CHARACTER * chars)
    major = F.sqrt(F.col("axis_x") * F.col("axis_x") + F.col("axis_y") * F.col("axis_y"))
    sx, sy = F.abs(F.coalesce(F.nullif("scale_x", F.lit(0.0)), F.lit(1.0))), F.abs(F.coalesce(F.nullif("scale_y", F.lit(0.0)), F.lit(1.0)))
    mid_x, mid_y = F.coalesce(F.get("xs", F.lit(1)), x), F.coalesce(F.get("ys", F.lit(1)), y)
    around = lambda cx, cy, dx, dy: F.array(cx - dx, cy - dy, cx + dx, cy + dy)
    hull = F.array(F.array_min("xs"), F.array_min("ys"), F.array_max("xs"), F.array_max("ys"))
    box = (
        F.when(kind.isin("CIRCLE", "ARC"), around(x, y, F.col("radius"), F.col("radius")))
        .when(kind == "ELLIPSE", around(x, y, major, major))
        .when(kind == "MTEXT", F.array(x, y - h, x + span, y))
        .when(kind.isin(*TEXTS), F.array(x, y, x + h * CHARACTER * chars, y + h))
        .when(kind == "INSERT", around(x, y, INSERT * sx, INSERT * sy))
        .when(kind.isin(*DIMENSIONS), around(mid_x, mid_y, *map(F.lit, DIMENSION)))
        .when(kind.isin(*GEOMETRY), hull)
    )
    out = entities.withColumn("_b", box)
    finite = F.forall("_b", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return out.filter(F.col("_b").isNotNull() & finite).select("*", *[F.get("_b", F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]).drop("_b")


def entity_text() -> F.Column:
    kind, own = F.col("dxf_type"), text_.normalise(F.col("raw_text"))
    plain = text_.normalise(F.regexp_replace(F.regexp_replace("raw_text", r"\\P", " "), r"\\[A-Za-z][^;\\]*;|[{}]", ""))
    override = F.when((own != "") & (own != "<>"), own)
    return F.coalesce(F.when(kind == "MTEXT", plain).when(kind.isin(*TEXTS), own).when(kind.isin(*DIMENSIONS), F.coalesce(override, F.format_string("%.2f", "measurement"))).when(kind == "INSERT", text_.normalise(F.concat_ws(" ", "name", own))), F.lit(""))


def elements(entities: DataFrame, most: int = DEFAULTS["page_elements"]) -> DataFrame:
    """Rows for ``operators.elements.build``: raw_text, kind_override, layer and a box in the unit square from the top left, at most ``most`` a drawing."""
    boxes = extents(entities)
    drawing = Window.partitionBy("path")
    low_x, low_y = F.min("x0").over(drawing), F.min("y0").over(drawing)
    span_x, span_y = F.greatest(F.max("x1").over(drawing) - low_x, F.lit(1e-6)), F.greatest(F.max("y1").over(drawing) - low_y, F.lit(1e-6))
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    placed = boxes.withColumns({"_x0": unit((F.col("x0") - low_x) / span_x), "_x1": unit((F.col("x1") - low_x) / span_x), "_y0": unit(1 - (F.col("y1") - low_y) / span_y), "_y1": unit(1 - (F.col("y0") - low_y) / span_y)})
    kind = F.when(F.col("dxf_type").isin(*DIMENSIONS), "dimension").when(F.col("dxf_type") == "INSERT", "symbol").when(F.col("dxf_type").isin(*GEOMETRY), "geometry_cluster")
    out = placed.select("path", "at", "dxf_type", "layer", F.lit(1).alias("page_number"), entity_text().alias("raw_text"), kind.alias("kind_override"), *[F.col(f"_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    order = Window.partitionBy("path").orderBy("at")
    return out.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def top_layers(entities: DataFrame, most: int = 10) -> DataFrame:
    counted = entities.groupBy("path", "layer").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "first")
    return counted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).drop("first")
