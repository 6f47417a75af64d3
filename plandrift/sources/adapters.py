"""Which reader takes a file, and what all readers make: rows of elements, pages and failures.

A reader is a function from (spark, paths) to an ``Ingested``. Readers go by format; formats that need what isn't here (a
converter for binary drawings, an engine for scans) get a failure as a row unless a reader is handed in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ROW, Code, Failure
from . import detect, dxf, pdf

ROWS = "path string, page_number int, raw_text string, x0 double, y0 double, x1 double, y1 double, kind_override string, extraction_confidence double"
PAGES = "path string, page_number int, width double, height double, page_text string"


@dataclass
class Ingested:
    rows: DataFrame
    pages: DataFrame
    failures: DataFrame


Reader = Callable[[SparkSession, list[str]], Ingested]


def _as(rows: DataFrame, schema: str, **defaults: Column) -> DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else defaults.get(n, F.lit(None))).cast(t).alias(n) for n, t in columns])


def native_pdf(spark: SparkSession, paths: list[str]) -> Ingested:
    found = pdf.read_items(spark, paths)
    boxes = found.filter("item = 'rect'").select("path", "page_number", F.lit("").alias("raw_text"), "x0", "y0", "x1", "y1", F.lit("geometry_cluster").alias("kind_override"))
    spans = pdf.spans(found)
    rows = _as(spans, ROWS, extraction_confidence=F.lit(1.0)).unionByName(_as(boxes, ROWS, extraction_confidence=F.lit(1.0)))
    lines = F.array_sort(F.collect_list(F.struct("y0", "x0", "raw_text")))
    texts = spans.groupBy("path", "page_number").agg(F.array_join(F.transform(lines, lambda r: r["raw_text"]), "\n").alias("page_text"))
    return Ingested(rows, _as(pdf.pages(found).join(texts, ["path", "page_number"], "left"), PAGES), pdf.failures(found))


def drawing(spark: SparkSession, paths: list[str]) -> Ingested:
    """Drawing exchange files in ASCII; a file without any entity is one that can't be read."""
    found = dxf.elements(dxf.read_dxf(spark, paths))
    pages = found.select("path").distinct().withColumn("page_number", F.lit(1))
    empty = spark.read.format("binaryFile").load(paths).select("path").join(pages, "path", "left_anti")
    return Ingested(_as(found, ROWS, extraction_confidence=F.lit(1.0)), _as(pages, PAGES), empty.select("path", F.lit(str(Code.CORRUPT)).alias("code"), F.lit("no entity could be read").alias("message")))


READERS: dict[str, Reader] = {"native_pdf": native_pdf, "dxf": drawing}
MISSING = {
    "dwg": "binary drawings need a converter to the exchange format",
    "scanned_pdf": "scans need images of the pages and an engine for their words",
    "too_large": "the file is too large",
    "unsupported": "no reader takes this format",
}


def formats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format) of files: dxf, native_pdf, scanned_pdf, dwg, too_large or unsupported, by their first bytes and, for PDF, their pages."""
    files = spark.read.format("binaryFile").load(paths)
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    named = files.select("path", detect.family(head, F.col("path"), F.col("length")).alias("format"))
    pages = pdf.read_items(spark, paths)
    native = pdf.pages(pages).groupBy("path").agg(F.max((F.col("route") == "native_pdf").cast("int")).alias("native"))
    broken = pdf.failures(pages).select("path", F.lit(1).alias("broken"))
    route = F.when(F.col("format") != "pdf", F.col("format")).when(F.coalesce("native", "broken", F.lit(0)) == 1, "native_pdf").otherwise("scanned_pdf")
    return named.join(native, "path", "left").join(broken, "path", "left").select("path", route.alias("format"))


def ingest(spark: SparkSession, paths: list[str], readers: dict[str, Reader] | None = None, force: str | None = None) -> Ingested:
    """All files through their readers; ``force`` names the reader for all. What no reader takes is among the failures.

    The files' formats, one short row for each file of a request, are collected to choose the readers.
    """
    readers = READERS | (readers or {})
    if force is not None and force not in readers and force not in MISSING:
        raise Failure(Code.CONFIG, f"no such reader: {force}")
    named = formats(spark, paths).withColumn("format", F.lit(force) if force else F.col("format"))
    by: dict[str, list[str]] = {}
    for r in named.collect():
        by.setdefault(r["format"], []).append(r["path"])
    lost = [(p, str(Code.LIMIT if f == "too_large" else Code.UNSUPPORTED), MISSING.get(f, MISSING["unsupported"])) for f, own in by.items() if f not in readers for p in own]
    parts = [readers[f](spark, own) for f, own in by.items() if f in readers]
    failed = spark.createDataFrame(lost, f"path string, {ROW}")
    empty = Ingested(spark.createDataFrame([], ROWS), spark.createDataFrame([], PAGES), failed)
    whole = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in [empty, *parts]])
    return Ingested(whole("rows"), whole("pages"), whole("failures"))


def converted(convert: Callable[[SparkSession, list[str]], list[str]]) -> Reader:
    """A reader of binary drawings by a function that converts files and returns the exchange files' paths; its failure is a row for each file."""

    def reader(spark: SparkSession, paths: list[str]) -> Ingested:
        try:
            return drawing(spark, convert(spark, paths))
        except Exception as e:  # a converter is another's program: whatever it does wrong, the files are told apart by their rows
            failed = spark.createDataFrame([(p, str(Code.UNSUPPORTED), f"not converted: {e}") for p in paths], f"path string, {ROW}")
            return Ingested(spark.createDataFrame([], ROWS), spark.createDataFrame([], PAGES), failed)

    return reader
