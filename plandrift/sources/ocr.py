"""Scanned pages: images made fit, words recognised by a backend that is handed in, lines and elements from them.

A backend is a name, a probe that says whether it can run, and a function from a grey image to words
(text, confidence, quad: four (x, y) in pixels). No engine is part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Code, Failure
from ..limits import DEFAULTS
from ..operators import ocr, raster

Recognise = Callable[[np.ndarray], list[tuple[str, float, list[tuple[float, float]]]]]


@dataclass(frozen=True)
class Backend:
    name: str
    probe: Callable[[], bool]
    recognise: Recognise
    #: What it returns at once: words or lines.
    granularity: str = "word"


def select_backend(backends: list[Backend], wanted: str = "auto") -> Backend | None:
    """The backend by name, which must be able to run; for "auto" the first that can; for "none" none."""
    if wanted == "none":
        return None
    if wanted == "auto":
        found = next((b for b in backends if b.probe()), None)
        if found is None:
            raise Failure(Code.OCR, "no backend can run")
        return found
    named = next((b for b in backends if b.name == wanted), None)
    if named is None:
        raise Failure(Code.CONFIG, f"no such backend: {wanted}")
    if not named.probe():
        raise Failure(Code.OCR, f"backend {wanted} can't run")
    return named


WORDS = "path string, page_number int, width int, height int, at int, text string, confidence double, quad array<struct<x:double,y:double>>, code string, message string"


def words(pages: DataFrame, backend: Backend, prepare: bool = True) -> DataFrame:
    """WORDS of pages (path, page_number, width, height, pixels: grey bytes, row by row); a page that fails has one row with code and message."""
    names = [c.split()[0] for c in WORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for p in batch.itertuples(index=False):
                key = (p.path, int(p.page_number), int(p.width), int(p.height))
                if p.width * p.height > raster.MAX_PIXELS or p.pixels is None or len(p.pixels) != p.width * p.height:
                    out.append((*key, 0, None, None, None, str(Code.LIMIT), "the image's size is out of bounds"))
                    continue
                image = np.frombuffer(p.pixels, np.uint8).reshape(p.height, p.width)
                try:
                    found = backend.recognise(raster.equalised(raster.deskewed(image)) if prepare else image)
                except Exception as e:  # a backend's own errors are many; the page is told apart by its row
                    out.append((*key, 0, None, None, None, str(Code.OCR), f"{type(e).__name__}: {e}"))
                    continue
                out += [(*key, k, t, float(c), [{"x": float(x), "y": float(y)} for x, y in quad], None, None) for k, (t, c, quad) in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    return pages.select("path", F.col("page_number").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInPandas(run, WORDS)


def lines(found: DataFrame, least: float = 0.4, most: int = DEFAULTS["page_elements"]) -> DataFrame:
    """(path, page_number, raw_text, extraction_confidence, box in the unit square) of sure words (WORDS), joined into lines.
    A page with more words than ``most`` can't be read without an error."""
    page = ["path", "page_number"]
    boxed = found.filter("code IS NULL").withColumn("b", ocr.box_of(F.col("quad")))
    unit = boxed.select(*page, "at", "text", "confidence", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"b.{c}") / F.col("width" if c[0] == "x" else "height"))).alias(c) for c in ("x0", "y0", "x1", "y1")])
    kept = ocr.bounded(ocr.confident(unit, least), page, most)
    split = ocr.split_at_gaps(ocr.rows(kept, page), [*page, "row_no"], 2.0 * (F.col("y1") - F.col("y0")), ["at"])
    return ocr.lines(split, [*page, "row_no"], ["at"]).select(*page, F.col("text").alias("raw_text"), F.col("confidence").alias("extraction_confidence"), "x0", "y0", "x1", "y1")


def failures(found: DataFrame) -> DataFrame:
    return found.filter("code IS NOT NULL").select("path", "code", "message")
