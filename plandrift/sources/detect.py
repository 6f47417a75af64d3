"""Which reader a file goes to, from its first bytes and from what its first pages hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much native text, vectors and image make a native page
TEXT_CHARS, VECTORS, COVERAGE, IMAGE_SHARE, MAX_BYTES = 80, 20, 0.55, 0.5, 104857600


def looks_like_dxf(head: Column) -> Column:
    """Whether the first characters are those of a drawing exchange file, text or binary."""
    start = F.ltrim(F.upper(F.substring(head, 1, 2048)))
    return head.startswith("AutoCAD Binary DXF") | (start.rlike(r"^0\s*\r?\n\s*SECTION") | start.rlike(r"^999\b"))


def family(head: Column, path: Column, size: Column) -> Column:
    """too_large, dwg, dxf, pdf or unsupported."""
    return (
        F.when(size > MAX_BYTES, "too_large")
        .when(head.startswith("AC10"), "dwg")
        .when(looks_like_dxf(head), "dxf")
        .when(head.startswith("%PDF") | F.lower(path).endswith(".pdf"), "pdf")
        .otherwise("unsupported")
    )


def coverage(images: Column, text_chars: Column) -> Column:
    """The share of the pages that images take, at least 0.9 where an image stands with next to no text."""
    share = F.least(F.lit(1.0), IMAGE_SHARE * images)
    return F.when((images > 0) & (text_chars < 40), F.greatest(share, F.lit(0.9))).otherwise(share)


def pdf_route(text_chars: Column, vectors: Column, image_coverage: Column) -> Column:
    readable = (text_chars >= TEXT_CHARS) | (vectors >= VECTORS)
    return F.when(readable & ~((image_coverage >= COVERAGE) & (text_chars < TEXT_CHARS)), "native_pdf").otherwise("scanned_pdf")
