"""Native PDF files without a library: text spans, rectangles, strokes and image areas of each page.

Objects are found by their ``obj`` marks and in object streams, not by the cross-reference table, so a damaged table does
no harm. Streams may be plain or Flate-coded. Text is decoded by a font's ToUnicode map, else as Latin-1. What needs more
(encrypted files, other codings of content, scans) is told apart: such a file gives one row with an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Code
from . import detect

ITEMS = "path string, page_number int, width double, height double, at int, item string, raw_text string, size double, x0 double, y0 double, x1 double, y1 double, code string, message string"
#: Spans on one line closer than this share of their size are one element.
JOIN = 0.35
_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\x00\t\n\x0c\r ]*>|\(|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
# What a backslash makes of the character after it
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """/Name"""


class Operator(str):
    """A word that is no value."""


class Ref(int):
    """The number of another object."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after the bracket at ``at``, and the place after it."""
    out, depth, k = bytearray(), 1, at
    while k < len(data):
        c = data[k : k + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, k + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                k = octal.end()
                continue
            follower = data[k + 1 : k + 2]
            out += b"" if follower in (b"\n", b"\r") else _ESCAPES.get(follower, follower)
            k += 2
            continue
        depth += (c == b"(") - (c == b")")
        k += 1
        if not depth:
            break
        out += c
    return bytes(out), k


def values(data: bytes) -> Iterator:
    """The values and operators of a piece of PDF, in order: numbers, bytes, Name, Ref, list, dict, Operator."""
    stack: list[list] = [[]]
    at = 0
    while m := _TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token.startswith(b"%"):
            continue
        if token in (b"[", b"<<"):
            stack.append([])
            continue
        if token in (b"]", b">>"):
            if len(stack) == 1:
                continue
            own = stack.pop()
            value = own if token == b"]" else dict(zip(own[::2], own[1::2]))
        elif token == b"(":
            value, at = _literal(data, at)
        elif token.startswith(b"<"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token.startswith(b"/"):
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), token[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", token):
            value = float(token) if b"." in token else int(token)
        elif token == b"R" and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], int):
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Operator(token.decode("latin-1")))
        stack[-1].append(value)
        if len(stack) == 1 and isinstance(value, Operator):
            yield from stack[0]
            stack[0].clear()
    yield from stack[0]


class File:
    """The objects of a file: number to (value, the bytes of its stream or None)."""

    def __init__(self, content: bytes) -> None:
        if b"/Encrypt" in content:
            raise ValueError("the file is encrypted")
        self.objects: dict[int, tuple] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)(?=\bendobj\b|\d+\s+\d+\s+obj\b|\Z)", content, re.S):
            head, mark, rest = m[2].partition(b"stream")
            value = next(values(head), None)
            stream = None
            if mark and isinstance(value, dict):
                rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
                stream = rest[: rest.rfind(b"endstream")] if b"endstream" in rest else rest
            self.objects[int(m[1])] = (value, stream)
        for value, _ in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                number = next(k for k, v in self.objects.items() if v[0] is value)
                data, first = self.data(Ref(number)), int(self.of(value["First"]))
                heads = [x for x in values(data[:first]) if isinstance(x, int)]
                for name, start in zip(heads[::2], heads[1::2]):
                    self.objects.setdefault(name, (next(values(data[first + start :]), None), None))

    def of(self, value):
        """The value itself, or that of the object it refers to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value), (None, None))[0]
        return None

    def data(self, ref) -> bytes:
        value, stream = self.objects.get(int(ref), (None, None))
        if stream is None:
            return b""
        filters = self.of(value.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if name not in ("FlateDecode", "Fl"):
                raise ValueError(f"content is coded by {name}")
            stream = zlib.decompressobj().decompress(stream)
        return stream

    def pages(self) -> list[dict]:
        """The pages' dictionaries in order, with what they inherit."""
        out: list[dict] = []

        def walk(ref, inherited: dict, depth: int = 0) -> None:
            node = self.of(ref)
            if not isinstance(node, dict) or depth > 64:
                return
            node = inherited | node
            if "Kids" in node:
                own = {k: v for k, v in node.items() if k in ("MediaBox", "Resources", "Rotate")}
                for kid in self.of(node["Kids"]) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(node)

        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("the file has no catalogue")
        walk(root.get("Pages"), {})
        return out

    def unicode_map(self, font: dict) -> dict[int, str] | None:
        if not isinstance(font.get("ToUnicode"), Ref):
            return None
        text = lambda b: b.decode("utf-16-be", "replace")
        out, held = {}, []
        for x in values(self.data(font["ToUnicode"])):
            if not isinstance(x, Operator):
                held.append(x)
                continue
            if x == "endbfchar":
                pairs = [h for h in held if isinstance(h, bytes)]
                out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(pairs[::2], pairs[1::2])}
            elif x == "endbfrange":
                rows = [h for h in held if isinstance(h, (bytes, list))]
                for low, high, to in zip(rows[::3], rows[1::3], rows[2::3]):
                    first = int.from_bytes(low, "big")
                    for k in range(first, min(int.from_bytes(high, "big"), first + 65535) + 1):
                        own = to[k - first] if isinstance(to, list) and k - first < len(to) else to
                        if isinstance(own, bytes):
                            out[k] = text(own) if isinstance(to, list) else text(own)[:-1] + chr(ord(text(own)[-1]) + k - first)
            held = []
        return out


def _times(m: list[float], n: list[float]) -> list[float]:
    """First m, then n, as (a, b, c, d, e, f)."""
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


def _hull(m: list[float], x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    points = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def items(file: File, page: dict) -> Iterator[tuple[str, str, float, tuple]]:
    """(item, text, size, box) of a page in its units: span, rect, stroke, image."""
    resources = file.of(page.get("Resources")) or {}
    fonts = {k: file.of(v) or {} for k, v in (file.of(resources.get("Font")) or {}).items()}
    maps = {k: file.unicode_map(v) for k, v in fonts.items()}
    images = file.of(resources.get("XObject")) or {}
    content = file.of(page.get("Contents"))
    refs = content if isinstance(content, list) else [page["Contents"]] if "Contents" in page else []
    data = b"\n".join(file.data(r) for r in refs if isinstance(r, Ref))
    still = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, saved, tm, line, leading, font, size, at = still, [], still, still, 0.0, "", 1.0, None
    held: list = []

    def shown(code: bytes) -> tuple[str, float]:
        """A string's text and its width in thousandths of the size."""
        own, known = fonts.get(font, {}), maps.get(font)
        wide = own.get("Subtype") == "Type0"
        codes = [int.from_bytes(code[k : k + 2], "big") for k in range(0, len(code) - 1, 2)] if wide else list(code)
        listed, first = file.of(own.get("Widths")) or [], file.of(own.get("FirstChar")) or 0
        width = sum(float(file.of(listed[c - first]) or 0) if 0 <= c - first < len(listed) else 500.0 for c in codes)
        return "".join(known.get(c, "") if known else chr(c) if not wide else "" for c in codes), width

    for x in values(data):
        if not isinstance(x, Operator):
            held.append(x)
            continue
        n = [float(h) for h in held if isinstance(h, (int, float)) and not isinstance(h, bool)]
        if x == "q":
            saved.append(ctm)
        elif x == "Q" and saved:
            ctm = saved.pop()
        elif x == "cm" and len(n) >= 6:
            ctm = _times(n[-6:], ctm)
        elif x == "BT":
            tm = line = still
        elif x == "Tf" and n:
            font, size = next((str(h) for h in held if isinstance(h, Name)), font), n[-1]
        elif x == "TL" and n:
            leading = n[-1]
        elif x == "Tm" and len(n) >= 6:
            tm = line = n[-6:]
        elif x in ("Td", "TD") and len(n) >= 2:
            leading = -n[-1] if x == "TD" else leading
            tm = line = _times([1, 0, 0, 1, n[-2], n[-1]], line)
        elif x == "T*":
            tm = line = _times([1, 0, 0, 1, 0, -leading], line)
        elif x in ("Tj", "TJ", "'", '"') and held:
            if x in ("'", '"'):
                tm = line = _times([1, 0, 0, 1, 0, -leading], line)
            parts = held[-1] if isinstance(held[-1], list) else [held[-1]]
            text, width = "", 0.0
            for part in parts:
                if isinstance(part, bytes):
                    t, w = shown(part)
                    text, width = text + t, width + w
                elif isinstance(part, (int, float)):
                    width -= part
                    text += " " if part < -200 and not text.endswith(" ") else ""
            across = width / 1000 * size
            whole = _times(tm, ctm)
            if text.strip():
                yield "span", text, abs(size) * (whole[2] ** 2 + whole[3] ** 2) ** 0.5, _hull(whole, 0, -0.2 * size, across, 0.8 * size)
            tm = _times([1, 0, 0, 1, across, 0], tm)
        elif x == "re" and len(n) >= 4:
            yield "rect", "", 0.0, _hull(ctm, n[-4], n[-3], n[-4] + n[-2], n[-3] + n[-1])
        elif x == "m" and len(n) >= 2:
            at = n[-2:]
        elif x in ("l", "c", "v", "y") and at and len(n) >= 2:
            yield "stroke", "", 0.0, _hull(ctm, min(at[0], n[-2]), min(at[1], n[-1]), max(at[0], n[-2]), max(at[1], n[-1]))
            at = n[-2:]
        elif x == "Do" and held and isinstance(held[-1], Name):
            if (file.of(images.get(held[-1])) or {}).get("Subtype") == "Image":
                yield "image", "", 0.0, _hull(ctm, 0, 0, 1, 1)
        held = []


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    none = (None,) * 6
    try:
        file = File(content)
        pages = file.pages()
        if not pages:
            raise ValueError("the file has no page")
        for number, page in enumerate(pages, 1):
            box = [float(file.of(v)) for v in file.of(page.get("MediaBox")) or [0, 0, 612, 792]]
            width, height = abs(box[2] - box[0]), abs(box[3] - box[1])
            left, bottom = min(box[0], box[2]), min(box[1], box[3])
            yield path, number, width, height, 0, "page", None, None, 0.0, 0.0, 1.0, 1.0, None, None
            unit = lambda v: min(1.0, max(0.0, v))
            for at, (item, text, size, (x0, y0, x1, y1)) in enumerate(items(file, page), 1):
                place = (unit((x0 - left) / width), unit(1 - (y1 - bottom) / height), unit((x1 - left) / width), unit(1 - (y0 - bottom) / height)) if width and height else (0.0,) * 4
                yield path, number, width, height, at, item, text or None, size, *place, None, None
    except (ValueError, KeyError, TypeError, IndexError, zlib.error, RecursionError) as e:
        yield path, None, None, None, 0, "error", None, *none[:5], str(Code.CORRUPT), str(e) or type(e).__name__


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ITEMS of all files at path; a file that can't be read has one row with code and message."""
    names = [c.split()[0] for c in ITEMS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(_rows(p, bytes(content)), columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ITEMS)


def spans(items_: DataFrame) -> DataFrame:
    """(path, page_number, raw_text, size, box): spans of one line that touch, as one element."""
    from pyspark.sql import Window

    own = items_.filter("item = 'span'").withColumn("_line", F.round(F.col("y1") * F.col("height")))
    order = Window.partitionBy("path", "page_number", "_line").orderBy("x0", "at")
    gap = (F.col("x0") - F.lag("x1").over(order)) * F.col("width") > JOIN * F.col("size")
    parts = own.withColumn("_part", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "at", "raw_text"))), lambda r: r["raw_text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return parts.groupBy("path", "page_number", "_line", "_part").agg(words.alias("raw_text"), F.max("size").alias("size"), *box).drop("_line", "_part")


def pages(items_: DataFrame) -> DataFrame:
    """(path, page_number, width, height, text_chars, vectors, image_coverage, route) of each page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("item").isin(*kind), value)), F.lit(0))
    out = items_.filter("code IS NULL").groupBy("path", "page_number").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), of(["span"], F.length(F.trim("raw_text"))).alias("text_chars"), of(["rect", "stroke"], F.lit(1)).alias("vectors"), F.least(F.lit(1.0), of(["image"], area).cast("double")).alias("image_coverage")
    )
    return out.withColumn("route", detect.pdf_route(F.col("text_chars"), F.col("vectors"), F.col("image_coverage")))


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, page_number, raw_text, box, layer) of the text spans, and of rectangles without text as geometry, of native files."""
    found = read_items(spark, path)
    boxes = found.filter("item = 'rect'").select("path", "page_number", F.lit("").alias("raw_text"), "x0", "y0", "x1", "y1", F.lit("geometry_cluster").alias("kind_override"))
    return spans(found).select("path", "page_number", "raw_text", "x0", "y0", "x1", "y1", F.lit(None).cast("string").alias("kind_override")).unionByName(boxes)


def failures(items_: DataFrame) -> DataFrame:
    """(path, code, message) of files that could not be read."""
    return items_.filter("code IS NOT NULL").select("path", "code", "message")
