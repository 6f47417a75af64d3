"""Readers of native files, of scans by a backend, and the choice among them."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plandrift.errors import Failure
from plandrift.operators import elements
from plandrift.sources import adapters, ocr, pdf

CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0041> endbfchar 1 beginbfrange <0010> <0012> <0062> endbfrange"


def pdf_bytes(content: bytes, flate: bool = True) -> bytes:
    data = zlib.compress(content) if flate else content
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        4: b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if flate else b"", data),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        7: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(CMAP), CMAP),
    }
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


CONTENT = rb"q 1 0 0 1 10 0 cm BT /F1 10 Tf 20 60 Td (26-PIT-9062) Tj 0 -20 Td [(NO) -10 (TE 12: \(see\) \101)] TJ ET Q 50 10 40 20 re S 0 0 m 10 10 l S BT /F2 8 Tf 1 0 0 1 120 80 Tm <000300100012> Tj ET"


def test_pdf(spark, tmp_path):
    for name, flate in (("a.pdf", True), ("b.pdf", False)):
        (tmp_path / name).write_bytes(pdf_bytes(CONTENT, flate))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "secret.pdf").write_bytes(pdf_bytes(CONTENT).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))
    found = pdf.read_items(spark, str(tmp_path / "*.pdf"))
    got = sorted((r["path"][-5:], r["raw_text"]) for r in pdf.spans(found).collect())
    assert got == [(p, t) for p in ("a.pdf", "b.pdf") for t in ("26-PIT-9062", "Abd", "NOTE 12: (see) A")]
    one = pdf.spans(found).filter("raw_text = '26-PIT-9062'").first()
    assert (one["x0"], one["size"]) == (pytest.approx(30 / 200), 10) and one["y0"] == pytest.approx(1 - 68 / 100) and one["y1"] == pytest.approx(1 - 58 / 100)
    page = pdf.pages(found).first()
    assert (page["width"], page["height"], page["vectors"], page["route"]) == (200, 100, 2, "scanned_pdf")  # 30 characters are few
    assert {r["path"][-10:]: r["code"] for r in pdf.failures(found).collect()} == {"broken.pdf": "corrupt_document", "secret.pdf": "corrupt_document"}
    kinds = {r["raw_text"]: r["kind"] for r in elements.build(pdf.read_elements(spark, str(tmp_path / "a.pdf")), F.lit("P")).collect()}
    assert kinds == {"26-PIT-9062": "instrument_tag", "NOTE 12: (see) A": "note", "Abd": "text", "": "geometry_cluster"}


def test_pdf_object_streams(spark, tmp_path):
    """Objects inside of a compressed stream are found."""
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /MediaBox [0 0 10 10] /Contents 4 0 R >>")]
    heads, body = b"", b""
    for number, value in inner:
        heads += b"%d %d " % (number, len(body))
        body += value + b" "
    data = zlib.compress(heads + body)
    content = b"BT /F1 1 Tf 1 1 Td (deep) Tj ET"
    whole = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n4 0 obj << >>\nstream\n%s\nendstream endobj" % (len(heads), data, content)
    (tmp_path / "c.pdf").write_bytes(whole)
    assert [r["raw_text"] for r in pdf.spans(pdf.read_items(spark, str(tmp_path / "c.pdf"))).collect()] == ["deep"]


def test_ingest(spark, tmp_path):
    long = rb"BT /F1 5 Tf 10 50 Td (" + b"word " * 20 + rb") Tj ET"
    (tmp_path / "text.pdf").write_bytes(pdf_bytes(long))
    (tmp_path / "scan.pdf").write_bytes(pdf_bytes(b"0 0 m"))
    (tmp_path / "old.dwg").write_bytes(b"AC1027 binary")
    (tmp_path / "note.txt").write_bytes(b"hello")
    (tmp_path / "plan.dxf").write_text("0\nSECTION\n2\nENTITIES\n0\nTEXT\n8\nA\n10\n1\n20\n2\n40\n1\n1\nHV-101\n0\nENDSEC\n0\nEOF\n")
    paths = [str(tmp_path / n) for n in ("text.pdf", "scan.pdf", "old.dwg", "note.txt", "plan.dxf")]
    got = adapters.ingest(spark, paths)
    name = lambda p: p.rsplit("/", 1)[1]
    assert {name(r["path"]) for r in got.rows.collect()} == {"text.pdf", "plan.dxf"} == {name(r["path"]) for r in got.pages.collect()}
    assert {name(r["path"]): r["code"] for r in got.failures.collect()} == dict.fromkeys(("scan.pdf", "old.dwg", "note.txt"), "unsupported_format")
    forced = adapters.ingest(spark, paths[2:3], force="dwg")
    assert forced.rows.isEmpty() and "converter" in forced.failures.first()["message"]
    through = adapters.ingest(spark, paths[2:3], {"dwg": adapters.converted(lambda s, own: [paths[4]])})
    assert through.rows.first()["raw_text"] == "HV-101"
    with pytest.raises(Failure, match="config_error"):
        adapters.ingest(spark, paths, force="paper")

    def broken(spark, own):
        raise RuntimeError("no licence")

    assert "no licence" in adapters.ingest(spark, paths[2:3], {"dwg": adapters.converted(broken)}).failures.first()["message"]


def test_scans(spark):
    def recognise(image):
        if image.max() == 0:
            raise ValueError("black")
        box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + 10), (x, y + 10)]
        return [("HH", 92.0, box(10, 20, 20)), ("250", 0.8, box(32, 21, 30)), ("far", 0.9, box(150, 20, 30)), ("faint", 0.1, box(10, 60, 20)), (" ", 0.9, box(10, 80, 20))]

    backend = ocr.Backend("made", lambda: True, recognise)
    image = lambda v: bytearray(np.full((100, 200), v, np.uint8).tobytes())
    pages = spark.createDataFrame([("a", 1, 200, 100, image(255)), ("a", 2, 200, 100, image(0)), ("a", 3, 200, 100, bytearray(b"short"))], "path string, page_number int, width int, height int, pixels binary")
    found = ocr.words(pages, backend, prepare=False)
    got = {r["raw_text"]: r for r in ocr.lines(found).collect()}
    assert set(got) == {"HH 250", "far"} and got["HH 250"]["x0"] == 0.05 and got["HH 250"]["extraction_confidence"] == pytest.approx(0.86)
    assert {r["code"] for r in ocr.failures(found).collect()} == {"ocr_failure", "resource_limit"}
    with pytest.raises(Exception, match="resource_limit"):
        ocr.lines(found, most=2).collect()


def test_backends():
    off, on = ocr.Backend("one", lambda: False, lambda image: []), ocr.Backend("two", lambda: True, lambda image: [])
    assert ocr.select_backend([off, on]).name == "two" and ocr.select_backend([off], "none") is None
    for wanted, code in (("one", "ocr_failure"), ("three", "config_error")):
        with pytest.raises(Failure, match=code):
            ocr.select_backend([off, on], wanted)
    with pytest.raises(Failure, match="ocr_failure"):
        ocr.select_backend([off])
