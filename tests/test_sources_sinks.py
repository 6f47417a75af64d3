import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plandrift import catalogue
from plandrift.errors import Code, Failure
from plandrift.operators import elements
from plandrift.sinks import logs, report
from plandrift.sources import detect, dxf, registry
from plandrift.streaming import usage


def test_registry(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 one")
    (tmp_path / "registry.json").write_text(json.dumps({"P-B": {"path": "gone.pdf", "revision_label": "B"}, "P-A": {"path": "a.pdf", "underlying_document_id": "DOC"}, "P-X": {"path": "../etc/passwd"}}))
    rows = registry.read_registry(spark, str(tmp_path / "registry.json"))
    assert [r["pid"] for r in rows.collect()] == ["P-A", "P-B", "P-X"]
    got = registry.resolve(rows, str(tmp_path), "P-A").collect()
    assert len(got) == 1 and got[0]["byte_size"] == 12 and got[0]["sha256"] == hashlib.sha256(b"%PDF-1.7 one").hexdigest()
    with pytest.raises(Failure, match="pid_not_found") as caught:
        registry.resolve(rows, str(tmp_path), "P-Z")
    assert caught.value.code is Code.NOT_FOUND
    with pytest.raises(Failure, match="path_escape"):
        registry.resolve(rows, str(tmp_path), "P-X")


def test_detect(spark):
    rows = spark.createDataFrame([("AC1027 x", "a.dwg", 9), ("  0\nSECTION\n", "a.dxf", 9), ("0\nSECTION", "b.dxf", 9), ("%PDF-1.4", "x", 9), ("zzz", "y.PDF", 9), ("zzz", "y.txt", 9), ("%PDF", "x", 1 << 40)], "head string, path string, size long")
    got = [r["f"] for r in rows.select(detect.family(F.col("head"), F.col("path"), F.col("size")).alias("f")).collect()]
    assert got == ["dwg", "dxf", "dxf", "pdf", "pdf", "unsupported", "too_large"]
    routes = spark.createDataFrame([(100, 0, 0.0), (10, 30, 0.0), (10, 30, 0.6), (10, 2, 0.0), (100, 0, 0.9)], "t int, v int, c double")
    assert [r["r"] for r in routes.select(detect.pdf_route(F.col("t"), F.col("v"), F.col("c")).alias("r")).collect()] == ["native_pdf", "native_pdf", "scanned_pdf", "scanned_pdf", "native_pdf"]


DRAWING = """0
SECTION
2
ENTITIES
0
LINE
8
PIPE
10
0
20
0
11
100
21
0
0
TEXT
8
TAGS
10
10
20
50
40
2.5
1
26-PIT-9062
0
CIRCLE
8
PIPE
10
50
20
50
40
nan
0
INSERT
2
VALVE
10
80
20
80
0
ATTRIB
1
HV-101
10
80
20
80
0
SEQEND
0
POLYLINE
8
PIPE
0
VERTEX
10
0
20
0
0
VERTEX
10
20
20
100
0
SEQEND
0
DIMENSION
10
40
20
40
42
12.345
0
ENDSEC
0
EOF
"""


def test_dxf(spark, tmp_path):
    (tmp_path / "one.dxf").write_text(DRAWING)
    rows = dxf.read_dxf(spark, str(tmp_path / "one.dxf"))
    assert [r["dxf_type"] for r in rows.orderBy("at").collect()] == ["LINE", "TEXT", "CIRCLE", "INSERT", "POLYLINE", "DIMENSION"]
    got = {r["dxf_type"]: r for r in elements.build(dxf.elements(rows), F.lit("P")).collect()}
    assert set(got) == {"LINE", "TEXT", "INSERT", "POLYLINE", "DIMENSION"}  # the circle has no finite extent
    assert got["TEXT"]["identifiers"] == ["26-PIT-9062"] and got["INSERT"]["raw_text"] == "VALVE HV-101" and got["DIMENSION"]["raw_text"] == "12.35"
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("x0", "y0", "x1", "y1"))
    assert got["POLYLINE"]["y1"] == 1.0 and got["INSERT"]["kind_override"] == "symbol"
    assert [(r["layer"], r["n"]) for r in dxf.top_layers(rows).orderBy("position").collect()][0] == ("PIPE", 3)


def test_reports(spark, sf, tmp_path):
    found = catalogue.true_changes(spark, sf)
    text = report.markdown(found, "page_number").orderBy("page_number").first()["markdown"]
    assert text.startswith("# Change report") and "## Low-confidence review queue" in text
    html = report.html(found.withColumn("description", F.lit("<script>alert(1)</script>")), "page_number").first()["html"]
    assert "<script>" not in html and "&lt;script&gt;" in html
    boxes = report.annotations(found)
    assert boxes.filter("change_type = 'removed' AND NOT dashed").isEmpty() if "change_type" in boxes.columns else boxes.filter("dashed AND label NOT LIKE '%removed'").isEmpty()
    assert report.svg(boxes).first()["svg"].startswith("<svg")
    report.write_reports(found.filter("page_number < 50"), str(tmp_path / "out"), "page_number")
    first = json.loads(spark.read.text(str(tmp_path / "out/json")).first()[0])
    assert list(first) == sorted(first)


def test_logs_and_stream(spark, tmp_path):
    calls = spark.createDataFrame([("x", "m", 5, None, "ok", "secret"), ("x", "m", 7, 0.5, "ok", "secret"), ("y", "m", None, None, "ok", None)], "provider string, model string, tokens long, cost double, status string, prompt string")
    logs.append(calls, str(tmp_path / "log"), "prompt")
    logs.append(calls, str(tmp_path / "log"), "prompt")
    assert "secret" not in "".join(r[0] for r in spark.read.text(str(tmp_path / "log")).collect())
    running = usage.start(usage.calls(spark, str(tmp_path / "log")), "running_usage", str(tmp_path / "cp"))
    running.awaitTermination(120)
    got = {r["provider"]: (r["llm_calls"], r["total_tokens"], r["total_cost"], r["cost_status"]) for r in spark.table("running_usage").collect()}
    assert got == {"x": (4, 24, 1.0, "estimated"), "y": (2, 0, None, "unavailable")}
    whole = {r["provider"]: r["total_tokens"] for r in usage.totals(spark.read.schema(usage.CALLS).json(str(tmp_path / "log"))).collect()}
    assert whole == {"x": 24, "y": 0}
