"""Whole comparisons with registry, pages and images; stored runs; the calls of a server; settings; scorecards."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plandrift import settings
from plandrift.errors import Code, Failure
from plandrift.functions import text
from plandrift.operators import evaluation, matching, models, observability
from plandrift.plans import ask, compare, evaluate
from plandrift.service import Service, public, public_error
from plandrift.sinks import report
from plandrift.sinks import runs as sink
from plandrift.sources import runs as source

W, H = 240, 160


def element(pid, page, t, x, y):
    return (pid, page, t, x / W, (y - 8) / H, (x + 5.5 * len(t)) / W, (y + 2) / H)


ROWS = [element(p, page, t, x, y) for p, page, t, x, y in (
    ("A", 1, "26-KA-901", 20, 30), ("B", 1, "26-KA-901", 20, 30), ("A", 1, "HH 245", 20, 60), ("B", 1, "HH 250", 20, 60), ("A", 1, "Duty: 120 kW", 20, 90), ("B", 1, "Duty: 120 kW", 20, 90),
    ("B", 1, "NOTE 12: added interlock", 60, 120), ("A", 2, "cable schedule for pumps", 20, 40), ("A", 2, "26-PT-9070", 20, 80), ("B", 3, "cable schedule for pumps", 20, 40), ("B", 3, "26-PT-9070", 20, 80),
    ("A", 4, "only here and nowhere else at all", 20, 40), ("A", 1, "REV: A", 200, 150), ("B", 1, "REV: B", 200, 150),
)]
SCHEMA = "pid string, page_number int, raw_text string, x0 double, y0 double, x1 double, y1 double"


def picture(*squares):
    a = np.full((H, W), 255, np.uint8)
    a[20:60, 20:60] = 0
    for x, y in squares:
        a[y : y + 30, x : x + 30] = 0
    return bytearray(a.tobytes())


@pytest.fixture(scope="module")
def run(spark):
    pairs = spark.createDataFrame([("A", "B", "DOC", "DOC", "lift", "lift")], "pid_a string, pid_b string, underlying_a string, underlying_b string, title_a string, title_b string")
    pages = spark.createDataFrame([("A", 1, "S1"), ("A", 2, "S2"), ("A", 4, None), ("B", 1, "S1"), ("B", 3, "S2")], "pid string, page_number int, sheet_id string").withColumns({"width": F.lit(240.0), "height": F.lit(160.0), "page_text": F.lit(None).cast("string")})
    renders = spark.createDataFrame([("A", 1, W, H, picture()), ("B", 1, W, H, picture((180, 60)))], "pid string, page_number int, width int, height int, pixels binary")
    return compare.run_pairs(pairs, spark.createDataFrame(ROWS, SCHEMA), pages=pages, renders=renders)


def test_whole_comparison(run):
    assert {(r["page_a"], r["page_b"]) for r in run["alignment"].collect()} == {(1, 1), (2, 3)}
    found = {(r["change_type"], r["entity_type"], r["before"], r["after"]) for r in run["changes"].collect()}
    assert found == {("modified", "table_cell", "HH 245", "HH 250"), ("added", "note", None, "NOTE 12: added interlock"), ("removed", "page", "page 4", None), ("added", "geometry_region", None, "geometry region")}
    one = run["changes"].filter("entity_type = 'table_cell'").first()
    assert one["features"]["match_score"] > 0.5 and one["page_a"] == one["page_b"] == 1 and one["confidence"] == round(one["confidence"], 4)
    assert run["registration"].filter("page_a = 1").first()["accepted"] and not run["registration"].filter("page_a = 2").first()["accepted"]
    total = run["summary"].first()
    assert total["total_changes"] == 4 and total["by_change_type"] == {"added": 2, "modified": 1, "removed": 1} and total["suppressed"] == 5 and not total["cross_document"]
    assert [r["warning"] for r in run["warnings"].collect()] == ["page 3: registration not run"]


def test_records(run):
    got = {r["source_id"]: r for r in run["records"].collect()}
    change = run["changes"].filter("entity_type = 'note'").first()
    record = got[f"D:{change['delta_item_id']}"]
    assert "Nearby identifiers:" not in record["text"] or record["identifiers"]
    assert record["text"].startswith("Added note") and record["change_type"] == "added" and record["source_family"] == "delta"
    assert sum(i.endswith(":summary") for i in got) == 1 and {"A:p1:page_text", "B:p3:page_text"} <= set(got)


def test_work_limit(spark):
    pairs = spark.createDataFrame([("A", "B", "D", "D", "", "")], "pid_a string, pid_b string, underlying_a string, underlying_b string, title_a string, title_b string")
    with pytest.raises(Exception, match="resource_limit"):
        compare.run_pairs(pairs, spark.createDataFrame(ROWS, SCHEMA), page_work=3)["changes"].collect()


def test_unique(spark):
    from plandrift.operators import elements

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "run int, id string")
    assert elements.require_unique(rows, "run", "id").count() == 3
    with pytest.raises(Exception, match="corrupt_document: not unique: 2"):
        elements.require_unique(rows.union(rows.filter("run = 2")), "run", "id").collect()


def test_semantic(spark):
    rows = spark.createDataFrame([(1, "geometry_cluster", ""), (1, "note", "x"), (2, "geometry_cluster", "")], "page int, kind string, normalized_text string")
    assert sorted((r["page"], r["kind"]) for r in matching.semantic(rows, "page").collect()) == [(1, "note"), (2, "geometry_cluster")]


def test_answers(spark, run):
    records = run["records"].drop("pid_a", "pid_b")
    known = run["changes"].drop("pid_a", "pid_b")
    item = known.filter("entity_type = 'note'").first()["delta_item_id"]
    asked = spark.createDataFrame([(1, "list high-confidence changes"), (2, "how many items were added?"), (3, f"what is {item.lower()}?"), (4, "show D-00000000"), (5, "what is the duty in revision C?"), (6, "what changed from HH 245 to HH 250")], "qid long, text string")
    got = {r["qid"]: r for r in ask.answer(asked, records, found=known).collect()}
    assert got[1]["route"] == "deterministic_high_conf" and "Removed page 4." in got[1]["answer"] and len(got[1]["cited"]) <= 10
    assert got[2]["answer"] == "2 items were classified as added." and got[2]["provider"] == "deterministic"
    assert got[3]["answer"].startswith("Added note") and got[3]["cited"] == [f"D:{item}"]
    assert got[4]["route"] != "deterministic_item" and got[5]["reason"] == "revision_out_of_scope"
    assert not got[6]["unsupported"] and "250" in got[6]["answer"] and got[6]["provider"] == "extractive"
    claims = models.fixed('{"answer": "the moon is 99", "citations": ["X:1"]}')
    lost = ask.answer(asked.filter("qid = 6"), records, model=claims).first()
    assert lost["unsupported"] and lost["reason"] == "unknown_citation" and lost["cited"] == []


def test_models(spark):
    prompts = spark.createDataFrame([(1, "Question: what is the duty?\n\nEvidence:\n[A:p1:e] Duty 5 kW\n[B:p1:f] Duty 7 kW\nmore")], "qid long, prompt string")
    found = prompts.select(models.blocks(F.col("prompt")).alias("b")).first()["b"]
    assert [(b["source_id"], b["text"]) for b in found] == [("A:p1:e", "Duty 5 kW"), ("B:p1:f", "Duty 7 kW\nmore")]
    said = json.loads(models.extractive(prompts).first()["content"])
    assert said["answer"] == "Duty 5 kW" and said["citations"] == ["A:p1:e"]
    none = models.hosted(lambda p: p.select("qid", F.lit(None).cast("string").alias("content")))
    assert models.with_fallback(none, models.extractive)(prompts).first()["provider"] == "extractive_fallback"
    read = lambda s: spark.range(1).select(models.read(F.lit(s)).alias("a")).first()["a"].asDict()
    assert read("plain words") == {"answer": "plain words", "citations": [], "confidence": "low", "unsupported": True}
    assert read('{"answer": "x", "citations": ["a"]}') == {"answer": "x", "citations": ["a"], "confidence": "medium", "unsupported": False}
    with pytest.raises(Failure, match="config_error"):
        models.client("oracle")


def test_service(spark, tmp_path):
    registry = {p: {"path": f"{p}.pdf", "underlying_document_id": "DOC", "revision_label": p, "display_name": "lift"} for p in "AB"}
    (tmp_path / "registry.json").write_text(json.dumps(registry))
    service = Service(spark, str(tmp_path), str(tmp_path / "registry.json"), spark.createDataFrame(ROWS, SCHEMA))
    assert [p["pid"] for p in service.pids()] == ["A", "B"] and service.health()["status"] == "ok" and service.runs() == []
    assert service.run_pair("A", "B", run_id="first") == "first"
    got = service.run("first")
    assert got["summary"]["total_changes"] >= 3 and got["pair_compatibility"]["compatible"] and got["paths"]["changes"].startswith("/api/runs/first/")
    assert [(r["request_id"], r["pid_a"], r["mode"]) for r in service.runs()] == [("first", "A", "warn")]
    assert json.loads(service.file("first", "request.json"))["pid_b"] == "B"
    assert service.chat("first", "how many items were added?")["route"] == "deterministic_count"
    for call, code in ((lambda: service.run_pair("A", "Z"), Code.NOT_FOUND), (lambda: service.run_pair("A", "B", run_id="first"), Code.REQUEST_ID), (lambda: service.run("gone"), Code.NOT_FOUND), (lambda: service.file("first", "../../registry.json"), Code.PATH), (lambda: service.run("a/b"), Code.REQUEST_ID)):
        with pytest.raises(Failure) as caught:
            call()
        assert caught.value.code is code
    assert service.eval_latest()["available"] is False


def test_runs_and_scorecards(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "request.json").write_text("{not json")
    (tmp_path / "bad" / "metrics.json").write_text("[1")
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "metrics.json").write_text('{"ingest": 5.0, "delta": 7}')
    assert [(r["request_id"], r["pid_a"]) for r in source.listing(spark, root).collect()] == [("bad", None)]
    assert {(r["stage"], r["value"]) for r in source.metrics(spark, root).collect()} == {("ingest", 5.0), ("delta", 7.0)}
    (tmp_path / "base.json").write_text('{"run_id": "old", "delta_f1": 0.5}')
    assert source.latest_scorecard(spark, root, f"{root}/base.json").first().asDict()["source"] == "baseline"
    sink.store_scorecard(spark, root, "new", {"delta_f1": 0.9}, "# card")
    found = source.latest_scorecard(spark, root, f"{root}/base.json").first()
    assert (found["source"], found["run_id"]) == ("run", "new") and json.loads(found["body"])["summary"]["delta_f1"] == 0.9


def test_scorecards_compared(spark):
    card = lambda f1, gate, p95, asked: json.dumps({"native_delta_f1": f1, "chat_fact_accuracy": True, "gates": {"g": gate}, "budget": {"end_to_end": {"p95_ms": p95}}, "dataset_hash": asked})
    texts = lambda b: spark.createDataFrame([("one", json.dumps({"summary": json.loads(card(0.9, True, 100, "x"))})), ("two", b)], "run string, body string")
    got = evaluation.scorecards_compared(texts(card(0.8, False, 200, "x")), "one", "two")
    status = {r["metric"]: r["status"] for r in got["metrics"].collect()}
    assert status["native_delta_f1"] == "regressed" and status["chat_fact_accuracy"] == "absent"
    assert [r["gate"] for r in got["gates"].collect()] == ["g"] and got["latency"].first()["status"] == "regressed"
    assert got["verdict"].first().asDict() == {"regressions": 3, "dataset_changed": False, "has_regression": True, "not_attributable": False}
    other = evaluation.scorecards_compared(texts(card(0.8, True, 100, "y")), "one", "two")["verdict"].first()
    assert not other["has_regression"] and other["not_attributable"]
    assert "native_delta_f1" in report.comparison_text(got["metrics"]).first()["text"]


def test_statuses_and_dataset(spark, tmp_path):
    cases = spark.createDataFrame([("a", True, None, None), ("b", True, "ocr", None), ("c", False, "cad", None), ("d", True, None, "ocr")], "case string, required boolean, needs string, error string")
    got = {r["case"]: (r["status"], r["failed"]) for r in evaluation.statuses(cases, spark.createDataFrame([("ocr",)], "reader string")).collect()}
    assert got == {"a": ("ok", False), "b": ("ok", False), "c": ("skipped_cad", False), "d": ("error_ocr", True)}
    (tmp_path / "set.json").write_text(json.dumps({"seed": 42, "cases": [{"id": "a", "pid_a": "A", "pid_b": "B", "qa": [{"id": "q", "question": "?", "facts": ["1"]}]}]}))
    found, name = evaluate.read_dataset(spark, str(tmp_path / "set.json"))
    assert found.first()["qa"][0]["facts"] == ["1"] and len(name) == 16


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("matching:\n  min_score: 0.5\n")
    got = settings.load(str(tmp_path / "s.yaml"), {"PLANDRIFT__MATCHING__WEIGHTS__TEXT": "0.3", "PLANDRIFT__OCR__BACKEND": "none", "OTHER": "x"})
    assert got["matching"]["min_score"] == 0.5 and got["matching"]["weights"]["text"] == 0.3 and got["ocr"]["backend"] == "none"
    assert settings.DEFAULTS["matching"]["min_score"] != 0.5 and settings.fingerprint(got) != settings.fingerprint(settings.DEFAULTS)
    for own in ({"PLANDRIFT__MATCHING__NOPE": "1"}, {"PLANDRIFT__MATCHING": "1"}):
        with pytest.raises(Failure, match="config_error"):
            settings.load(None, own)


def test_public(spark):
    assert public({"path": "/x/y", "note": "see /home/me/a.pdf or C:\\data\\b.pdf, ok", "deep": [{"source_uri": 1}], "n": 5}) == {"path": text.REDACTED, "note": f"see {text.REDACTED} or {text.REDACTED}, ok", "deep": [{"source_uri": text.REDACTED}], "n": 5}
    assert public_error(Failure(Code.CORRUPT, "at /srv/files/a.pdf"))["message"] == f"corrupt_document: at {text.REDACTED}"
    row = spark.range(1).select(text.redact_paths(F.lit("see /home/me/a.pdf")).alias("t"), observability.allowed_only(F.create_map(F.lit("size"), F.lit("1"), F.lit("path"), F.lit("/x"))).alias("m"), observability.merged_counters(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))).alias("c")).first()
    assert row["t"] == f"see {text.REDACTED}" and row["m"] == {"size": "1"} and row["c"] == {"a": 3, "b": 3}


def test_traces(spark, tmp_path):
    spans = spark.createDataFrame([("r", "a", None, 0.0, 1.0), ("r", "b", "a", 0.2, 0.5)], "run string, name string, parent string, start double, end double")
    observability.write_trace(spans, str(tmp_path / "t"), "run")
    total = spark.read.json(str(tmp_path / "t/totals")).first()
    assert (total["n_spans"], total["total_ms"], total["top_level_ms"]) == (2, 1300.0, 1000.0)
    counters = spark.createDataFrame([("r", {"x": 1}), ("r", {"x": 2, "y": 5})], "run string, counters map<string,long>")
    observability.write_metrics(counters, spark.createDataFrame([("r", "a", 5.0)], "run string, stage string, latency_ms double"), str(tmp_path / "m"), "run")
    got = spark.read.json(str(tmp_path / "m")).first()
    assert got["counters"].asDict() == {"x": 3, "y": 5} and got["stage_latency_ms"]["a"] == 5.0


def test_reports(spark, run):
    one = report.markdown(run["changes"], *compare.PAIR, compatibility=run["compatibility"], warnings=run["warnings"], summary=run["summary"]).first()["markdown"]
    assert "## Warnings\n\n- page 3: registration not run" in one and "- Suppressed: 5" in one and "(plausible)" in one
    drawn = report.svg(report.annotations(run["changes"]))
    assert "low confidence" in drawn.first()["svg"] and report.previews(drawn, most=1).count() == 1
    pages = spark.createDataFrame([("a.pdf", None), (None, "r.png"), (None, None)], "source_uri string, render_uri string")
    assert [r["base"] for r in report.canvas(pages).collect()] == ["source", "render", "blank"]
    stages = spark.createDataFrame([("ingest", 5, 10.0, 20.0, 30.0), ("delta", 5, 1.0, 2.0, 3.0)], "stage string, sample_size long, p50_ms double, p95_ms double, max_ms double")
    budgets = spark.createDataFrame([("ingest", 15.0)], "stage string, budget_p95_ms double")
    usage = spark.createDataFrame([(3, 100, None)], "llm_calls long, total_tokens long, total_cost double")
    told = report.budget_markdown(stages, usage, budgets).first()["markdown"]
    assert "**no**" in told and "cost: unavailable" in told and "Within all budgets: no" in told
