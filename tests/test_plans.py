import numpy as np
import pytest
from pyspark.sql import functions as F

from plandrift.operators import elements, pairing, raster
from plandrift.plans import ask, compare, evaluate

W, H = 1191, 842
SAME = [
    ("26-KA-901", 510, 360), ("COMPRESSOR", 500, 380), ('4"-PG-1001-A1', 200, 355), ("26-PIT-9062", 278, 304), ("H 230", 250, 265), ("DUTY TABLE", 90, 640), ("Service: Gas Lift", 90, 660),
    ("Motor: 250 kW", 90, 700), ("NOTE 10: See package datasheet", 400, 700), ("NOTE 11: Relief design per API", 400, 720), ("HV-101", 390, 415),
]
ONLY_A = [("HH 245", 250, 250), ("Duty: 12000 Nm3/h", 90, 680), ('4"-PG-1002-A1', 700, 355), ("26-PT-9070", 760, 300), ("REV: A", 891, 762)]
ONLY_B = [("HH 250", 250, 250), ("Duty: 12500 Nm3/h", 90, 680), ("NOTE 12: Added for startup interlock", 400, 740), ("26-PT-9070", 860, 300), ("HV-205", 830, 505), ("REV: B", 891, 762)]


def rows(spark):
    at = lambda pid, t, x, y: (pid, 1, t, x / W, (y - 8) / H, (x + 5.5 * len(t)) / W, (y + 2) / H)
    found = [at(p, *e) for p, own in (("A", ONLY_A), ("B", ONLY_B)) for e in SAME + own]
    return spark.createDataFrame(found, "pid string, page_number int, raw_text string, x0 double, y0 double, x1 double, y1 double")


@pytest.fixture(scope="module")
def run(spark):
    pairs = spark.createDataFrame([("A", "B", "DOC", "DOC", "lift", "lift")], "pid_a string, pid_b string, underlying_a string, underlying_b string, title_a string, title_b string")
    return compare.run_pairs(pairs, rows(spark))


def test_primary_pair(run):
    got = {(r["change_type"], r["before"], r["after"]) for r in run["changes"].collect()}
    assert ("modified", "HH 245", "HH 250") in got and ("modified", "Duty: 12000 Nm3/h", "Duty: 12500 Nm3/h") in got
    assert ("added", None, "NOTE 12: Added for startup interlock") in got and ("moved", "26-PT-9070", "26-PT-9070") in got
    assert any(c == "removed" and b == '4"-PG-1002-A1' for c, b, _ in got) or any('4"-PG-1002-A1' == b for _, b, _ in got)
    assert not any("REV:" in (b or "") + (a or "") for _, b, a in got)
    assert run["compatibility"].first()["compatible"] and run["fingerprints"].count() == 1


def test_unrelated_pair(spark):
    found = spark.createDataFrame([("D1", "D2", ["A", "B", "C", "D"], ["A", "B", "X", "Y"], ["26-KA-901"], ["27-KA-1"], "gas lift one two", "gas lift three four")], "underlying_a string, underlying_b string, tokens_a array<string>, tokens_b array<string>, equipment_a array<string>, equipment_b array<string>, title_a string, title_b string")
    r = pairing.enforce(pairing.assess(found)).first()
    assert r["score"] == pytest.approx(0.2) and not r["compatible"] and r["action"] == "continue_with_warning"
    with pytest.raises(Exception, match="pair_mismatch"):
        pairing.enforce(pairing.assess(found), "strict").collect()


def test_ask(spark, run):
    sheet = run["elements"]
    record = lambda p, family: sheet.filter(F.col("pid") == p).select(F.concat(F.lit(f"{p}:p1:"), F.col("element_id")).alias("source_id"), F.lit(family).alias("source_family"), F.col("normalized_text").alias("text"), "identifiers", "x0", "y0", "x1", "y1")
    near = [("D:near", "delta", "Modified setpoint HH 245 to HH 250", 250, 250), ("D:far", "delta", "Modified 26-PIT-9062 neighbour elsewhere", 1000, 800)]
    delta = spark.createDataFrame([(i, f, t, [], x / W, y / H, x / W, y / H) for i, f, t, x, y in near], "source_id string, source_family string, text string, identifiers array<string>, x0 double, y0 double, x1 double, y1 double")
    records = record("A", "rev_a").unionByName(record("B", "rev_b")).unionByName(delta)
    asked = spark.createDataFrame([(1, "what is the duty value in revision B?"), (2, "what is the duty value in revision C?"), (3, "who painted the ceiling yesterday evening?"), (4, "What changed near 26-PIT-9062?")], "qid long, text string")
    got = {r["qid"]: r for r in ask.answer(asked, records).collect()}
    assert "12500" in got[1]["answer"] and got[1]["cited"][0].startswith("B:") and not got[1]["unsupported"]
    assert got[2]["reason"] == "revision_out_of_scope" and "revision C is not part" in got[2]["answer"]
    assert got[3]["unsupported"] and got[3]["cited"] == []
    ranked = {r["source_id"]: r["position"] for r in ask.search(asked.filter("qid = 4"), records, 30).collect()}
    assert ranked["D:near"] < ranked["D:far"] or ranked["D:near"] <= 8


def test_scorecard(spark):
    box = [0.1, 0.1, 0.2, 0.2]
    cols = lambda s: f"case string, {'p_id' if s == 'p' else 'g_id'} string, change_type string, {s}_entity_type string, {s}_before string, {s}_after string, {s}_x0 double, {s}_y0 double, {s}_x1 double, {s}_y1 double"
    found = spark.createDataFrame([("c", "1", "modified", "table_cell", "HH 245", "HH 250", *box), ("c", "2", "added", "note", None, "NOTE 9", 0.8, 0.8, 0.9, 0.9)], cols("p"))
    truth = spark.createDataFrame([("c", "x", "modified", "table_cell", "HH 245", "HH 250", *box), ("c", "y", "removed", "note", "NOTE 1", None, *box)], cols("g"))
    answered = spark.createDataFrame([(1, "it is 250.", False, ["B:1"], ["HH 250"], ["250"], False, ["B:"]), (2, "12500", False, ["A:1"], ["Duty 12500"], ["250"], False, ["B:"]), (3, "no", True, [], [], [], True, [])], "qid long, answer string, unsupported boolean, cited array<string>, quotes array<string>, facts array<string>, expect_unsupported boolean, prefixes array<string>")
    card = evaluate.scorecard(found, truth, answered, spark.createDataFrame([("delta_f1", 0.4), ("citation_precision", 0.9)], "metric string, gate double"))
    case = card["cases"].first()
    assert (case["tp"], case["fp"], case["fn"]) == (1, 1, 1) and case["f1"] == pytest.approx(0.5)
    values = {r["metric"]: r["value"] for r in card["metrics"].collect()}
    assert values["chat_fact_accuracy"] == pytest.approx(2 / 3) and values["citation_groundedness"] == pytest.approx(2 / 3) and values["unsupported_refusal_accuracy"] == 1
    assert {r["metric"]: r["passed"] for r in card["gates"].collect()} == {"delta_f1": True, "citation_precision": False}
    assert card["all_gates"].first().asDict() == {"all_gates_passed": False, "failed": ["citation_precision"]}
    assert sorted((r["kind"], r["subject"]) for r in card["failures"].collect()) == [("chat_fact_miss", "all/2"), ("citation_not_grounded", "all/2"), ("delta_false_positive", "c"), ("delta_missed_change", "c")]
    summary = evaluate.summary(card, "cfg", "set")
    assert summary["gates"] == {"delta_f1": True, "citation_precision": False} and summary["dataset_hash"] == "set"
    assert "- citation_precision: **failed**" in evaluate.markdown(card)


def picture(*squares):
    a = np.full((160, 160), 255, np.uint8)
    for x, y in squares:
        a[y : y + 41, x : x + 41] = 0
    return a


def test_raster(spark):
    base = picture((20, 20))
    assert [r["change_type"] for r in raster.residuals(base, picture((20, 20), (90, 90)))] == ["added"]
    assert [r["change_type"] for r in raster.residuals(picture((20, 20), (90, 90)), base)] == ["removed"]
    rng = np.random.default_rng(1)
    a = np.where(rng.random((160, 160)) < 0.1, 0, 255).astype(np.uint8)
    got = raster.registration(a, raster.moved(a, 7, 4))
    assert got["matrix"] == (1, 0, 7, 0, 1, 4) and got["accepted"]
    angle, scale = np.radians(3), 1.0
    turn = (np.cos(angle), -np.sin(angle), 5.0, np.sin(angle), np.cos(angle), -3.0)
    blots = picture((20, 20), (100, 40), (60, 100))
    got = raster.registration(blots, raster.warped(blots, turn))
    assert got["method"] == "log_polar" and got["confidence"] > 0.85 and np.allclose(got["matrix"], turn, atol=1.5)
    assert raster.registration(picture(), base)["method"] == "none"
    pages = spark.createDataFrame([(1, 160, 160, bytearray(base.tobytes()), bytearray(picture((20, 20), (90, 90)).tobytes()))], "page_number long, width int, height int, pixels_a binary, pixels_b binary")
    found = raster.page_registrations(pages, ["page_number"])
    assert found.first()["method"] == "identity" and found.first()["accepted"]
    rows_ = raster.page_residuals(pages.join(found.drop("width", "height"), "page_number"), ["page_number"]).collect()
    assert len(rows_) == 1 and rows_[0]["change_type"] == "added" and rows_[0]["area"] == 41 * 41


def test_scan_preparation():
    level = np.full((200, 300), 255, np.uint8)
    level[20:190:12, 30:270] = 0
    angle = np.radians(4)
    skewed = raster.warped(level, (np.cos(angle), -np.sin(angle), 5, np.sin(angle), np.cos(angle), -8))
    sharp = lambda a: float((((a < 128).sum(axis=1)) ** 2).sum())
    assert sharp(raster.deskewed(skewed)) > 3 * sharp(skewed) and (raster.deskewed(level) == level).all()
    dull = np.random.default_rng(1).integers(100, 140, (100, 120)).astype(np.uint8)
    assert raster.equalised(dull).std() > 1.5 * dull.std()


def test_limits(spark):
    own = spark.createDataFrame([("a", 1, "x" * 10), ("a", 1, "y")], "doc string, page int, raw_text string")
    pages = spark.createDataFrame([("a", 1, "text")], "doc string, page int, page_text string")
    assert elements.limits(own, pages, "doc").first()["exceeded"] == ""
    with pytest.raises(Exception, match="resource_limit"):
        elements.enforce(elements.limits(own, pages, "doc", {"element_chars": 5})).collect()


def test_retrieval_checks_by_letters_as_in_sql(spark, tmp_path):
    """The question's SSber is not the record's ßber, and its letters stay single."""
    import duckdb

    from plandrift import catalogue

    spark.createDataFrame([(1, 1, "user", "SSber wort und"), (2, 1, "user", "strasse wort")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "Äßber wort und"), (2, "die Strasse wort"), (3, "und sonst")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("conversations", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["retrieval_checks"]).fetchall()
    assert sorted(map(tuple, catalogue.retrieval_checks(spark, str(tmp_path)).collect())) == sorted(want) == [(1001, False), (2001, True)]


def test_capitals_letter_by_letter(spark):
    import duckdb

    from plandrift.functions import text

    letters = "".join(chr(i) for i in range(1, 0x11000) if not 0xD800 <= i <= 0xDFFF)
    got = spark.createDataFrame([(letters,)], "t string").select(text.upper_singly(F.col("t"))).first()[0]
    assert got == duckdb.execute("SELECT upper(?)", [letters]).fetchone()[0]
