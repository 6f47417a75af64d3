"""Known values of the functions."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plandrift.functions import geometry, similarity, text
from plandrift.operators.assignment import best_pairs, weights

KINDS = [
    ("26-PIT-9062", "instrument_tag", ["26-PIT-9062"]),
    ("26-KA-901", "equipment_tag", ["26-KA-901"]),
    ("26-p 101", "equipment_tag", ["26-P101"]),
    ("26PIT9062", "instrument_tag", ["26PIT9062"]),
    ("HH 245", "table_cell", []),
    ("H 230", "table_cell", []),
    ("Duty: 12000 Nm3/h", "table_cell", []),
    ("DUTY TABLE", "table_cell", []),
    ("Service: Gas Lift", "text", []),
    ("HV-205", "text", []),
    ('4"-PG-1001-A1', "text", []),
    ('4"PG-1001-A1', "line_tag", ['4"PG-1001-A1']),
    ("NOTE 10: See package datasheet", "note", ["NOTE10"]),
]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,kind,ids", KINDS)
def test_kinds(spark, raw, kind, ids):
    t = F.lit(raw)
    assert value(spark, text.identifiers(t)) == ids
    assert value(spark, text.kind(t, text.identifiers(t))) == kind


def box(*v):
    return [F.lit(float(x)) for x in v]


def test_geometry(spark):
    assert value(spark, geometry.iou(box(0, 0, 0.5, 0.5), box(0.25, 0.25, 0.75, 0.75))) == pytest.approx(1 / 7)
    assert value(spark, geometry.containment(box(0.330, 0.865, 0.443, 0.881), box(0.396, 0.871, 0.417, 0.880))) > 0.9
    assert value(spark, geometry.containment(box(0, 0, 0.1, 0.1), box(0.1, 0, 0.2, 0.1))) == 0
    assert value(spark, geometry.distance(box(0.1, 0.1, 0.2, 0.15), box(0.11, 0.11, 0.21, 0.16))) == pytest.approx(0.0141421356)


def test_element_id(spark):
    assert value(spark, text.element_id(F.lit("A"), F.lit(1), F.lit("table_cell"), F.lit("HH 245"), *box(0.1, 0.1, 0.2, 0.15))) == "e_b824ee82af11"


@pytest.mark.parametrize("b,label", [((0.1, 0.1, 0.2, 0.15), "A2"), ((0.999,) * 4, "F8"), ((0.0,) * 4, "A1"), ((0.5,) * 4, "D5")])
def test_grid(spark, b, label):
    assert value(spark, text.grid_label(*box(*b), approximate=False)) == label


def test_numbers(spark):
    assert value(spark, text.numbers(F.lit("HH-245 P12 X 3.5"))) == ["245", "2", "3.5"]


def test_ratios(spark):
    rows = spark.createDataFrame([("HH 245", "HH 250"), ("Duty: 12000 Nm3/h", "Duty: 12500 Nm3/h"), ("", "x"), ("a b", "b a c")], "a string, b string")
    got = [tuple(r) for r in rows.select(similarity.ratio(F.col("a"), F.col("b")), similarity.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx((83.3333333, 83.3333333))
    assert got[1] == pytest.approx((94.1176470, 94.1176470))
    assert got[2] == (0.0, 0.0) and got[3][1] == 100.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=70), st.text("abcé ", max_size=70)), min_size=1, max_size=6))
def test_lcs(pairs):
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    want = [table(a, b) for a, b in pairs]
    assert similarity.lcs_many([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert [similarity.lcs(a, b) for a, b in pairs] == want


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment(n, m, rng):
    score = np.array([[rng.choice([0.9, 0.6, 0.5, 0.1, 0.0]) for _ in range(m)] for _ in range(n)])
    i, j = np.nonzero(score)
    chosen = best_pairs(i, j, weights(score[i, j], np.zeros(len(i))))
    assert len(set(i[chosen].tolist())) == len(chosen) == len(set(j[chosen].tolist()))
    s = score if n <= m else score.T
    best = max(sum(s[k, p[k]] for k in range(len(s))) for p in itertools.permutations(range(s.shape[1]), len(s)))
    assert score[i, j][chosen].sum() == pytest.approx(best)


def test_assignment_of_a_large_page():
    """A page of thousands of connected elements is solved without a matrix of all pairs."""
    rng = np.random.default_rng(2)
    i = np.repeat(np.arange(4000), 8)
    j = (i + rng.integers(-20, 20, len(i))) % 4000
    chosen = best_pairs(i, j, weights(np.where(i == j, 0.9, 0.3), rng.integers(0, 9, len(i))))
    assert set(zip(i[chosen].tolist(), j[chosen].tolist())) >= set(zip(i[i == j].tolist(), j[i == j].tolist()))


def test_assignment_of_more_elements_than_the_sql_tries():
    """A page of 16 by 17 elements, as there is one at sf0.1, against the best sum for each set of taken elements."""
    rng = np.random.default_rng(9988)
    score, ties = rng.random((16, 17)).round(2) + 0.01, rng.integers(0, 1 << 16, (16, 17))
    weight = weights(score, ties)
    taken, best = np.arange(1 << 17), np.zeros(1 << 17, np.int64)
    best[1:] = -1
    for own in weight:
        more = best.copy()
        for j, w in enumerate(own):
            free = taken[(taken >> j & 1 == 0) & (best >= 0)]
            more[free | 1 << j] = np.maximum(more[free | 1 << j], best[free] + w)
        best = more
    i, j = (x.ravel() for x in np.indices(score.shape))
    chosen = best_pairs(i, j, weight.ravel())
    assert len(chosen) == 16 and weight.ravel()[chosen].sum() == best.max()


def test_facts(spark):
    cases = [("250", "duty 12500", False), ("12.5", "112.5", False), ("250", "changed to 250.", True), ("NOTE 12", "see NOTE12", True), ("12.5", "12.5, ok", True), ("", "x", True)]
    for fact, body, want in cases:
        assert value(spark, text.fact_present(F.lit(fact), F.lit(body))) is want


def test_escape_and_ids(spark):
    assert value(spark, text.escape_html(F.lit("<script>'&\""))) == "&lt;script&gt;&#x27;&amp;&quot;"
    for raw, want in (("../etc/passwd", False), ("a/b", False), ("", False), ("ok-1_Z", True)):
        assert value(spark, text.valid_request_id(F.lit(raw))) is want


def test_percentile_ranks(spark):
    from plandrift.operators.evaluation import percentiles

    for n, p50 in zip(range(1, 11), (1, 2, 2, 2, 3, 4, 4, 4, 5, 6)):
        rows = spark.range(1, n + 1).select(F.lit("s").alias("k"), F.col("id").cast("double").alias("v"))
        got = percentiles(rows, "k", "v").first()
        assert (got["p50_ms"], got["p95_ms"]) == (p50, n)


def test_confidence(spark):
    from plandrift.operators.changes import band, confidence

    one = lambda *v: value(spark, confidence(F.lit(v[0]), *map(F.lit, v[1:])))
    assert one("removed", 0.75, 1.0, 0.5, 0.5, 1.0, 0.9, 1.0) == pytest.approx(0.96)
    assert one("added", 0.75, 0.0, 0.5, 0.5, 1.0, 0.9, 1.0) == pytest.approx(0.76)
    assert [value(spark, band(F.lit(v))) for v in (0.78, 0.55, 0.5)] == ["high", "medium", "low"]


def test_same_changes_however_dealt(spark, sf):
    from plandrift import catalogue

    seen = set()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted(r[0] for r in catalogue.delta_changes(spark, sf).select("delta_item_id").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 1
