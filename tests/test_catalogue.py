"""Every query against its SQL, or for rows where SQL can't express it."""

import pytest

from plandrift import catalogue
from tests.conftest import canonical

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck, sf):
    frame = catalogue.queries()[name](spark, sf)
    got = frame.toPandas()
    if name in ORACLES:
        assert canonical(got) == canonical(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_no_cartesian_product(spark, sf):
    from plandrift.operators import matching

    a, b = catalogue.revisions(spark, sf)
    plan = matching.candidates(a, b, ["page_number"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def _ratio(a, b):
    return 200 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _token_set(a, b):
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    joined = lambda x: f"{both} {x}".strip() if both else x
    if both and (not only_a or not only_b):
        return 100.0
    whole = [_ratio(joined(only_a), joined(only_b))]
    return max(whole + ([_ratio(both, joined(only_a)), _ratio(both, joined(only_b))] if both else []))


def test_page_similarity_of_whole_texts(spark):
    """Pages differ after their first words only; 800 characters count."""
    from plandrift.operators import pairing

    rows = [("s1", "s1", 1, 1, "a b c " * 20 + "one two", "a b c " * 20 + "two three four"), ("s1", "s2", 1, 2, "pump valve line", "valve pump other"), (None, None, 1, 1, "", "x"), ("s", "s", 3, 3, "q " * 500 + "end", "q " * 500 + "other end")]
    frame = spark.createDataFrame(rows, "sheet_id_a string, sheet_id_b string, page_number_a int, page_number_b int, page_text_a string, page_text_b string").selectExpr("*", "1191.0D AS width_a", "1191.0D AS width_b", "842.0D AS height_a", "842.0D AS height_b")
    for r in pairing.page_similarity(frame).collect():
        a, b = r["page_text_a"][:800], r["page_text_b"][:800]
        want = 0.35 * (r["sheet_id_a"] is not None and r["sheet_id_a"] == r["sheet_id_b"]) + 0.15 * (r["page_number_a"] == r["page_number_b"]) + 0.15 + (0.35 * _token_set(a, b) / 100 if a and b else 0)
        assert r["similarity"] == pytest.approx(min(1.0, want))


def test_page_align_takes_the_best_page_left(spark, sf):
    from collections import defaultdict

    from plandrift.operators import pairing

    import random

    rng = random.Random(4)
    rows = [(k, a, b, rng.choice([0.1, 0.2, 0.3, 0.5, 0.5, 0.9])) for k in range(30) for a in range(rng.randint(1, 6)) for b in range(rng.randint(1, 6))]
    got = {(r["k"], r["page_a"], r["page_b"]) for r in pairing.align(spark.createDataFrame(rows, "k int, page_a int, page_b int, similarity double"), ["k"]).collect()}
    by, want = defaultdict(list), set()
    for k, a, b, s in rows:
        by[k].append((a, b, s))
    for k, own in by.items():
        used = set()
        for page in sorted({a for a, _, _ in own}):
            left = [(-s, b) for a, b, s in own if a == page and b not in used]
            if left and -min(left)[0] >= 0.25:
                used.add(min(left)[1])
                want.add((k, page, min(left)[1]))
    assert got == want


def test_residuals_against_a_plain_version(spark, sf):
    from collections import defaultdict

    from plandrift.operators import residual

    got = sorted(tuple(r) for r in catalogue.residual_nms(spark, sf).collect())
    rows = catalogue.views.tag_sheet(spark, sf).collect()
    pages, want = defaultdict(list), []
    for r in rows:
        area = int(-(-((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) * 1e6 + r["seq"] - 0.5) // 1))
        pages[r["page_number"]].append((-area, r["x0"], r["y0"], r["x1"], r["y1"], "removed" if r["rev"] == "A" else "added"))

    def iou(p, q):
        w, h = min(p[3], q[3]) - max(p[1], q[1]), min(p[4], q[4]) - max(p[2], q[2])
        size = lambda c: (c[3] - c[1]) * (c[4] - c[2])
        return w * h / (size(p) + size(q) - w * h) if w > 0 and h > 0 else 0.0

    for page, own in pages.items():
        kept = []
        for row in sorted(own):
            if len(kept) < residual.MOST_RESIDUALS and not any(k[5] == row[5] and iou(k, row) > residual.PEER_IOU for k in kept):
                kept.append(row)
        for k, (area, x0, y0, x1, y1, kind) in enumerate(kept[: residual.EMITTED_RESIDUALS]):
            want.append((page, kind, -area, x0, y0, x1, y1, 0 if k else max(0, len(kept) - residual.EMITTED_RESIDUALS)))
    assert got == sorted(want)


def test_ocr_rows_against_a_plain_version(spark, sf):
    from plandrift.operators import ocr

    import random

    rng = random.Random(5)
    words = [(p, k, round(rng.random(), 3), round(rng.random(), 3)) for p in range(12) for k in range(25)]
    frame = spark.createDataFrame([(p, k, x, y, x + 0.05, y + 0.03) for p, k, x, y in words], "page int, k int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["page"], r["k"]): r["row_no"] for r in ocr.rows(frame, ["page"]).collect()}
    want = {}
    for p in range(12):
        rows = []
        for _, k, x, y in sorted((w for w in words if w[0] == p), key=lambda w: (w[3], w[2])):
            low, high = y, y + 0.03
            n = next((n for n, (a, b) in enumerate(rows) if min(b, high) - max(a, low) > 0.5 * min(b - a, high - low)), len(rows))
            rows[n:] = rows[n:] if n < len(rows) else [(low, high)]
            rows[n] = (min(rows[n][0], low), max(rows[n][1], high))
            want[p, k] = n
    assert got == want
