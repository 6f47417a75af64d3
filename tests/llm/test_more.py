"""Cases that went wrong once, and operators against plain versions of their methods."""

from __future__ import annotations

import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from plandrift.llm import compact_windows, decision_list, exact_dedup, language, link_graph, packing, preference, queries, superminhash
from tests.llm.test_operators import JSON_FILE, frame, odd, ODD

LARGE = 9007199254740993


def test_large_ids_beside_missing_ones(spark):
    """Ids that no double holds stay as they are in a batch with a row without one."""
    rows = frame(spark, [(LARGE, "the the the"), (None, "the the the"), (LARGE + 2, "der die und")])
    model = language.train(["the and of " * 5, "der die und " * 5] * 20, ["en", "de"] * 20)
    want = {LARGE, None, LARGE + 2}
    assert {r["doc_id"] for r in language.identify(rows, model).collect()} == want
    assert {r["doc_id"] for r in packing.pack(rows, packing.byte_bpe(JSON_FILE)).collect()} == want
    assert {r["doc_id"] for r in language.accepted(rows, model).collect()} == want


def test_long_urls(spark):
    """A url whose part before :// is ten thousand characters long is split like any other."""
    long = "\U0001f600a" * 5000 + "://Host.example.net/en/x?q#f"
    rows = spark.createDataFrame([(1, long, None), (2, "a:/b//c", None), (3, "x://y://z/p", None), (4, "://h", None)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in link_graph.judge(rows, queries.RULES).collect()}
    assert got == {1: ("host.example.net", "/en/x", "example.net/en/"), 2: ("", "", None), 3: ("y:", "//z/p", None), 4: ("h", "", None)}


def test_link_graph_odd(spark):
    """An empty table, repeated rows, and columns with the operator's own names."""
    schema = "page_id long, url string, html string, trust double, host string, verdict string"
    assert link_graph.judge(spark.createDataFrame([], schema), queries.RULES).collect() == []
    rows = spark.createDataFrame([(1, "http://a.net/x", None, 7.0, "mine", "mine")] * 2 + [(None, None, None, None, None, None)], schema)
    assert sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in link_graph.judge(rows, queries.RULES).collect()) == [(0, "", "allow"), (1, "a.net", "block"), (1, "a.net", "block")]


def test_pagerank_against_a_plain_one(spark):
    rng = random.Random(3)
    hosts = [f"h{k}" for k in range(60)]
    graph = sorted({("allow", rng.choice(hosts), rng.choice(hosts[:40])) for _ in range(150)} | {("allow", f"h{k}", f"h{k + 1}") for k in range(40, 59)})
    graph = [g for g in graph if g[1] != g[2]]
    seeds = [("allow", "h3", 2.0), ("allow", "h40", 1.0)]
    got = {r["host"]: r["score"] for r in link_graph.propagate(spark.createDataFrame(seeds, "kind string, host string, weight double"), spark.createDataFrame(graph, "kind string, source string, target string")).collect()}
    n = {h: k for k, h in enumerate(hosts)}
    move, start = np.zeros((60, 60)), np.zeros(60)
    for _, a, b in graph:
        move[n[b], n[a]] += 1
    out = move.sum(axis=0)
    move[:, out > 0] /= out[out > 0]
    start[n["h3"]], start[n["h40"]] = 2 / 3, 1 / 3
    x = start.copy()
    for _ in range(500):  # what dangling hosts have goes back to the seeds
        x = link_graph.DAMPING * (move @ x + x[out == 0].sum() * start) + (1 - link_graph.DAMPING) * start
    assert sum(abs(got.get(h, 0.0) - x[n[h]]) for h in hosts) < 3 * link_graph.TOLERANCE
    assert x[n["h59"]] > 0 and got["h59"] > 0  # nineteen links from a seed


def test_language_against_a_plain_scorer():
    """Looked-up shares of subwords give what the embeddings and the softmax give."""
    texts, labels = ["the and of it was " * 4, "der die und das ist " * 4, "le la les et une " * 4] * 10, ["en", "de", "fr"] * 10
    model = language.train(texts, labels)
    for t in ("the cat and the dog", "die Katze und der Hund", "le chat et la souris"):
        grams = [g for n in language.GRAMS for g in _grams(t, n)]
        logits = sum(model.weights[g] for g in grams) / len(grams) + model.bias
        e = np.exp(logits / model.temperature - max(logits / model.temperature))
        named, score = model.predict([t])
        assert named == [model.languages[int(e.argmax())]] and score[0] == pytest.approx((e / e.sum()).max())


def _grams(text: str, n: int) -> list[int]:
    raw = (" " + " ".join(text.lower().split()) + " ").encode()
    out = []
    for k in range(len(raw) - n + 1):
        value = sum(raw[k + j] << (8 * j) for j in range(n)) + (n << 40)
        out.append((value * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.HASH_BITS))
    return out


def test_fitting_rows_are_bounded(spark):
    """Rows that share one hash don't all come to the driver, and ties are taken in one order."""
    rows = spark.createDataFrame([(2, "the and of", "en")] * 300 + [(2, "der die und", "de")] * 5, "doc_id long, text string, lang string")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    if rows.isEmpty():
        rows = spark.createDataFrame([(k, "the and of", "en") for k in [5] * 300], "doc_id long, text string, lang string")
    assert len(language.fit(rows, 7).languages) <= 2


def test_decision_list_on_held_back_labels(spark):
    """Fitted on a part of the labels, the list agrees with the others'."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    rules = decision_list.fit(documents.select("doc_id", "text"), labels.filter(part != 0).select("doc_id", "quality"))
    seen = decision_list.judge(documents.select("doc_id", "text"), rules).join(labels.filter(part == 0), "doc_id").filter("NOT base_failed")
    assert seen.count() > 50 and seen.filter("kept <> (quality = 1)").count() <= 0.08 * seen.count()


def test_own_columns_stay(spark):
    """Columns that carry an operator's own names come out as they went in."""
    rows = frame(spark, [(1, "one two three four five six seven eight nine ten eleven"), (2, "x")]).withColumns({"rule": F.lit("mine"), "n_words": F.lit("many"), "mean_word": F.lit(5), "_spans": F.lit("s"), "_row": F.lit("r"), "kept": F.lit("k")})
    (kept,) = decision_list.keep_good(rows, []).collect()
    assert kept.asDict() == rows.filter("doc_id = 1").first().asDict()
    assert sorted(map(tuple, compact_windows.without_passages(rows).collect())) == sorted(map(tuple, rows.collect()))
    assert superminhash.keep_one(rows).columns == exact_dedup.keep_first(rows).columns == rows.columns


def test_rows_without_id_are_kept(spark):
    rows = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "quite another text of some words")])
    assert sorted((r["doc_id"] or 0) for r in superminhash.keep_one(rows).collect()) == [0, 0, 1]


def test_several_texts_of_one_id(spark):
    """A doc_id with two texts is one document, which links wherever one of them does."""
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = frame(spark, [(1, one), (5, one + " more"), (5, two + " more"), (7, two), (9, "alone")])
    assert sorted((r["doc_id"], r["component_id"]) for r in superminhash.near_duplicates(rows).collect()) == [(1, 1), (5, 1), (5, 1), (7, 1), (9, 9)]


def test_hot_group_is_searched_to_the_end(spark, monkeypatch):
    """Blocks of a hot bucket meet each other: with small blocks the components are those of an exact comparison."""
    from tests.llm import brute

    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        own = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(superminhash, "BLOCK", 24)
    monkeypatch.setattr(superminhash, "CHUNK", 16)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(frame(spark, rows), 4).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows, 4).items()}


def test_shared_counts():
    """Bit sets and runs give the sizes of intersections."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    a, b = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    a, b = a[a != b], b[a != b]
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert superminhash.shared_counts(np.concatenate(sets), bounds)(a, b).tolist() == want
    held, superminhash.HELD = superminhash.HELD, 0
    try:
        assert superminhash.shared_counts(np.concatenate(sets), bounds)(a, b).tolist() == want
    finally:
        superminhash.HELD = held


def test_preference_with_sparse_ids(spark):
    """Ids that lie far apart still make blocks of many, and the neighbours are the same."""
    ids = sorted(random.Random(7).sample(range(0, 10**15), 60))
    turns = [(i, 0, "user", "hi") for i in ids] + [(i, 1, "assistant", f"a{i}") for i in ids]
    got = {r["chosen_id"]: r["rejected_id"] for r in preference.preference(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == dict(zip(ids, [*ids[1:], None]))
    odd_ = spark.createDataFrame([(1, 0, "user", "x", "key", 5)], "conv_id long, turn long, role string, text string, key string, block int")
    assert preference.preference(odd_).count() == 1


def test_recall_of_near_passages(spark):
    """Passages of 60 to 120 words with one word in 60 to 75 changed, a similarity of 0.83 or more, planted once each: at least nine
    tenths of them are found, each to nine tenths of its words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    rows, planted = [], {}
    for k in range(120):
        passage = [word() for _ in range(rng.randint(60, 120))]
        every = rng.randint(60, 75)
        edited = [word() if n % every == every // 2 else w for n, w in enumerate(passage)]
        rows.append((k, " ".join([word() for _ in range(80)] + passage + [word() for _ in range(50)])))
        head = rng.randint(20, 90)
        rows.append((1000 + k, " ".join([word() for _ in range(head)] + edited + [word() for _ in range(60)])))
        planted[1000 + k] = set(range(head, head + len(edited)))
    found: dict[int, set] = {}
    for r in compact_windows.passages(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert set(found) <= set(planted)
    caught = sum(len(planted[k] & found.get(k, set())) >= 0.9 * len(planted[k]) for k in planted)
    assert caught >= 0.9 * len(planted)


def test_values_of_odd_rows(spark):
    """What odd rows give, value by value."""
    whole = odd(spark, ODD)
    packed = packing.pack(whole, packing.byte_bpe(JSON_FILE)).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("all"), F.count(F.lit(1)).alias("pieces")).collect()
    sizes = {r["doc_id"]: r["n"] for r in packed}
    assert sizes[1] == sizes[2] == 1 and sizes[8] > 100 and sizes[13] > 1
    named = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(whole, language.train([], [])).collect()}
    assert set(named.values()) == {("und", 0.0)}
    exact = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(whole).filter("doc_id IN (1, 2, 3, 12)").collect()}
    assert exact[1] == exact[2] == (1, 5) and exact[3] == (3, 2) and exact[12] == (12, 1)


def test_passages_of_neither_the_first_nor_the_one_before(spark):
    """Sixty passages, each with a common beginning, that one earlier document has, which is neither the first with a signature nor the one before."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    some = lambda n: [word() for _ in range(n)]
    start = some(30)
    passage = [start + some(24) for _ in range(60)]
    texts = [" ".join(some(20) + p + some(40)) for p in passage] + [" ".join(some(40) + start + some(40)) for _ in range(20)]
    order = list(range(60))
    rng.shuffle(order)
    texts += [" ".join(some(30) + passage[k] + some(20)) for k in order]
    found = {(r["doc_id"], r["earlier_id"]) for r in compact_windows.passages(frame(spark, list(enumerate(texts)))).collect()}
    assert found >= {(80 + k, n) for k, n in enumerate(order)}


def test_lines_in_common_make_no_pairs(spark, monkeypatch):
    """Documents of two lines that others have too, each too short for a passage, are no pairs to compare, however many have a line."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    one, two = ([" ".join(word() for _ in range(34)) for _ in range(12)] for _ in range(2))
    texts = [f"{x} {y}" for x in one for y in two]
    rng.shuffle(texts)
    sizes, plain = {}, compact_windows.written

    def written(df, name, *rest):
        out = plain(df, name, *rest)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(compact_windows, "written", written)
    assert compact_windows.passages(frame(spark, list(enumerate(texts)))).isEmpty()
    assert sizes["open"] <= len(texts)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_windows_that_were_not_joined(size):
    """Every window with an earlier one of another document that it is not joined to is told, whatever the batches."""
    rng = random.Random(13)
    rows = sorted((rng.randint(0, 20), rng.randint(0, 5), c) for c in rng.sample(range(999), 120))
    names = ["signature", "doc_id", "turn", "l", "c", "r"]
    batches = [pa.RecordBatch.from_pydict({n: pa.array([{"signature": s, "doc_id": d, "c": c}.get(n, 0) for s, d, c in rows[k : k + size]], pa.int64()) for n in names}) for k in range(0, len(rows), size)]
    got = [r for b in compact_windows._collided(iter(batches)) for r in b.to_pylist()]
    joined = {(r["ca"], r["cb"]) for r in got if r["signature"] is None}
    left = {c for s, d, c in rows for t, e, o in rows if s == t and e < d and (o, c) not in joined}
    crowded = {s for s, _, c in rows if c in left}
    alone = [(r["signature"], r["b"], r["cb"], r["turn"]) for r in got if r["signature"] is not None]
    assert sorted(alone) == [(s, d, c, int(c in left)) for s, d, c in rows if s in crowded]


def test_one_earlier_document_for_each_place():
    """A family of edited copies gives one row for each place that is asked, with a passage, and not one for each pair of documents."""
    rng = np.random.default_rng(14)
    near = compact_windows.NEAR
    base = rng.integers(1, 1 << 16, 2 * near + 1).astype(np.uint16)
    around = np.repeat(base[None], 300, axis=0)
    for k, row in enumerate(around):
        row[(near + 20 + k % 9) : (near + 25 + k % 9)] = rng.integers(1, 1 << 16, 5)
        row[:5] = rng.integers(1, 1 << 16, 5)
    doc, c = np.arange(300), np.full(300, 500)
    for block in (7, 4096):
        a, b, at, x, y, u, v = compact_windows._neighbours(doc, c, doc > 0, around, block)
        assert sorted(b.tolist()) == list(range(1, 300)) and (a < b).all() and (at == 500).all()
        for i in range(len(a)):
            one, two = around[b[i]][x[i] - 500 + near : y[i] - 500 + near], around[a[i]][u[i] - 500 + near : v[i] - 500 + near]
            assert len(one) >= compact_windows.PASSAGE and len(np.intersect1d(one, two)) >= 0.8 * len(np.union1d(one, two))


def test_runs_of_a_word_have_a_passage_in_a_shorter_run():
    around = np.random.default_rng(15).integers(1, 1 << 16, (2, 2 * compact_windows.NEAR + 1)).astype(np.uint16)
    around[0, 40:50] = around[1, 10:80] = 77
    found = compact_windows._neighbours(np.array([1, 2]), np.array([100, 200]), np.array([False, True]), around)
    assert found[:3].T.tolist() == [[1, 2, 200]] and found[4] - found[3] == compact_windows.PASSAGE
