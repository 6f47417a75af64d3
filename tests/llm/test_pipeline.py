"""Each stage of the pipeline on what the one before kept, and the whole."""

from __future__ import annotations

import corpus_pipeline
from plandrift.llm.common import written
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = kept["language_id"]
    assert len(after) >= 0.99 * len(before)
    before, after = kept["exact_copies"]
    seen = {}
    for i, t in sorted(before):
        seen.setdefault(" ".join(brute.words(t, lower=False)) + ("" if t is None else f"{t[:1].isspace()}{t[-1:].isspace()}"), i)
    assert set(after) == set(seen.values())
    before, after = kept["near_copies"]
    assert set(after) == {i for i, (_, c) in brute.components(before, 5).items() if c == i}
    before, after = kept["repeated_passages"]
    assert set(after) == {i for i, _ in before}
    assert not brute.later_copies(list(after.items()), 60)
    cut = brute.later_copies(before)
    assert all(len(brute.words(after[i])) <= len(brute.words(t)) - len(cut[i]) for i, t in before if i in cut)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
