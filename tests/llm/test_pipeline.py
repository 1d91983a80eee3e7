import importlib

import corpus_pipeline

from recollect.llm.common import written


def test_stages(spark, sf, docs):
    rows, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, rows, sf), "test-stage")
        seen.append(out.count())
        if name != "packing":
            assert out.dtypes == docs.dtypes
            rows = out
    assert seen[0] < docs.count() and seen[1] <= seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-duplicates", "personal data", "packing"]


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_odd_rows(spark, odd, none, sf):
    for rows in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, sf), "test-stage")
