"""Operator 12: n-grams against plain Python, the fit against the dual's conditions, and held-out accuracy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import nbsvm


def brute_ngrams(text: bytes):
    words = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text)]
    return {*words, *zip(words, words[1:], strict=False), *((n, text[i : i + n]) for n in range(1, 5) for i in range(len(text) - n + 1))}


TEXTS = [b"", b"a", b"one two one two", b" \n\t ", "Écoute, l'été ### arrive!!".encode(), b"x" * 50, b"ab ab ab\nab", b"!!", b"a b a b a b", b"\x00\x01 nul"]


def test_distinct_ngrams(monkeypatch):
    """As many buckets as there are different n-grams (with these few, none collide), whatever lies beside a text and however portions are cut."""
    want = [len(brute_ngrams(t)) for t in TEXTS]
    alone = [next(nbsvm.Ngrams().of([t])).tolist() for t in TEXTS]
    assert [len(a) for a in alone] == want and all(len(set(a)) == len(a) for a in alone)
    for portion in (1, 20, 1 << 20):
        monkeypatch.setattr(nbsvm, "PORTION", portion)
        ngrams = nbsvm.Ngrams()
        for _ in range(2):
            assert [sorted(a.tolist()) for a in ngrams.of(TEXTS)] == [sorted(a) for a in alone]
    assert not list(nbsvm.Ngrams().of([]))


def test_dual_coordinate_descent():
    """At the end no multiplier wants to move: rows beyond the margin have none, rows inside it the greatest."""
    rng = np.random.default_rng(3)
    rows, signs = [], []
    for k in range(200):
        at = rng.choice(40, 6, replace=False)
        values = rng.normal(size=6) + (0.8 if k % 3 else -0.8)
        rows.append((at, (values / np.linalg.norm(values)).astype(np.float32)))
        signs.append(1.0 if k % 3 else -1.0)
    signs = np.array(signs)
    weights, bias = nbsvm.descend(rows, signs, cost=0.5, enough=1e-6, epochs=5000)
    x = np.zeros((200, 41))
    for k, (at, values) in enumerate(rows):
        x[k, at], x[k, 40] = values, 1
    w = np.append(weights[:40], bias)
    loss = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - signs * (x @ v)).sum()
    best = loss(w)
    assert all(loss(w + rng.normal(size=41) * scale) >= best - 1e-3 for scale in (1e-3, 1e-2, 1e-1) for _ in range(50))


def test_logistic_curve():
    rng = np.random.default_rng(5)
    margins = rng.normal(size=20_000) * 2
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * margins - 0.7)))).astype(int)
    slope, shift = nbsvm.logistic(margins, labels, np.ones(20_000))
    assert abs(slope - 1.5) < 0.1 and abs(shift + 0.7) < 0.1


def tables(spark, docs, sf):
    return docs, spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = nbsvm.op12_quality_model(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == c] for c in (1, 0))
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert right > 0.9 and auc > 0.9


def test_only_texts_decide(spark, docs, sf):
    """Scores of held-out documents don't change with their own labels, sources, languages, order or partitions."""
    _, labels = tables(spark, docs, sf)
    model = nbsvm.fit(docs, labels, ~nbsvm.held_out())
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = nbsvm.fit(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}).repartition(7), other.repartition(3), ~nbsvm.held_out())
    assert np.array_equal(model.weights, again.weights) and (model.bias, model.slope, model.shift) == (again.bias, again.slope, again.shift)


def test_odd_rows(spark, odd, none, docs, sf):
    _, labels = tables(spark, docs, sf)
    model = nbsvm.fit(docs, labels)
    rows = nbsvm.scored(odd, model, ("doc_id", "score", "x1"), "text").toDF("doc_id", "old", "x1", "score", "predicted").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert nbsvm.scored(none, model).count() == 0
    few = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 1, 0), (3, 0, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    share = nbsvm.fit(odd, few).scores(np.zeros(1))[0]  # one label counts: that of 1
    assert share == pytest.approx(2 / 3)
    assert nbsvm.fit(none, few).scores(np.zeros(1))[0] == pytest.approx(0.5)
    clash = odd.withColumns({c: F.lit("clash") for c in ("label", "held", "size", "draw", "_key", "_mean", "quality")})
    both = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    assert np.isfinite(nbsvm.fit(clash, both).bias)


def test_a_bounded_sample_is_enough(spark, docs, sf):
    _, labels = tables(spark, docs, sf)
    small = nbsvm.fit(docs, labels, sample=30, size=40_000)
    whole = nbsvm.fit(docs, labels)
    assert np.array_equal(small.squares, whole.squares)  # counts cover all rows
    assert not np.array_equal(small.weights, whole.weights)
