"""The benchmark's loader, and its intervals against numpy."""

import json
import math

import numpy as np
import xxhash
from pyspark.sql import functions as F

from recollect.operators import benchmark

ITEMS = [
    {"question_id": f"i{k}", "question_type": "update" if k % 2 else "single", "question": "what of tea", "answer": "x", "question_date": "2023/07/15 (Sat) 13:17", "haystack_session_ids": ["s1", "s2"],
     "haystack_dates": ["2023/07/15 (Sat) 13:17", "bad"], "haystack_sessions": [[{"role": "user", "content": "tea is here", "has_answer": True}, {"role": "assistant", "content": "no"}], [{"role": "user", "content": None}]]}
    for k in range(20)
]


def test_items(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps(ITEMS))
    load = lambda **more: {r["question_id"] for r in benchmark.load(spark, str(tmp_path), **more).collect()}
    assert len(load()) == 20 and load(types=["update"]) == {f"i{k}" for k in range(1, 20, 2)}
    assert len(load(n=5)) == 5 and load(n=5) == load(n=5) and load(n=5) != load(n=5, seed=8)
    rows = benchmark.passages(benchmark.load(spark, str(tmp_path)).filter("question_id = 'i3'")).collect()
    assert [(r["passage_id"], r["content"], str(r["at"]), r["answers"]) for r in rows] == [("s1#t0", "tea is here", "2023-07-15 13:17:00", True), ("s2#t0", None, "None", False)]
    found = benchmark.ranked(benchmark.load(spark, str(tmp_path)), benchmark.passages(benchmark.load(spark, str(tmp_path)), ("user", "assistant")))
    best = {(r["question_id"], r["arm"]): r["passage_id"] for r in found.filter("rank = 1").collect()}
    assert {best[f"i{k}", a] for k in range(20) for a in benchmark.ARMS} == {"s1#t0"}


def test_statistics_are_local(spark):
    """A word that is everywhere in one haystack and rare in another weighs differently in each."""
    questions = spark.createDataFrame([("a", "red fox"), ("b", "red fox")], "question_id string, question string")
    stacks = [("a", "1", "red one"), ("a", "2", "red two"), ("a", "3", "fox three"), ("a", "4", "red four"), ("b", "1", "fox one"), ("b", "2", "fox two"), ("b", "3", "red three"), ("b", "4", "fox four")]
    found = benchmark.ranked(questions, spark.createDataFrame(stacks, "question_id string, passage_id string, content string"))
    best = {(r["question_id"], r["arm"]): r["passage_id"] for r in found.filter("rank = 1").collect()}
    assert best["a", "bm25"] == best["b", "bm25"] == best["a", "rare"] == "3"


def test_interval(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "x" if k % 3 else "y", a, int(rng.random() < p), 0.0) for k in range(150) for a, p in (("hybrid", 0.7), ("bm25", 0.5))]
    df = spark.createDataFrame(rows, "question_id long, kind string, arm string, hit int, rr double")
    got = {r["kind"]: r for r in benchmark.paired(df.repartition(5), "hybrid", "bm25", rounds=60).collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(9)])
    for kind in "xy":
        d = {k: 0 for k, c, *_ in rows if c == kind}
        for k, c, a, hit, _ in rows:
            if c == kind:
                d[k] += hit if a == "hybrid" else -hit
        means = []
        for r in range(1, 61):
            def weight(k, r=r):
                h = xxhash.xxh64_intdigest(np.int32(7).tobytes(), 42)
                h = xxhash.xxh64_intdigest(np.int32(r).tobytes(), h)
                return int(np.searchsorted(steps, (xxhash.xxh64_intdigest(np.int64(k).tobytes(), h) >> 11) / 2.0**53, side="right"))

            w = {k: weight(k) for k in d}
            means.append(sum(w[k] * d[k] for k in d) / sum(w.values()))
        row = got[kind]
        assert (row["n"], row["difference"]) == (len(d), round(sum(d.values()) / len(d), 6))
        assert np.allclose([row["low"], row["high"]], np.percentile(means, [2.5, 97.5]), atol=1e-6)
    same = df.filter(F.col("arm") == "bm25").unionByName(df.filter(F.col("arm") == "bm25").withColumn("arm", F.lit("hybrid")))
    assert all(r["low"] == r["high"] == 0 for r in benchmark.paired(same, "hybrid", "bm25", rounds=20).collect())
