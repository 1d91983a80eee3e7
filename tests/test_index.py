"""The inverted index against scans of the texts, what it reads, and its batches."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.operators import index, recall
from recollect.plans import indexed, queries
from recollect.sources import bindings as B

TEXTS = [None, "", "a", "aa aa b", "one two two", "Ünë ühand", "上次那个星光湾是哪年的事", "星光湾挺好看", "好看", "one one one one", "x" * 50, "two " * 30, "the the of"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "fact_id long, content string").repartition(3)


def test_batches(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        index.table(spark, path, "words")
    index.append(texts.filter("fact_id < 6"), path, 0)
    index.append(texts.filter("fact_id >= 6").unionByName(texts.filter("fact_id = 7")), path, 1)
    index.append(texts, path, 1)  # a replay
    assert index.table(spark, path, "lengths").count() == len(TEXTS)
    texts.limit(1).write.parquet(f"{path}/lengths/batch=2")  # a run that broke off
    assert index.table(spark, path, "lengths").count() == len(TEXTS)
    words = {r["term"]: r["df"] for r in index.frequency(spark, path, spark.createDataFrame([("two",), ("one",), ("none",)], "term string")).collect()}
    assert words == {"two": 2, "one": 2}


ASKED = ["a", "aa", "aa a", "one", "two two", "é", "üh", "星光湾", "星光", "哪年的事", "好看", "x" * 49, "xx", "none", "", "o", "th", "e t"]


def test_parts_and_forms(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    index.append(texts, path, 0)
    terms = spark.createDataFrame([("q", k, t) for k, t in enumerate(ASKED)], "query_id string, term_rank int, term string")
    got = {(r["term"], r["fact_id"]) for r in index.containing(spark, path, texts, terms).collect()}
    low = [(t or "").lower() for t in TEXTS]
    assert got == {(a, k) for a in ASKED if a for k, t in enumerate(low) if a in t}

    long = spark.createDataFrame([("q", "星光湾挺好看"), ("q", "one"), ("q", "the of"), ("q", "湾是哪里")], "query_id string, term string")
    used = index.usable_forms(spark, path, texts, long).collect()
    df = lambda f: sum(f in t for t in low)
    want = []
    for term in ("星光湾挺好看", "one", "the of", "湾是哪里"):
        ways = {term} if term.isascii() else {term} | {term[i : i + n] for n in (4, 3, 2) if len(term) > n for i in range(len(term) - n + 1)}
        want += [(term, f, df(f), k) for k, f in enumerate(sorted((f for f in ways if 0 < df(f) <= CONFIG.too_common), key=lambda f: (df(f), -len(f), f))[:3], 1)]
    assert sorted((r["term"], r["form"], r["df"], r["place"]) for r in used) == sorted(want)
    order = [r["whole"] for r in index.rarest_first(index.usable_forms(spark, path, texts, long), long.union(spark.createDataFrame([("q", "没有")], long.schema))).orderBy("term_rank").collect()]
    assert "没有" not in order and order == ["the of", "星光湾挺好看", "湾是哪里", "one"]


@pytest.mark.parametrize("block", [4, 64])
def test_bounds_skip_blocks_and_nothing_else(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(index, "BLOCK", block)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(60)]
    weight = 1 / np.arange(1, 61)
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 200), p=weight / weight.sum()))) for k in range(600)]
    facts = spark.createDataFrame(rows, "fact_id long, content string").repartition(4).cache()
    path = str(tmp_path / "i")
    index.append(facts.filter("fact_id < 300"), path, 0)
    index.append(facts.filter("fact_id >= 300"), path, 1)
    terms = spark.createDataFrame([(f"q{k}", j, str(w)) for k in range(12) for j, w in enumerate(rng.choice(vocabulary, 3, replace=False))], "query_id string, term_rank int, term string")
    found, read = index.bm25(spark, path, terms, k=5, first=2)
    order = lambda df: sorted((r["query_id"], r["rank"], r["fact_id"], r["score"]) for r in df.collect())
    assert [x[:3] for x in order(found)] == [x[:3] for x in order(recall.bm25(facts, terms, k=5))]
    total = read.agg(F.sum("blocks"), F.sum("read")).first()
    assert total[1] < (0.8 if block == 4 else 1.0) * total[0]


def brute_layers(facts, asked, stages, limit, cap):
    by_id = {f["fact_id"]: f for f in facts}
    low = {f["fact_id"]: f["content"].lower() for f in facts}
    score = {i: round(f["act"] * (CONFIG.cold_factor if f["layer"] == "cold" else 1), 6) for i, f in by_id.items()}
    top = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:limit]
    holds = lambda term: {i for i, t in low.items() if term in t}
    out = []
    for q in sorted({a[0] for a in asked}):
        seen, found, streak = set(), [], 0
        for stage in stages:
            mine, new = {i for i, f in by_id.items() if f["layer_of"] == stage}, []
            for _, rank, term in sorted(a for a in asked if a[0] == q):
                hits = top(holds(term) & mine)
                if not hits and len(term) > 3:
                    ways = {term} if term.isascii() else {term} | {term[i : i + n] for n in (4, 3, 2) if len(term) > n for i in range(len(term) - n + 1)}
                    ways = sorted((f for f in ways if 0 < len(holds(f)) <= CONFIG.too_common), key=lambda f: (len(holds(f)), -len(f), f))[:3]
                    for f in ways:
                        hits += [i for i in top(holds(f) & mine) if i not in hits]
                    hits = hits[: 2 * limit]
                for i in hits:
                    if i not in seen:
                        seen.add(i)
                        new.append((rank, -score[i], i, stage))
            found += new
            streak = 0 if new else streak + 1
            if streak >= 2 or len(found) >= cap:
                break
        out += [(q, k, i, stage, rank) for k, (rank, _, i, stage) in enumerate(sorted(found)[:cap], 1)]
    return out


def test_layers_against_the_loop(spark, sf):
    said = B.statements(spark, sf)
    rows = said.select("fact_id", "content", F.col("subject").alias("layer_of"), (F.pmod(F.col("fact_id") * 7919, F.lit(1000)) / 1000).alias("act"), F.when(F.col("fact_id") % 5 == 0, "cold").otherwise("active").alias("layer")).collect()
    got = sorted(tuple(r) for r in queries.QUERIES["layered_recall"](spark, sf).collect())
    want = brute_layers(rows, indexed.PARTS, indexed.STAGES, 3, 12)
    assert got == sorted(want) and len(Counter(r[0] for r in got)) > 1


def test_stages_stop(spark):
    """A query stops after `cap` facts, and after two stages that gave nothing."""
    rows = [("a", s, 1, 10 * k + j, 1.0, j) for k, s in enumerate(("s1", "s2", "s3")) for j in range(2)] + [("b", "s1", 1, 1, 1.0, 1), ("b", "s4", 1, 2, 1.0, 1), ("c", "s3", 1, 1, 0.5, 1)]
    probed = spark.createDataFrame(rows, "query_id string, stage string, term_rank int, fact_id long, score double, n int")
    found = defaultdict(list)
    for r in index.layered(probed, ["s1", "s2", "s3", "s4"], cap=3).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["stage"])
    assert found == {"a": ["s1", "s1", "s2"], "b": ["s1"]}
