"""Every query of the library against its SQL, and those without SQL against brute force."""

import decimal
import os

import duckdb
import numpy as np
import pytest

from recollect.operators import graphs
from recollect.plans import queries as plans
from recollect.sources import bindings


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(name, spark, sf, con):
    got, want = plans.QUERIES[name](spark, sf), con.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda cols, data: sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in data), key=repr)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_clusters_against_numpy(spark, sf):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(v)
    got = {r["id"]: r["cluster"] for r in plans.upgma_clusters(spark, sf).collect()}
    clusters = [{i} for i in ids]
    while True:
        best = (plans.THRESHOLD - 1e-9, None)
        for a in range(len(clusters)):
            for b in range(a):
                # A pair below the threshold everywhere can't have a mean at it.
                first = v[min(clusters[a])] @ v[min(clusters[b])]
                if len(clusters[a]) == len(clusters[b]) == 1 and first < plans.THRESHOLD:
                    continue
                mean = np.mean([v[x] @ v[y] for x in clusters[a] for y in clusters[b]])
                if mean > best[0]:
                    best = (mean, (a, b))
        if best[1] is None:
            break
        a, b = best[1]
        clusters[b] |= clusters.pop(a)
    assert {i: min(c) for c in clusters for i in c} == {i: min(j for j in ids if got[j] == got[i]) for i in ids}


def test_leaders_are_those_of_the_scan(spark):
    rng = np.random.default_rng(0)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (90, 2)) if p[0] != p[1]}
    leader = {}
    for i in range(60):
        mine = [j for j in range(i) if leader[j] == j and (j, i) in pairs]
        leader[i] = min(mine, default=i)
    nodes = spark.range(60)
    got = graphs.leaders(spark.createDataFrame(list(pairs), "a long, b long"), nodes)
    assert {r["id"]: r["leader"] for r in got.collect()} == leader


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_jaccard_pairs_lose_none(spark, threshold):
    rng = np.random.default_rng(1)
    sets = {k: sorted({int(x) for x in rng.integers(0, 14, rng.integers(0, 9))}) for k in range(70)}
    rows = spark.createDataFrame([(k, k % 2, [str(x) for x in s]) for k, s in sets.items()], "id long, source long, grams array<string>")
    classes, members = graphs.gram_classes(rows, "source")
    of = {r["id"]: r["class"] for r in members.collect()}
    near = {(r["a"], r["b"]) for r in graphs.jaccard_pairs(classes, threshold, "source").collect()}
    got = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in near)}
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0
    assert got == {(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and round(j(sets[a], sets[b]), 6) >= threshold}
    shared = {(r["a"], r["b"]): r["shared"] for r in graphs.overlap_pairs(classes, 3, "source").collect()}
    n = lambda a, b: len(set(sets[a]) & set(sets[b]))
    assert shared == {(a, b): n(a, b) for a in set(of.values()) for b in set(of.values()) if a < b and a % 2 == b % 2 and n(a, b) >= 3}


def test_clusters_of_any_size(spark):
    """Nearest-neighbour chains and rounds of merges against merging the best pair, one after the other."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(c, 0.35, (14, 5)) for c in rng.normal(0, 1, (4, 5))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for threshold in (0.3, 0.6, 0.9):
        clusters = [[k] for k in range(len(v))]
        while len(clusters) > 1:
            best = max((float(np.mean(v[a] @ v[b].T)), -x, -y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y)
            if best[0] < threshold:
                break
            clusters[-best[1]] += clusters.pop(-best[2])
        want = {k: min(c) for c in clusters for k in c}
        assert dict(enumerate(graphs.average_linkage(v, threshold).tolist())) == want
        rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>")
        for largest in (1000, 1):
            assert {r["id"]: r["cluster"] for r in graphs.linked_clusters(rows, threshold, largest).collect()} == want


def test_greedy_chunks(spark, sf):
    rows = {r["id"]: r for r in bindings.evidence(spark, sf).collect()}
    got = {}
    for r in plans.greedy_chunks(spark, sf).collect():
        got.setdefault((r["path"], r["chunk"]), []).append(r["id"])
    for (path, chunk), ids in got.items():
        size = sum(len(rows[i]["content"]) for i in ids)
        assert size <= 6000 or len(ids) == 1
        if after := got.get((path, chunk + 1)):
            assert size + len(rows[min(after)]["content"]) > 6000


def test_eligible_clusters(spark, sf):
    facts = {r["fact_id"]: r for r in bindings.facts(spark, sf).select("fact_id", "subject", "valid_from").collect()}
    of = {}
    for r in graphs.linked_clusters(plans._nodes(spark, sf), 0.3).collect():
        if r["id"] in facts:
            of.setdefault(r["cluster"], []).append(facts[r["id"]])
    want = set()
    for c, rows in of.items():
        own = [r for r in rows if r["subject"] == "user"]
        days = len({r["valid_from"].date() for r in own})
        want.add((c, len(rows), len(own), days, len(rows) >= 3 and len(own) >= 2 and days >= 2))
    got = plans.cluster_eligibility(spark, sf).select("cluster", "size", "own", "days", "eligible").collect()
    assert {tuple(r) for r in got} == want and any(w[1] > 1 for w in want)


def test_leaders_of_statements(spark, sf):
    import re
    from datetime import datetime

    rows = sorted((r["fact_id"], r["subject"], re.sub(r"\s+", "", r["content"].lower())) for r in bindings.statements(spark, sf).collect() if r["valid_from"] >= datetime(2024, 1, 18))
    sets = {i: {t[k : k + 2] for k in range(len(t) - 1)} or {t} for i, _, t in rows}
    leader = {}
    for i, s, _ in rows:
        leader[i] = next((j for j, z, _ in rows if j < i and z == s and leader[j] == j and round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) >= 0.7), i)
    assert {r["id"]: r["leader"] for r in plans.near_dup_leaders(spark, sf).collect()} == leader


def test_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/recollect", tmp_path / "recollect", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{f}"):
            shutil.copy(f"{root}/{f}", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    n, m, pipeline = said.stdout.split()
    assert int(n) == len(plans.QUERIES) and int(m) == len(plans.SQL) and pipeline == "False"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
