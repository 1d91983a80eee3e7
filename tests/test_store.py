"""The store by SQL, its log, and embeddings that are computed once."""

import sys

import pytest
from pyspark.sql import functions as F

from recollect import store
from recollect.functions import embedding
from recollect.operators import recall
from recollect.sources import bindings as B


def test_functions_and_views(spark, sf, tmp_path):
    path = str(tmp_path / "s")
    B.facts(spark, sf).write.parquet(f"{path}/facts")
    B.stances(spark, sf).write.parquet(f"{path}/stances")
    assert store.open_store(spark, path) == ["facts", "stances"]
    got = spark.sql("""SELECT fact_id, memory_activation(pinned, importance, memory_decay((unix_micros(TIMESTAMP '2024-02-01 00:00:00') - unix_micros(CAST(valid_from AS TIMESTAMP))) / 86400000000D, fact_type), access_count, confidence) AS act
        FROM live_facts""").collect()
    want = recall.with_activation(recall.live(B.facts(spark, sf)), B.now()).select("fact_id", "act").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.sql("SELECT count(*) AS n FROM current_stances").first()["n"] == recall.current_stances(B.stances(spark, sf)).count()
    row = spark.sql("SELECT memory_decay(NULL, 'x') AS a, memory_decay(-1, 'semantic') AS b, memory_decay(240, 'semantic') AS c, memory_decay(45, 'none') AS d, memory_rrf(1) AS e").first()
    assert tuple(row) == (0.5, 0.5, 0.5, 0.5, 1 / 61)
    assert "BatchEvalPython" not in spark.sql("SELECT memory_decay(1, 'semantic')")._jdf.queryExecution().toString()


def test_log(spark, sf, tmp_path):
    path = str(tmp_path / "s")
    facts = B.facts(spark, sf)
    found = spark.createDataFrame([("q", 1, 0, 0.5, "lexical,vector"), ("q", 2, 7, 0.4, "vector"), ("q", 3, -5, 0.1, "lexical")], "query_id string, rank int, fact_id long, score double, via string")
    asked = spark.createDataFrame([("q", "what of it")], "query_id string, asked string")
    at = F.lit("2024-02-01").cast("timestamp")
    hits = store.logged(found, asked, path, "r1", at)
    assert store.logged(found.limit(1), asked, path, "r1", at).count() == hits.count() == 3  # once
    why = {r["fact_id"]: r["why"] for r in store.explained(hits, facts).collect()}
    assert why[0].startswith("found by lexical and vector; pinned") and "cold" in why[7] and why[-5].endswith("no longer in the store")
    marks = lambda *rows: spark.createDataFrame(list(rows), "run_id string, query_id string, fact_id long, worth string")
    store.feedback(marks(("r1", "q", 0, "ignored"), ("r1", "q", 7, "wrong"), ("r1", "q", 7, "odd")), path, at)
    store.feedback(marks(("r1", "q", 0, "used")), path, F.lit("2024-02-02").cast("timestamp"))
    assert store.open_store(spark, path) == ["recall_feedback", "recall_hits", "recall_runs"]
    out = store.usefulness(spark.table("recall_hits"), spark.table("recall_feedback")).collect()
    assert {tuple(r) for r in out} == {(0, 1, 1, 0), (7, 1, 0, 1), (-5, 1, 0, 0)}


@pytest.fixture
def embedder(spark, tmp_path):
    log = tmp_path / "calls"
    (tmp_path / "test_embedder.py").write_text(f"""def embed(texts):
    open({str(log)!r}, "a").write("".join(f"{{t!r}}\\n" for t in texts))
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def short(texts):
    return [[1.0]] * (len(texts) - 1)
""")
    spark.sparkContext.addPyFile(str(tmp_path / "test_embedder.py"))
    sys.path.insert(0, str(tmp_path))
    yield log
    sys.path.remove(str(tmp_path))


def test_each_text_is_embedded_once(spark, embedder, tmp_path):
    path, name = str(tmp_path / "v"), "test_embedder:embed"
    rows = [(k, t) for k, t in enumerate(["a text", "a text", "banana", None, " ", "x" * 500])]
    facts = spark.createDataFrame(rows, "fact_id long, content string").repartition(3)
    assert embedding.backlog(facts, path, name).count() == 4
    assert embedding.filled(facts, path, name, batch=2) == 3
    assert embedding.filled(facts, path, name) == 0 and len(embedder.read_text().splitlines()) == 3
    got = {r["fact_id"]: r["vec"] for r in embedding.vectors(facts, path, name).collect()}
    assert got == {0: [6, 1, 1], 1: [6, 1, 1], 2: [6, 3, 1], 5: [500, 0, 1]}
    more = facts.unionByName(spark.createDataFrame([(9, "new"), (10, "banana")], "fact_id long, content string"))
    assert embedding.filled(more, path, name) == 1 and embedding.backlog(more, path, name).count() == 0
    assert embedding.filled(facts, path, name, version="2") == 3  # another version is another vector
    with pytest.raises(Exception, match="vectors for"):
        embedding.filled(facts, path, "test_embedder:short")
    with pytest.raises(ValueError):
        embedding.loaded("nothing")
