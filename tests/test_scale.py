"""Large batches of terms, goals and questions meet texts by equal keys: no nested loops, no cartesian products, the same results."""

import pytest
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import entities, pool, recall, reports

N = 10_001


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(k, f"fact{k} says word{k % 37} and xy{k % 11}z of Thing{k}") for k in range(300)]
    return spark.createDataFrame(rows, "fact_id long, content string").withColumns({"act": F.col("fact_id") / 300, "layer": F.lit("active"), "pinned": F.lit(False), "status": F.lit("candidate"), "valid_from": F.lit("2024-01-01"), "echo": F.lit(False)})


@pytest.fixture(scope="module")
def many(spark):
    """10,001 terms, most of which begin alike and stand nowhere."""
    rows = [(f"q{k % 50}", k, t) for k, t in enumerate([*(f"fact{k}" for k in range(N - 4)), "word3 and", "z of th", "e", "xy"])]
    return spark.createDataFrame(rows, "query_id string, term_rank int, term string")


def plan(df):
    return df._jdf.queryExecution().toString()


def fine(df):
    shown = plan(df)
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def brute(facts, many):
    terms = {r["term"] for r in many.collect()}
    return {(r["fact_id"], t) for r in facts.collect() for t in terms if t in r["content"].lower()}


def test_terms(facts, many):
    found = recall.term_matches(facts, many)
    fine(found)
    assert {(r["fact_id"], r["term"]) for r in found.collect()} == brute(facts, many)
    few = many.filter("term_rank > 9900")
    rows = facts.select("fact_id", F.lower("content").alias("low"))
    pairs = lambda df: {(r["fact_id"], r["term"]) for r in df.collect()}
    assert pairs(recall.containing(rows, few, "fact_id", "low")) == pairs(recall.containing(rows, few, "fact_id", "low", scan=0)) == brute(facts, few)


def test_other_batches(spark, facts, many):
    words = many.withColumn("term", F.regexp_replace("term", " .*", ""))
    fine(recall.word_matches(facts, words))
    shown = plan(recall.bm25(facts, words))
    assert "CartesianProduct" not in shown and "NestedLoopJoin BuildLeft" not in shown  # only the one row of sizes is joined to all
    cards = facts.select("fact_id", F.lower("content").alias("card"), "act", "echo")
    dictionary = many.select("term").distinct().withColumn("kind", F.lit("named"))
    grams = facts.select("fact_id", text.bigrams(F.col("content")).alias("grams"))
    goals = spark.range(N).select(text.bigrams(F.concat(F.lit("goal of word"), "id")).alias("grams"), F.lit(1.0).alias("weight"))
    asked = goals.select(F.monotonically_increasing_id().cast("string").alias("query_id"), F.col("grams").alias("q"))
    for df in (recall.discover(cards, many, 3), pool.entity_facts(facts, dictionary), entities.frequency(facts, dictionary), reports.relevance_to_goals(grams, goals), reports.sharing(grams.withColumnRenamed("grams", "g"), asked)):
        fine(df)
    df = {r["term"]: r["df"] for r in entities.frequency(facts, dictionary).collect()}
    want = brute(facts, many)
    assert all(df[t] == sum(x[1] == t for x in want) for t in ("e", "xy", "word3 and", "fact7", "fact299", "fact5000"))
