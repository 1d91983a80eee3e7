"""A store for SQL users: views over its tables, the scores as SQL functions, and a log of what was recalled.

``open_store(spark, path)`` reads the tables of a folder (facts, evidence, stances and more, as Parquet) into temporary views, with ``live_facts`` and
``current_stances`` beside them, and registers the functions:

* ``memory_decay(age_days, kind)``, ``memory_activation(pinned, importance, fresh, access_count, confidence)``, ``memory_rrf(rank)``.

Recalls are logged as ``recall_runs`` (run_id, query_id, at, asked) and ``recall_hits`` (run_id, query_id, rank, fact_id, score, via); ``explained`` says in words why a
fact came, ``feedback`` records what it was worth.

Results for odd input: a table that the folder lacks is no view; a null age or an age below 0 counts as half, an unknown kind has the common half-life; a run that
is logged again under its id is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.operators import recall

TABLES = ("facts", "evidence", "fact_evidence", "stances", "vectors", "marks", "recall_runs", "recall_hits", "recall_feedback")
RUNS = "run_id string, query_id string, at timestamp, asked string"
HITS = "run_id string, query_id string, rank int, fact_id long, score double, via string"
FEEDBACK = "run_id string, query_id string, fact_id long, worth string, at timestamp"


def functions(spark: SparkSession, config: Config = CONFIG) -> None:
    """Registers the scores as SQL functions of the session; they are expressions, so a query that calls them is compiled as a whole."""
    half = " ".join(f"WHEN '{kind}' THEN {days}D" for kind, days in config.half_lives.items())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION memory_decay(age_days DOUBLE, kind STRING) RETURNS DOUBLE
        RETURN CASE WHEN age_days IS NULL OR age_days < 0 THEN 0.5D ELSE pow(0.5D, age_days / CASE kind {half} ELSE {config.other_half_life}D END) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION memory_activation(pinned BOOLEAN, importance DOUBLE, fresh DOUBLE, access_count INT, confidence DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN pinned THEN 10.0D ELSE round(coalesce(importance, 0.5D) * (0.4D + 0.6D * fresh) + least(access_count, 8) * 0.06D + coalesce(confidence, 0.5D) * 0.4D, 4) END""")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION memory_rrf(place INT) RETURNS DOUBLE RETURN 1.0D / ({config.rrf_k} + place)")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def views(tables: dict[str, DataFrame], config: Config = CONFIG) -> None:
    """Temporary views of tables, and of what is read off them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "facts" in tables:
        recall.live(tables["facts"], config).createOrReplaceTempView("live_facts")
    if "stances" in tables:
        recall.current_stances(tables["stances"]).createOrReplaceTempView("current_stances")


def open_store(spark: SparkSession, path: str, config: Config = CONFIG) -> list[str]:
    """Registers functions and views of the store at `path`; returns the names of its tables."""
    functions(spark, config)
    found = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if _exists(spark, f"{path}/{name}")}
    views(found, config)
    return sorted(found)


def logged(found: DataFrame, questions: DataFrame, path: str, run_id: str, at: Column) -> DataFrame:
    """Writes a recall to the store's log and returns it as it was written; found: query_id, rank, fact_id, score, via; questions: query_id, asked.

    Hits come first and the run last, so that a run which broke off is written again as a whole.
    """
    spark = found.sparkSession
    runs = f"{path}/recall_runs"
    part = f"run_id={run_id}"
    if not _exists(spark, f"{runs}/{part}"):
        rows = found.select("query_id", F.col("rank").cast("int").alias("rank"), "fact_id", F.col("score").cast("double").alias("score"), "via")
        rows.write.mode("overwrite").parquet(f"{path}/recall_hits/{part}")
        questions.select("query_id", at.cast("timestamp").alias("at"), "asked").write.mode("overwrite").parquet(f"{runs}/{part}")
    return spark.read.parquet(f"{path}/recall_hits/{part}")


def explained(hits: DataFrame, facts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """`hits` (query_id, rank, fact_id, score, via) with ``why``: channels and what raised or lowered the score, in words."""
    both = hits.join(facts.select("fact_id", "status", "pinned", "layer"), "fact_id", "left")
    notes = F.array_compact(
        F.array(
            F.concat(F.lit("found by "), F.regexp_replace("via", ",", " and ")), F.when(F.col("pinned"), F.lit("pinned")), F.when(~F.col("pinned") & (F.col("status") == "confirmed"), F.lit("confirmed")),
            F.when(F.col("layer") == "cold", F.lit(f"cold, so weighed {config.cold_factor:g}")), F.when(F.col("status").isNull(), F.lit("no longer in the store")),
        )
    )
    return both.select(*hits.columns, F.array_join(notes, "; ").alias("why"))


def feedback(marks: DataFrame, path: str, at: Column) -> None:
    """Appends what recalled facts were worth: run_id, query_id, fact_id, worth (used, ignored or wrong)."""
    kept = marks.filter(F.col("worth").isin("used", "ignored", "wrong"))
    kept.select("run_id", "query_id", "fact_id", "worth", at.cast("timestamp").alias("at")).write.mode("append").parquet(f"{path}/recall_feedback")


def usefulness(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """fact_id, hits, used, wrong: how often a fact was recalled and what came of it; of several marks of one hit the last counts."""
    last = marks.groupBy("run_id", "query_id", "fact_id").agg(F.max_by("worth", "at").alias("worth"))
    both = hits.join(last, ["run_id", "query_id", "fact_id"], "left")
    return both.groupBy("fact_id").agg(F.count("*").alias("hits"), F.count_if(F.col("worth") == "used").alias("used"), F.count_if(F.col("worth") == "wrong").alias("wrong"))
