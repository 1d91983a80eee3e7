"""Old and new versions of the same matter within the pool of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators import graphs

WORD = "[a-z0-9']+"


def superseded(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, old_id, new_id); pool: query_id, fact_id, content, valid_from; questions: query_id, word.

    A word is distinctive that is longer than two characters and in at most half of the pool, or two facts.  Two facts belong
    together if sentences that hold a distinctive word of the question share two distinctive words, and also share the question's
    rarest, its anchor.  In each group the facts that are strictly older lead to the newest (the smallest id among equals).
    A pool is bounded by the number of facts recalled, so that pairs within it are few.
    """
    sentences = pool.select("query_id", "fact_id", F.posexplode(F.split(F.lower("content"), r"[.!?]\s+")).alias("sentence", "s"))
    words = graphs.saved(sentences.select("query_id", "fact_id", "sentence", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(WORD), F.lit(0)))).alias("word")))
    size = pool.groupBy("query_id").agg(F.count("*").alias("n"))
    df = words.groupBy("query_id", "word").agg(F.count_distinct("fact_id").alias("df")).join(size, "query_id")
    rare = df.filter((F.length("word") > 2) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))).select("query_id", "word", "df")
    asked = rare.join(questions.select("query_id", "word").distinct(), ["query_id", "word"])
    anchor = asked.groupBy("query_id").agg(F.min(F.struct("df", -F.length("word"), "word")).getField("word").alias("anchor"))
    key = words.join(asked.select("query_id", "word"), ["query_id", "word"]).select("query_id", "fact_id", "sentence").distinct()
    kept = words.join(key, ["query_id", "fact_id", "sentence"]).join(rare.select("query_id", "word"), ["query_id", "word"]).join(anchor, "query_id")
    kept = graphs.saved(kept)
    a = kept.select("query_id", "word", "anchor", F.col("fact_id").alias("a"), F.col("sentence").alias("sa"))
    b = kept.select("query_id", "word", F.col("fact_id").alias("b"), F.col("sentence").alias("sb"))
    shared = a.join(b, ["query_id", "word"]).filter("a < b").groupBy("query_id", "a", "sa", "b", "sb").agg(F.count("*").alias("n"), F.bool_or(F.col("word") == F.col("anchor")).alias("anchored"))
    pairs = shared.groupBy("query_id", "a", "b").agg(F.max("n").alias("n"), F.bool_or("anchored").alias("anchored")).filter("n >= 2 AND anchored")
    node = lambda c: F.struct("query_id", F.col(c).alias("fact_id"))
    of = graphs.components(pairs.select(node("a").alias("a"), node("b").alias("b")), pool.select(node("fact_id").alias("id")))
    dated = of.select("id.query_id", "id.fact_id", "component").join(pool.select("query_id", "fact_id", "valid_from"), ["query_id", "fact_id"]).filter("valid_from IS NOT NULL")
    newest = dated.groupBy("component").agg(F.max(F.struct("valid_from", -F.col("fact_id"), "fact_id")).alias("top"))
    old = dated.join(newest, "component").filter(F.col("valid_from") < F.col("top.valid_from"))
    return old.select("query_id", F.col("fact_id").alias("old_id"), F.col("top.fact_id").alias("new_id"))
