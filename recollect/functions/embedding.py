"""Embeddings by a replaceable function, computed once for each text.

An embedder is named as ``module:function``; the function takes a list of texts and gives a vector of floats for each.  A task loads it once and calls it in
batches.  What it gave is kept in a table by the hash of the text (and the embedder's name and version), so equal texts and later runs cost no call, and only
facts that have no vector yet are looked at.

Results for odd input: null and blank texts have no vector; a batch for which the embedder fails, or gives another number of vectors or lengths that differ, fails the run
before anything is written; equal texts get equal vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 64
CACHE = "text_hash string, vec array<float>"


def loaded(name: str) -> Callable[[list[str]], list[list[float]]]:
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"an embedder is named module:function, not {name!r}")
    return getattr(import_module(module), function)


def text_hash(content: Column, embedder: str, version: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(embedder), F.lit(version), content), 256)


def embed(texts: DataFrame, embedder: str, batch: int = BATCH) -> DataFrame:
    """(text_hash, vec) of texts (text_hash, content)."""

    def run(frames):
        call, size = loaded(embedder), None
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                vectors = call(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{embedder} gave {len(vectors)} vectors for {len(part)} texts")
                for v in vectors:
                    size = len(v) if size is None else size
                    if len(v) != size or not size:
                        raise ValueError(f"{embedder} gave vectors of different lengths")
                yield pd.DataFrame({"text_hash": part["text_hash"].to_numpy(), "vec": [list(map(float, v)) for v in vectors]})

    return texts.select("text_hash", "content").mapInPandas(run, CACHE)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], CACHE)


def filled(facts: DataFrame, path: str, embedder: str, version: str = "1", batch: int = BATCH) -> int:
    """Adds the vectors that facts (fact_id, content) lack to the table at `path`; returns how many texts were embedded."""
    spark = facts.sparkSession
    rows = facts.filter(F.trim("content") != "").select(text_hash(F.col("content"), embedder, version).alias("text_hash"), "content")
    missing = rows.join(cached(spark, path).select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.first("content").alias("content"))
    before = cached(spark, path).count()
    embed(missing, embedder, batch).write.mode("append").parquet(path)
    return cached(spark, path).count() - before


def vectors(facts: DataFrame, path: str, embedder: str, version: str = "1") -> DataFrame:
    """fact_id and vec of the facts whose text has one."""
    rows = facts.select("fact_id", text_hash(F.col("content"), embedder, version).alias("text_hash"))
    return rows.join(cached(facts.sparkSession, path), "text_hash").select("fact_id", "vec")


def backlog(facts: DataFrame, path: str, embedder: str, version: str = "1") -> DataFrame:
    """fact_id of the facts with a text that has no vector yet."""
    rows = facts.filter(F.trim("content") != "").select("fact_id", text_hash(F.col("content"), embedder, version).alias("text_hash"))
    return rows.join(cached(facts.sparkSession, path).select("text_hash"), "text_hash", "left_anti").select("fact_id")
