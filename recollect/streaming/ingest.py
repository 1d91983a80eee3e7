"""Incremental ingest: transcript lines become evidence, once each, as files grow.

A run looks at the files that are new or changed since the last one (by size and time) and reads each on from the line it came to, or from
the beginning if it has shrunk.  Progress is by arrival and not by event time, so late records are never dropped; exactly-once comes
from an anti-join on the record's identity together with a ledger; the places in the files are written last, so a run that breaks off is
only repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import CONFIG, Config
from recollect.functions import redaction
from recollect.operators import timeline
from recollect.sources import tail, transcripts

IDENTITY = ("path", "line", "sha")


def evidence_rows(lines: DataFrame) -> DataFrame:
    """path, line, actor, content (redacted), sha and occurred_at."""
    rows = transcripts.parsed(lines)
    actor = F.when(F.col("role") == "user", CONFIG.owner).when(F.col("role") == "assistant", CONFIG.assistants[0])
    clean = redaction.redacted(F.col("body"))
    return rows.select("path", "line", actor.alias("actor"), clean.alias("content"), F.sha2(clean, 256).alias("sha"), F.col("ts").alias("occurred_at")).filter("actor IS NOT NULL")


def append_new(spark: SparkSession, rows: DataFrame, store: str, batch_id: int) -> None:
    """Appends the rows that the store lacks; then the ledger row, so that readers see whole batches only."""
    ledger = f"{store}/ledger"
    done = _read(spark, ledger, "batch_id long")
    if done.filter(F.col("batch_id") == batch_id).limit(1).count():
        return
    seen = _store(spark, store)
    new = rows.dropDuplicates(list(IDENTITY))
    if seen is not None:
        new = new.join(seen.select(*IDENTITY), list(IDENTITY), "left_anti")
    new.write.mode("overwrite").parquet(f"{store}/evidence/batch_id={batch_id}")
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").parquet(ledger)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _store(spark: SparkSession, store: str) -> DataFrame | None:
    """The committed evidence of a store: batches that the ledger names."""
    if not _exists(spark, f"{store}/ledger"):
        return None
    return spark.read.parquet(f"{store}/evidence").join(spark.read.parquet(f"{store}/ledger").distinct(), "batch_id", "left_semi")


def committed(spark: SparkSession, store: str) -> DataFrame | None:
    return _store(spark, store)


CURSOR = "path string, line int, size long, changed timestamp, run long"


def places(spark: SparkSession, store: str) -> DataFrame:
    """How far each file was read: path, line, size, changed."""
    seen = _read(spark, f"{store}/cursor", CURSOR)
    return seen.groupBy("path").agg(F.max_by(F.struct("line", "size", "changed"), "run").alias("c")).select("path", "c.*")


def collect(spark: SparkSession, source: str, store: str) -> None:
    """Takes in what the transcript files under `source` have gained since the last run."""
    files = spark.read.format("binaryFile").load(source).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    before = places(spark, store).select("path", "line", F.col("size").alias("old_size"), F.col("changed").alias("old_changed"))
    both = files.join(before, "path", "left").filter(F.col("old_size").isNull() | (F.col("size") != F.col("old_size")) | (F.col("changed") != F.col("old_changed")))
    start = F.when(F.col("size") >= F.col("old_size"), F.col("line")).otherwise(0)
    found = both.select("path", "size", "changed", F.coalesce(start, F.lit(0)).alias("start")).collect()  # a row for each changed file, which the driver has listed
    if not found:
        return
    changed = spark.createDataFrame(found, "path string, size long, changed timestamp, start int")
    lines = transcripts.read_lines(spark, [r["path"] for r in found]).join(changed, "path")
    run = (_read(spark, f"{store}/ledger", "batch_id long").agg(F.max("batch_id")).first()[0] or 0) + 1
    append_new(spark, evidence_rows(lines.filter(F.col("line") > F.col("start")).select("path", "line", "value")), store, run)
    # A last line that no line break ends may still grow: it is read again.
    ends = lines.groupBy("path").agg(F.max("line").alias("line"))
    reached = changed.join(ends, "path", "left").select("path", F.greatest(F.coalesce("line", F.lit(0)) - 1, F.lit(0)).cast("int").alias("line"), "size", "changed", F.lit(run).cast("long").alias("run"))
    reached.write.mode("append").parquet(f"{store}/cursor")


def follow(spark: SparkSession, source: str, store: str) -> None:
    """The same for a folder whose files are complete when they appear: a file stream takes each once."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(source)
    named = files.select(F.col("_metadata.file_path").alias("path"), "value")

    def batch(df: DataFrame, batch_id: int) -> None:
        lines = df.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1).filter(F.length("value") > 0)
        append_new(df.sparkSession, evidence_rows(lines), store, batch_id)

    named.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@dataclass(frozen=True)
class Speakers:
    """Who is who in transcripts: senders by id and by name, the owner of plain words, the assistant, and how tasks of programs begin."""

    by_id: dict[str, str] = field(default_factory=dict)
    by_name: dict[str, str] = field(default_factory=dict)
    owner: str = CONFIG.owner
    assistant: str = CONFIG.assistants[0]
    task: str = "TASK:"


def follow_growing(spark: SparkSession, source: str, store: str, speakers: Speakers = Speakers(), range_bytes: int = tail.RANGE) -> None:  # noqa: B008
    """Takes in what the transcript files under `source` have gained, up to now: appended bytes alone are read, each channel block is a row.

    Evidence has path, line (the byte at which the line begins), actor, content, sha, occurred_at; rows of unknown senders are counted in the
    store's ``unknown`` and go no further.  Whether a session is a task is settled by its first words, which are kept in ``sessions``.
    """
    tail.register(spark)
    lines = spark.readStream.format("growing_lines").option("rangeBytes", range_bytes).load(source)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        seen = _read(spark, f"{store}/sessions", "path string, task boolean, batch long").select("path", "task").distinct()
        known = seen.select("path")
        named = df.join(known, "path", "left_anti")
        first = transcripts.first_words(named).select("path", F.ltrim("first").startswith(speakers.task).alias("task"), F.lit(batch_id).cast("long").alias("batch"))
        first.write.mode("append").parquet(f"{store}/sessions")
        tasks = seen.unionByName(first.select("path", "task")).filter("task").select("path").distinct()
        said = transcripts.harvested(df, speakers.task, speakers.by_id, speakers.by_name, speakers.owner, speakers.assistant, tasks=tasks)
        clean = redaction.redacted(F.col("body"))
        rows = said.select("path", F.col("position").alias("line"), "actor", clean.alias("content"), F.sha2(clean, 256).alias("sha"), F.col("ts").alias("occurred_at"))
        append_new(spark, rows.filter("actor IS NOT NULL"), store, batch_id)
        rows.filter("actor IS NULL").groupBy("path").agg(F.count("*").alias("n")).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{store}/unknown")
        df.unpersist()

    lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/lines-checkpoint").trigger(availableNow=True).start().awaitTermination()


# -- sessions -------------------------------------------------------------------------------------


def backoff(fails: Column, config: Config = CONFIG) -> Column:
    """Minutes to wait after so many failures; the last step repeats."""
    steps = F.array(*map(F.lit, config.backoff_minutes))
    return F.when(fails > 0, F.element_at(steps, F.least(fails, F.lit(len(config.backoff_minutes))))).otherwise(0)


def take_due(pending: DataFrame, cursor: DataFrame, now: Column, config: Config = CONFIG, baseline: int = -1) -> DataFrame:
    """The pending rows (session, id, ts) of due sessions beyond their cursor (session, last_id, fails, failed_at) and the baseline, without
    the newest that still settle."""
    rows = pending.filter(F.col("id") > baseline).join(cursor, "session", "left").filter(F.col("last_id").isNull() | (F.col("id") > F.col("last_id")))
    due = timeline.due_sessions(rows.select("session", "ts"), now, config).filter(F.col("state").isin("idle", "capped")).select("session", "state")
    waits = F.coalesce(F.col("failed_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")) + F.make_interval(mins=backoff(F.coalesce("fails", F.lit(0)), config))
    settled = F.col("ts").cast("timestamp") <= now.cast("timestamp") - F.expr(f"INTERVAL {config.settle_minutes} MINUTES")
    return rows.filter(waits <= now.cast("timestamp")).join(due, "session").filter((F.col("state") == "idle") | settled).select("session", "id", "ts", "state")


def process(taken: DataFrame, cursor: DataFrame, now: Column, work: Callable[[DataFrame], DataFrame], config: Config = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, the whole new cursor, dead letters).  `work` gives a row for each session with ``ok``, ``permanent`` and ``result``.

    A session that fails keeps its place and counts the failure, from whose time it waits.  At the last step of the wait, after `permanent_tries` of a
    failure that is permanent, or when `dead_hours` have passed since the first one, it is skipped past and becomes a dead letter.  Sessions that were not
    taken keep their rows.  `streaming.sessions` does the same as one stream.
    """
    if "first_failed_at" not in cursor.columns:
        cursor = cursor.withColumn("first_failed_at", F.col("failed_at"))
    moment = now.cast("timestamp")
    ends = taken.groupBy("session").agg(F.max("id").alias("end"))
    both = work(taken).join(ends, "session").join(cursor, "session", "left")
    fails = F.when(F.col("ok"), 0).otherwise(F.coalesce("fails", F.lit(0)) + 1)
    first = F.when(fails > 1, F.coalesce(F.col("first_failed_at").cast("timestamp"), moment)).otherwise(moment)
    tries = F.when(F.coalesce("permanent", F.lit(False)), config.permanent_tries).otherwise(len(config.backoff_minutes))
    late = F.unix_seconds(moment) - F.unix_seconds(first) >= config.dead_hours * 3600
    dead = ~F.col("ok") & ((fails >= tries) | late)
    waits = ~F.col("ok") & ~dead
    moved = both.select(
        "session", F.when(F.col("ok") | dead, F.col("end")).otherwise(F.col("last_id")).alias("last_id"), F.when(dead, 0).otherwise(fails).cast("int").alias("fails"),
        F.when(waits, moment).alias("failed_at"), F.when(waits, first).alias("first_failed_at"),
    )
    rest = cursor.join(moved.select("session"), "session", "left_anti")
    rest = rest.select("session", "last_id", F.col("fails").cast("int").alias("fails"), *(F.col(c).cast("timestamp").alias(c) for c in ("failed_at", "first_failed_at")))
    letters = both.filter(dead).select("session", F.coalesce("last_id", F.lit(0)).alias("after"), "end")
    return both.filter("ok").select("session", "result"), moved.unionByName(rest), letters


def retried(cursor: DataFrame, letters: DataFrame) -> DataFrame:
    """`cursor` set back for the sessions of dead letters, so that they are taken anew."""
    again = letters.groupBy("session").agg(F.min("after").alias("after"))
    both = cursor.join(again, "session", "left")
    back = F.col("after").isNotNull()
    times = [F.when(~back, F.col(c)).alias(c) for c in ("failed_at", "first_failed_at") if c in cursor.columns]
    return both.select("session", F.when(back, F.least("last_id", "after")).otherwise(F.col("last_id")).alias("last_id"), F.when(back, 0).otherwise(F.col("fails")).cast("int").alias("fails"), *times)


def dropped(letters: DataFrame, sessions: list[str]) -> DataFrame:
    """The dead letters without those of some sessions, which somebody has looked at and given up."""
    return letters.filter(~F.col("session").isin(sessions))


def session_stream(events: DataFrame, seconds: int = CONFIG.idle_minutes * 60) -> DataFrame:
    """user_id, n, first and last of sessions of a stream (user_id, ts), each closed when nothing has arrived for so many seconds.

    It is arrival that counts, so a record that comes late belongs to the session that is open when it comes, and none is dropped.
    """

    def update(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "first": [first], "last": [last]})
            return
        n, first, last = state.get if state.exists else (0, None, None)
        for rows in batches:
            n += len(rows)
            first = rows["ts"].min() if first is None else min(first, rows["ts"].min())
            last = rows["ts"].max() if last is None else max(last, rows["ts"].max())
        state.update((n, first, last))
        state.setTimeoutDuration(seconds * 1000)

    at = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return at.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, first timestamp, last timestamp", "n long, first timestamp, last timestamp", "append", "ProcessingTimeTimeout")
