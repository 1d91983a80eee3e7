import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.sources import transcripts
from recollect.streaming import ingest


def record(role, content, **more):
    return json.dumps({"type": role, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content}} | more)


LINES = [
    record("user", "hello there"),
    record("assistant", [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "reply", "input": {"text": "again"}}]),
    record("user", "meta", isMeta=True),
    "{not json",
    record("system", "x"),
]


def test_parsed(spark):
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate(LINES)], "path string, line int, value string")
    assert [(r["role"], r["body"]) for r in transcripts.parsed(rows).orderBy("line").collect()] == [("user", "hello there"), ("assistant", "hi\nagain"), ("system", "x")]


def test_windows(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(json.loads(record(role, f"said {k}")) | {"timestamp": f"2024-01-0{k}T00:00:00Z"}) for k, role in ((3, "user"), (1, "user"), (2, "assistant"), (2, "system"))))
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    assert [(r["line"], r["body"]) for r in transcripts.windowed(spark, str(tmp_path), at(1), at(3), ["user", "assistant"]).collect()] == [(2, "said 1"), (3, "said 2")]


def test_settings(tmp_path):
    from recollect.config import Config, Switches

    (tmp_path / "c.json").write_text(json.dumps({"owner": "ann", "assistants": ["bot"], "keep": 3}))
    found = Config.load(str(tmp_path / "c.json"))
    assert (found.owner, found.assistants, found.keep, found.rrf_k) == ("ann", ("bot",), 3, 60)
    (tmp_path / "c.json").write_text('{"none": 1}')
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "c.json"))
    s = Switches({"RECOLLECT_A": "yes", "RECOLLECT_B": "0"})
    assert s.on("A") and not s.on("B") and not s.on("C") and s.require("A") == "yes"
    with pytest.raises(KeyError):
        s.require("C")


def test_digest_and_quotes(spark):
    rows = spark.createDataFrame([("f", "- likes tea (lines 2-70)"), ("f", "* one (line 5)"), ("f", "text")], "path string, value string")
    found = transcripts.digest(rows)
    assert {(r["statement"], r["low"], r["high"]) for r in found.collect()} == {("likes tea", 2, 70), ("one", 5, 5)}
    lines = spark.createDataFrame([("f", k, "I like tea" if k in (1, 66) else "no") for k in range(100)], "path string, line int, body string")
    quotes = found.withColumn("quote", F.lit("like tea"))
    assert {r["low"]: r["line"] for r in transcripts.located(quotes, lines).collect()} == {2: 66, 5: None}


@pytest.mark.parametrize("take", [ingest.collect, ingest.follow])
def test_each_line_is_taken_once(spark, tmp_path, take):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(LINES))
    take(spark, str(source), str(store))
    assert ingest.committed(spark, str(store)).count() == 2
    (source / "b.jsonl").write_text(LINES[0] + "\n" + LINES[0])
    take(spark, str(source), str(store))
    take(spark, str(source), str(store))
    rows = ingest.committed(spark, str(store))
    assert rows.count() == 4
    ingest.append_new(spark, rows.drop("batch_id"), str(store), 99)  # a replay under another number adds nothing
    assert ingest.committed(spark, str(store)).count() == 4


def test_files_that_grow_and_shrink(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    file, count = source / "a.jsonl", lambda: ingest.committed(spark, str(store)).count()
    file.write_text(record("user", "one") + "\n")
    ingest.collect(spark, str(source), str(store))
    assert count() == 1
    with file.open("a") as f:
        f.write(record("user", "two") + "\n" + record("user", "thr")[:30])  # the last line is not whole yet
    ingest.collect(spark, str(source), str(store))
    assert count() == 2
    file.write_text("\n".join(record("user", x) for x in ("one", "two", "three", "four")))
    ingest.collect(spark, str(source), str(store))
    ingest.collect(spark, str(source), str(store))
    assert count() == 4
    file.write_text(record("user", "new"))  # shorter: read from the beginning
    ingest.collect(spark, str(source), str(store))
    assert count() == 5
    assert [r["line"] for r in ingest.committed(spark, str(store)).orderBy("line", "content").collect()] == [1, 1, 2, 3, 4]
    ingest.places(spark, str(store)).count()


def test_uncommitted_batches_are_not_seen(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = ingest.evidence_rows(spark.createDataFrame([("f", 1, LINES[0])], "path string, line int, value string"))
    ingest.append_new(spark, rows, store, 0)
    rows.write.parquet(f"{store}/evidence/batch_id=1")  # the run ended before its ledger row
    assert ingest.committed(spark, store).count() == 1


CURSOR = "session string, last_id long, fails int, failed_at timestamp"


def test_rounds_of_sessions(spark):
    at = lambda t: F.lit(t).cast("timestamp")
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:01:00"), ("b", 3, "2024-01-01 23:59:00"), ("c", 4, "2024-01-01 01:00:00"), ("d", 5, "2024-01-01 02:00:00")]
    pending = spark.createDataFrame(rows, "session string, id long, t string").select("session", "id", F.col("t").cast("timestamp").alias("ts"))
    cursor = spark.createDataFrame([("a", 1, 0, None), ("z", 9, 0, None)], CURSOR)
    work = lambda t: t.select("session").distinct().withColumns({"ok": F.col("session") == "a", "permanent": F.col("session") == "d", "result": F.lit("r")})
    state = lambda c: {r["session"]: (r["last_id"], r["fails"], r["failed_at"] is not None) for r in c.collect()}

    now = at("2024-01-02 00:00:00")
    taken = ingest.take_due(pending, cursor, now)
    assert sorted((r["session"], r["id"]) for r in taken.collect()) == [("a", 2), ("c", 4), ("d", 5)]
    once = replace(CONFIG, permanent_tries=1)
    out, cursor, dead = ingest.process(taken, cursor, now, work, once)
    assert [r["session"] for r in out.collect()] == ["a"] and [tuple(r) for r in dead.collect()] == [("d", 0, 5)]
    assert state(cursor) == {"a": (2, 0, False), "c": (None, 1, True), "d": (5, 0, False), "z": (9, 0, False)}

    assert ingest.take_due(pending, cursor, at("2024-01-02 00:09:00")).count() == 0  # c waits ten minutes
    now = at("2024-01-02 06:00:00")
    taken = ingest.take_due(pending, cursor, now)
    assert sorted(r["session"] for r in taken.collect()) == ["b", "c"]
    _, cursor, _ = ingest.process(taken, cursor, now, work, once)
    assert state(cursor)["c"] == (None, 2, True) and state(cursor)["b"] == (None, 1, True) and state(cursor)["z"] == (9, 0, False)
    assert state(ingest.retried(cursor, dead))["d"] == (0, 0, False)
    assert ingest.take_due(pending, cursor, now, baseline=5).count() == 0

    last = spark.createDataFrame([("c", None, 4, None)], CURSOR)
    _, moved, dead = ingest.process(ingest.take_due(pending.filter("session = 'c'"), last, now), last, now, work)
    assert state(moved) == {"c": (4, 0, False)} and dead.count() == 1  # the fifth failure
    assert ingest.dropped(dead, ["c"]).count() == 0 and ingest.dropped(dead, ["a"]).count() == 1

    # A permanent failure is tried three times, any failure for a day.
    for fails, first, name, n in ((1, None, "d", 0), (2, None, "d", 1), (1, "2024-01-01 06:00:01", "c", 0), (1, "2024-01-01 06:00:00", "c", 1)):
        held = spark.createDataFrame([(name, None, fails, None, first)], CURSOR + ", first_failed_at string")
        _, moved, dead = ingest.process(ingest.take_due(pending.filter(F.col("session") == name), held, now), held, now, work)
        assert (dead.count(), state(moved)[name][1]) == (n, 0 if n else fails + 1)


def test_late_records_are_not_dropped(spark, tmp_path):
    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(list(r), "user_id long, t string").select("user_id", F.col("t").cast("timestamp").alias("ts"))
    rows((1, "2024-01-05 00:00:00"), (2, "2024-01-05 00:00:00")).coalesce(1).write.mode("append").parquet(str(source))
    rows((1, "2020-01-01 00:00:00")).coalesce(1).write.mode("append").parquet(str(source))  # years late
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    run = ingest.session_stream(stream, 4).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("closed").count() == 2:
                break
    finally:
        run.stop()
    assert sorted((r["user_id"], r["n"]) for r in spark.table("closed").collect()) == [(1, 2), (2, 1)]


def test_backoff(spark):
    rows = spark.range(8).select(ingest.backoff(F.col("id").cast("int")).alias("m"))
    assert [r["m"] for r in rows.collect()] == [0, 10, 20, 40, 60, 60, 60, 60]
