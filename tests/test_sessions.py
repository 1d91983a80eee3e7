"""Sessions as a stateful stream: its rules, the stream itself with its restarts, and its batch twin."""

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recollect.config import CONFIG
from recollect.streaming import ingest, sessions

M = sessions.MINUTE


def test_due():
    row = lambda k, minute: (k, minute * M, "x")
    none = sessions.Progress()
    state = lambda rows, minute, p=none: (lambda s, t: (s, [r[0] for r in t]))(*sessions.due(rows, p, minute * M, CONFIG))
    assert state([row(1, 0), row(2, 10)], 189) == ("waiting", [])
    assert state([row(1, 0), row(2, 10)], 190) == ("idle", [1, 2])
    assert state([row(1, 0), row(2, 355), row(3, 358)], 360) == ("capped", [1, 2])
    assert state([row(k, 100) for k in range(300)], 101) == ("settling", [])
    assert state([row(k, 100) for k in range(300)], 105) == ("capped", list(range(300)))
    assert state([row(1, 0)], 999, sessions.Progress(0, 1, 0, 1000 * M)) == ("failed", [])


def test_a_timer_stands_where_something_changes():
    rng = random.Random(4)
    config = replace(CONFIG, idle_minutes=20, cap_hours=0.5, cap_messages=6, settle_minutes=3)
    for _ in range(300):
        rows = sorted((k, rng.randrange(60) * M, "x") for k in range(rng.randint(1, 8)))
        progress = sessions.Progress(0, 1, 0, rng.randrange(90) * M) if rng.random() < 0.3 else sessions.Progress()
        now = 60 * M
        if not sessions.due(rows, progress, now, config)[1]:
            wakes = sessions.wakes(rows, progress, now, config)
            first = next(t for t in range(now + 1, now + 500 * M, M // 4) if sessions.due(rows, progress, t, config)[1])
            assert now < wakes <= first  # never later than the first moment; where it is earlier, another timer follows


def test_failures():
    p, outcomes = sessions.Progress(), []
    for k in range(5):
        p, dead = sessions.failed(p, False, k * M, CONFIG)
        outcomes.append(((p.next_try - k * M) // M, dead))
    assert outcomes == [(10, False), (20, False), (40, False), (60, False), (60, True)]
    p = sessions.failed(sessions.Progress(), False, 0, CONFIG)[0]
    assert sessions.failed(p, False, 24 * 60 * M, CONFIG)[1]  # a day later there is no further try
    p = sessions.failed(sessions.failed(sessions.Progress(), True, 0, CONFIG)[0], True, M, CONFIG)[0]
    assert sessions.failed(p, True, 2 * M, CONFIG)[1]


def test_chunks():
    rows = [(k, 0, "x" * n) for k, n in enumerate([5, 5, 1, 30, 2, 2])]
    assert [[r[0] for r in c] for c in sessions.chunks(rows, 10)] == [[0, 1], [2], [3], [4, 5]]


def worker():
    def work(session, rows):
        """By the session's name: always done, fails for good, or fails."""
        ids = ",".join(str(r[0]) for r in rows)
        return (session.startswith("good"), session.startswith("poison"), ids)

    return work  # not a function of this module, which workers can't import


SECOND = 1 / 60
FAST = replace(CONFIG, idle_minutes=2 * SECOND, cap_hours=1000, cap_messages=4, settle_minutes=0, backoff_minutes=(SECOND / 4,) * 5, permanent_tries=2, chunk_chars=6000)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


ARRIVALS = [
    [("good a", 2, "b"), ("good a", 1, "a"), ("good b", 1, "x"), ("good b", 2, "x"), ("good b", 3, "x"), ("good b", 4, "x"), ("good b", 5, "x"), ("bad", 7, "x"), ("poison", 3, "x")],
    [("good a", 2, "again"), ("good a", 3, None), ("good c", None, "no id"), ("bad", 8, "y")],
]


def test_stream_restarts_and_dead_letters(rocks, tmp_path):
    source = tmp_path / "in"

    def arrive(k):
        rows = rocks.createDataFrame(ARRIVALS[k], "session string, id long, body string").withColumn("ts", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(str(source))

    def run(until):
        stream = rocks.readStream.schema("session string, id long, body string, ts timestamp").parquet(str(source))
        out = sessions.worked(stream, worker(), FAST)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
        try:
            for _ in range(240):
                time.sleep(0.5)
                assert query.exception() is None
                rows = [tuple(r) for r in rocks.read.schema(sessions.OUTPUT).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
                if until(rows):
                    return rows
        finally:
            query.stop()
        raise AssertionError(rows)

    arrive(0)
    first = run(lambda rows: any(r[0] == "good b" for r in rows))  # stopped while others wait
    assert any(r[:2] + r[3:] == ("good b", "done", 1, 5, 5, 1, "1,2,3,4,5") for r in first)  # capped, or idle where the first batch took long
    arrive(1)
    rows = run(lambda rows: {r[0] for r in rows} == {"good a", "good b", "bad", "poison"} and sum(r[5] for r in rows if r[0] in ("good a", "bad")) == 5)
    ids = lambda session, kind: [x for r in sorted(rows, key=lambda r: r[3]) if r[0] == session and r[1] == kind for x in r[7].split(",")]
    assert ids("good a", "done") == ["1", "2", "3"] and ids("good b", "done") == ["1", "2", "3", "4", "5"]
    assert ids("bad", "dead") == ["7", "8"] and {r[6] for r in rows if r[0] == "bad"} == {5}
    assert ids("poison", "dead") == ["3"] and {r[6] for r in rows if r[0] == "poison"} == {2}

    # The batch twin on the same arrivals, looked at when all of them are quiet.
    flat = {(s, i) for part in ARRIVALS for s, i, _ in part if i is not None}
    pending = rocks.createDataFrame([(s, i, "2024-01-01 00:00:00") for s, i in flat], "session string, id long, t string").select("session", "id", F.col("t").cast("timestamp").alias("ts"))
    cursor, now, done, dead = rocks.createDataFrame([], "session string, last_id long, fails int, failed_at timestamp, first_failed_at timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp"), set(), set()
    steps = lambda t: t.groupBy("session").agg(F.lit("r").alias("result")).withColumns({"ok": F.col("session").startswith("good"), "permanent": F.col("session").startswith("poison")})
    for k in range(5):
        at = now + F.make_interval(hours=F.lit(2 * k))
        taken = ingest.take_due(pending, cursor, at).cache()
        out, cursor, letters = ingest.process(taken, cursor, at, steps, replace(CONFIG, permanent_tries=2))
        cursor = rocks.createDataFrame(cursor.collect(), cursor.schema)
        done |= {(r["session"], r["id"]) for r in taken.join(out, "session").collect()}
        dead |= {(r["session"], r["id"]) for r in taken.join(letters, "session").collect()}
    assert done == {(r[0], int(x)) for r in rows if r[1] == "done" for x in r[7].split(",")}
    assert dead == {(r[0], int(x)) for r in rows if r[1] == "dead" for x in r[7].split(",")}
