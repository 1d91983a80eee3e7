"""Intervals of what held against a replay in the order of time."""

import random
from datetime import datetime, timedelta

import pytest

from recollect.operators import validity

START = datetime(2024, 1, 1)
SCHEMA = "subject string, key string, at timestamp, value string, fact_id long, update boolean"


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = None if rng.random() < 0.02 else START + timedelta(hours=rng.randrange(24 * 200))
        out.append((rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice(["k", "l"]), at, rng.choice(["x", "y", "z", None]), k, rng.choice([True, True, True, None, False])))
    return out


def replay(facts, slot, until=None):
    """The values that the facts of a slot leave, one after the other: [(at, value, fact_id)]."""
    rows = sorted((f[2], f[4], f[3]) for f in facts if f[:2] == slot and f[2] is not None and f[5] is not False and (until is None or f[2] <= until))
    by_moment = {at: (i, v) for at, i, v in rows}
    out = []
    for at, (i, v) in sorted(by_moment.items()):
        if not out or out[-1][1] != v:
            out.append((at, v, i))
    return out


@pytest.fixture(scope="module")
def facts(spark):
    rows = made(900, 3)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def slots(rows):
    return {f[:2] for f in rows if f[0] is not None}


def by_slot(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["subject"], r["key"]), []).append((r["valid_from"], r["valid_to"], r["value"], r["fact_id"]))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def test_intervals(facts):
    rows, df = facts
    got = by_slot(validity.intervals(df))
    want = {s: [(at, nxt[0] if nxt else None, v, i) for (at, v, i), nxt in zip(r, [*r[1:], None], strict=True)] for s in slots(rows) if (r := replay(rows, s))}
    assert got == want


def test_state_at_three_dates(spark, facts):
    rows, df = facts
    known = validity.intervals(df)
    asked = [(k, *s, START + timedelta(days=day, hours=5)) for k, (s, day) in enumerate((s, d) for s in sorted(slots(rows)) for d in (-1, 0, 64, 199))]
    asked += [(len(asked), "nobody", "k", START), (len(asked) + 1, *asked[3][1:3], replay(rows, asked[3][1:3])[5][0])]  # and the very moment of a change
    out = validity.as_of(known, spark.createDataFrame(asked, "question_id long, subject string, key string, at timestamp")).collect()
    assert len(out) == len(asked)
    for r in out:
        state = replay(rows, (r["subject"], r["key"]), r["at"])
        assert (r["value"], r["fact_id"], r["since"]) == ((state[-1][1], state[-1][2], state[-1][0]) if state else (None, None, None))


def test_a_late_fact_changes_its_slot_alone(spark, facts):
    rows, df = facts
    late = [("a", "k", START + timedelta(days=70), "late", 5000, True)]
    before, after = by_slot(validity.intervals(df)), by_slot(validity.refolded(validity.intervals(df), df, spark.createDataFrame(late, SCHEMA)))
    assert {k: v for k, v in before.items() if k != ("a", "k")} == {k: v for k, v in after.items() if k != ("a", "k")}
    assert after == by_slot(validity.intervals(spark.createDataFrame(rows + late, SCHEMA))) and after["a", "k"] != before["a", "k"]


def test_backfill(spark, facts):
    rows, df = facts
    store = spark.createDataFrame([(*f, None if f[4] % 3 else START) for f in rows], SCHEMA + ", valid_to timestamp")
    out = {r["fact_id"]: r["valid_to"] for r in validity.backfilled(validity.intervals(df), store).collect()}
    for s in slots(rows):
        held = replay(rows, s)
        moments = {f[2]: max(g[4] for g in rows if g[:2] == s and g[2] == f[2] and g[5] is not False) for f in rows if f[:2] == s and f[2] is not None and f[5] is not False}
        for at, i in moments.items():
            if i % 3:
                later = [x[0] for x in held if x[0] > at]
                assert out.get(i) == (later[0] if later else None)
            else:
                assert i not in out


def test_promotion(spark):
    facts = [(1, "a", "k", "x", "candidate", False), (2, "a", "k", "y", "candidate", False), (3, "a", "k", "x", "confirmed", False), (4, "a", "k", "x", "candidate", True), (5, "b", "k", "x", "candidate", False), (6, "c", "k", None, "candidate", None)]
    winners = [("a", "k", "x"), ("b", "k", "x"), ("b", "k", "y"), ("c", "k", "z")]
    out = validity.promoted(spark.createDataFrame(facts, "fact_id long, subject string, key string, value string, status string, pinned boolean"), spark.createDataFrame(winners, "subject string, key string, value string"))
    assert {r["fact_id"]: r["status"] for r in out.collect()} == {1: "confirmed", 2: "uncertain", 6: "uncertain"}
