import pytest
from pyspark.sql import functions as F

from recollect import schemas
from recollect.config import CONFIG
from recollect.operators import pool
from recollect.functions import redaction, scores, text
from recollect.operators import gates, lifecycle, provenance, recall, timeline


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("age,kind,want", [(0.0, "semantic", 1.0), (240.0, "semantic", 0.5), (45.0, "episodic", 0.5), (-1.0, "semantic", 0.5), (None, "preference", 0.5), (730.0, "preference", 0.25)])
def test_decay(spark, age, kind, want):
    assert one(spark, scores.decay(F.lit(age).cast("double"), F.lit(kind))) == pytest.approx(want)


def test_activation(spark):
    act = lambda pinned, access: one(spark, scores.activation(F.lit(pinned), F.lit(0.5), F.lit(1.0), F.lit(access), F.lit(None).cast("double")))
    assert act(True, 0) == 10 and act(False, 0) == 0.7 and act(False, 100) == pytest.approx(1.18)


def test_bonuses_come_before_factors(spark):
    score = scores.adjusted(F.lit(0.02), pinned=F.lit(False), status=F.lit("confirmed"), layer=F.lit("cold"), fresh=F.lit(0.1), dated=F.lit(True))
    assert one(spark, score) == pytest.approx((0.02 + 0.012) * 0.5)


@pytest.mark.parametrize("s,want", [("", []), ("a", ["a"]), ("ab", ["ab"]), ("A b c", ["ab", "bc"]), ("你好吗", ["你好", "好吗"])])
def test_bigrams(spark, s, want):
    assert one(spark, text.bigrams(F.lit(s))) == want


@pytest.mark.parametrize("s,want", [("Short. Then more.", "Short. Then more."), ("A sentence of fair length. And then a lot more text follows.", "A sentence of fair length."), ("x" * 50, "x" * 40 + "…")])
def test_card(spark, s, want):
    assert one(spark, text.card(F.lit(s))) == want


PREFILTER = [
    ("OK!", "ack"), ("got it", "ack"), ("😀😀", "ack"), ("ping", "heartbeat"), ("Heartbeat_OK", "heartbeat"), ("a b", "too-short"), ("...", "too-short"), ("$ ls -la", "tool-output"), ("exit code: 1", "tool-output"), ('{"a": 1234}', "json-blob"),
    ('{"abcd": [1, 2', None), ("ValueError: no", "error-log"), ("Error: a\nTraceback of it\nand more\nfoo.BarException: x", "error-log"), ("Error: a\nis what I saw\nwhen I ran\nthe thing", None), ("2024-01-02 03:04:05 [ERROR] x", "error-log"),
    ("errors are made by everyone", None), ("I moved to Lisbon", None), ("", "too-short"),
]


@pytest.mark.parametrize("s,want", PREFILTER)
def test_prefilter(spark, s, want):
    assert one(spark, pool.prefiltered(F.lit(s), F.lit(False))) == want


def test_thoughts_are_the_assistants(spark):
    s = "Let me look at the file first. I should check what the test says about it. I will fix the code after that."
    assert [one(spark, pool.prefiltered(F.lit(s), F.lit(a))) for a in (True, False)] == ["thought", None]


def test_redaction(spark):
    secret = "AKIA" + "A" * 16
    assert one(spark, redaction.redacted(F.lit(f"key {secret} end"))) == "key [redacted:aws:AKIA…AA] end"


def test_clause_type(spark):
    assert one(spark, text.clause_type(F.lit("I love green tea, I prefer it cold")))["fact_type"] == "preference"
    assert one(spark, text.clause_type(F.lit("We walked home")))["fact_type"] == "episodic"


@pytest.mark.parametrize("s,mode", [("hello", "skip"), ("/reset", "skip"), ("do you remember the green house?", "deep"), ("the green house burned", "light"), ("??", "skip")])
def test_route(spark, s, mode):
    assert one(spark, gates.route(F.lit(s)))["mode"] == mode


def test_expected_answers(spark):
    wanted, has = gates.satisfied(F.lit("How many cats?"), F.array(F.lit("some"), F.lit("she has 3")))
    assert one(spark, wanted) == "number" and one(spark, has)


def test_sufficiency(spark):
    s = lambda *a: one(spark, gates.sufficiency(*map(F.lit, a)))
    assert s(0.9, 0.9, 5, False, False)["verdict"] == "enough" and s(0.5, 0.5, 3, False, False)["verdict"] == "tip-of-tongue"
    assert s(0.9, 0.9, 5, True, False)["confidence"] == 0.35 and s(0.9, 0.9, 5, False, True)["verdict"] == "escalate"


def test_fact_check(spark):
    lines = spark.createDataFrame([(1, "user", "I have 3 cats"), (1, "assistant_a", "you have 4 dogs")], "chunk int, actor string, body string")
    rows = [(1, "user", "has cats", "have 3 cats"), (1, "user", "has dogs", "have 4 dogs"), (1, "user", "x", "no such words"), (1, "user", "has 5 cats", "have 3 cats"), (1, "user", "y", "I")]
    got = gates.fact_check(spark.createDataFrame(rows, "chunk int, subject string, content string, quote string"), lines)
    assert {r["content"]: r["reason"] for r in got.collect()} == {"has cats": None, "has dogs": "echo", "x": "not-verbatim", "has 5 cats": "number", "y": "short-quote"}


def test_stale_reasons(spark):
    fields = ["id", "subject", "status", "pinned", "at", "valid_to", "key", "value", "polarity"]
    row = lambda **k: tuple((dict(id=1, subject=CONFIG.owner, status="candidate", pinned=False, at=1, valid_to=None, key="k", value="a", polarity=True) | k)[f] for f in fields)
    cases = {"same-row": {}, "subject": dict(id=2, subject="us"), "new-not-live": dict(id=2, status="invalid"), "not-later": dict(id=2), "key": dict(id=2, at=2, key="z"), "same-value": dict(id=2, at=2), "ok": dict(id=2, at=2, value="b")}
    kinds = ["long", "string", "string", "boolean", "long", "long", "string", "string", "boolean"]
    schema = ", ".join(f"{side}_{f} {k}" for side in ("old", "new") for f, k in zip(fields, kinds, strict=True))
    rows = spark.createDataFrame([row() + row(**c) for c in cases.values()], schema)
    rows = rows.withColumns({"own": F.lit(True), "slot": F.lit(None).cast("string")})
    assert [r[0] for r in rows.select(provenance.stale_reason()).collect()] == list(cases)


def test_state_log(spark):
    from datetime import datetime

    now = F.lit(datetime(2024, 2, 1))
    base = (1, 1, "candidate", None, "active", False, 0.5, None, 0.5, 0, None, datetime(2024, 1, 1))
    log = spark.createDataFrame([base, (2, *base[1:])], schemas.FACT_STATE)
    new, late = lifecycle.confirm(log, spark.createDataFrame([(1, 1), (2, 7)], "fact_id long, expected int"), now)
    assert [(r["fact_id"], r["version"], r["status"]) for r in new.collect()] == [(1, 2, "confirmed")] and late.count() == 1
    both = log.unionByName(new)
    assert {r["fact_id"]: r["status"] for r in lifecycle.current(both).collect()} == {1: "confirmed", 2: "candidate"}
    with pytest.raises(ValueError):
        lifecycle.supersede(log, new, now)
    assert schemas.changed(log, both, "fact_id", "version").count() == 0 and schemas.bad_enums(both).count() == 0


def test_due_sessions(spark):
    rows = [("idle", 181), ("busy", 1), ("waiting", 60), ("old", 60), ("old", 400)]
    pending = spark.createDataFrame(rows, "session string, m int").select("session", F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, 0, m, 0)").alias("ts"))
    got = timeline.due_sessions(pending, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    assert {r["session"]: r["state"] for r in got.collect()} == {"idle": "idle", "busy": "settling", "waiting": "waiting", "old": "capped"}


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, fact_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "query_id string, fact_id long, rank int")
    got = {r["fact_id"]: (r["rrf"], r["via"]) for r in recall.fuse(("a", a), ("b", b)).collect()}
    assert got[1] == (pytest.approx(1 / 61), "a") and got[2] == (pytest.approx(1 / 62 + 1 / 61), "a,b")
