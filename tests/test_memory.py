"""Owners, gates, redaction, names, records and notes, on small fixtures and against plain Python."""

import json
import math
import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions import redaction
from recollect.operators import entities, inputs, ownership, pool, records, value_gate


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


# -- whose matter


def test_asked_subject(spark):
    asked = {"what did I say about tea": "user", "Do you remember my birthday?": "user", "what is your plan": "assistant_a", "do you remember the trip": None, "did you and I agree": None, "tell me the name": None}
    assert each(spark, list(asked), ownership.asked_subject) == list(asked.values())
    who = {"has assistant_b called": "assistant_b", "my notes": "user", "my talk with assistant_b": None, "the weather": None}
    assert each(spark, list(who), ownership.inferred_who) == list(who.values())


def test_belongs(spark):
    rows = [
        ("us", "anything", [], "user", True), ("assistant_a", "user (2024-01-01): the user moved house", [], "user", True), ("assistant_a", "likes tea", [], "user", False),
        ("user", "assistant_a likes tea", [], "user", False), ("user", "likes tea", ["assistant_a"], "user", False), ("user", "likes tea", ["user"], "user", True), (None, "likes tea", [], "user", True),
    ]
    df = spark.createDataFrame(rows, "subject string, content string, actors array<string>, want string, yes boolean")
    got = df.select("yes", ownership.belongs_to(F.col("subject"), F.col("content"), F.col("actors"), F.col("want")).alias("x")).collect()
    assert all(r["yes"] == r["x"] for r in got)
    assert ownership.for_subject(df).count() == sum(r[4] for r in rows)


# -- the value gate


def test_consent_and_requests(spark):
    lines = {"Sure, go on": True, "ok but not today": False, "yes?": False, "Fine. Why?": True, "whatever you like": True, "no, leave it": False, "": False, "🙂 sounds good": True}
    assert each(spark, list(lines), value_gate.consents) == list(lines.values())
    asks = {"please stop that": None, "just kidding, stop": "joke", "why is it so": "question", "nice weather": "no-request", "you should rest": None}
    assert each(spark, list(asks), value_gate.request_reason) == list(asks.values())
    says = {"I promise": None, "maybe I will": "hedged", "<think>hm</think>": "thoughts", "the sky": "no-accept"}
    assert each(spark, list(says), value_gate.accept_reason) == list(says.values())


def test_roles(spark):
    rows = [
        ("us", "agreement", ["user"], True, "one-sided"), ("us", "agreement", ["user", "assistant_a"], False, "not-confirmed"), ("us", "agreement", ["user", "assistant_a"], True, None),
        ("us", "agreement", ["user", "assistant_b"], True, "agreement-needs-assistant"), ("user", "agreement", ["user"], True, "agreement-not-group"), ("user", "preference", ["assistant_a"], True, "assistant-only-subject"),
        ("assistant_a", "preference", ["assistant_a"], True, "assistant-only-kind"), ("assistant_a", "commitment", ["assistant_a"], True, None), ("user", "preference", ["user"], True, None), ("user", "commitment", ["user"], True, "kind-not-allowed"),
    ]
    df = spark.createDataFrame(rows, "s string, k string, a array<string>, c boolean, want string")
    got = df.select("want", value_gate.role_check(F.col("s"), F.col("k"), F.col("a"), F.col("c")).alias("x")).collect()
    assert all(r["want"] == r["x"] for r in got)


def test_postcheck(spark):
    rows = [
        ("user", "preference", "likes green tea", "green tea", "I like green tea a lot", None), ("user", None, "likes tea", "tea", "I like tea", "no-quote"), ("user", None, "likes green tea", "black tea", "green tea", "quote-not-said"),
        ("user", None, "Ｇreen TEA is fine", "ｇreen  tea", "Green, tea is fine", None), ("user", None, "he likes tea cups", "tea cups", "tea cups", "pronoun-subject"), ("user", None, "the job failed today", "failed today", "the job failed today", "process"),
        ("assistant_a", "commitment", "i promise the job that failed", "job that failed", "i promise the job that failed", None), ("user", None, "My mother said it rains", "it rains", "My mother said it rains", "retelling"),
        ("user", None, "told my mother said so", "said so", "told my mother said so", None), ("user", None, "jklm nopq rstu", "abcd", "abcd efgh", "ungrounded"), ("user", None, "gpt is useless", "useless", "gpt is useless", "verdict-on-others"),
    ]
    df = spark.createDataFrame(rows, "s string, k string, c string, q string, e string, want string")
    got = df.select("c", "want", value_gate.postcheck(F.col("s"), F.col("k"), F.col("c"), F.col("q"), F.col("e")).alias("x")).collect()
    assert [(r["c"], r["x"]) for r in got] == [(r["c"], r["want"]) for r in got]
    assert each(spark, ["short", "one two three four five six seven"], lambda c: value_gate.capped_quote(c, 24, 10)) == ["short", "one two three four five"]


# -- what comes in


def test_inputs(spark):
    text = "<system-reminder>x\ny</system-reminder>see /tmp/a.txt now\nphoto 12.jpg attached\nand  pic.png"
    assert each(spark, [text], inputs.without_wrappers) == ["see now\n \nand"]
    assert each(spark, ["<channel a=1>one</channel> x <channel>two </channel>", " plain "], inputs.incoming) == ["two", "plain"]
    assert each(spark, ["see NASA1 on 2024-01-02 with parser.py and parser.py"], inputs.marks) == [["NASA1", "2024-01-02", "parser.py"]]
    marks = F.array(F.lit("NASA1"), F.lit("parser.py"), F.lit("other"))
    assert each(spark, ["nasa1 and parser.py", "NASA1 alone", "parser.py other", "none"], lambda c: inputs.keyword_relevant(marks, c)) == [True, False, True, False]
    assert each(spark, ["x" * 800, "remember " + "x" * 800, "ok"], inputs.skip_reason) == ["long-paste", None, None]


def test_cjk_and_thoughts(spark):
    assert each(spark, ["上次那个星光湾是哪年的事", "还记得小白的生日吗"], lambda m: pool.cjk_keywords(m, "的吗是那个哪年事", "上次|还记得")) == [["星光湾"], ["小白", "生日"]]
    said = {"Let me look at this carefully. I should answer now.": True, "The tea is good. Let me see.": False, "好的，我知道了。": False, "": False}
    assert each(spark, list(said), pool.is_thinking) == list(said.values())
    blobs = {'{"a": [1, 2]}': True, '{"a": [1, 2': False, '{"a":{"b":[1,2],,}}': True, "[see the long note that is in brackets]": False, "plain": False}
    assert each(spark, list(blobs), pool.is_json_blob) == list(blobs.values())
    assert each(spark, ["hi", "a longer message here"], lambda m: F.size(pool.vector_questions(m, F.lit("before")))) == [2, 1]


# -- secrets


def plain_redaction(text):
    """The same rules in Python."""
    limits = redaction.LIMITS
    mask = lambda k, v: f"[redacted:{k}:{v[:4]}…{v[-2:]}]"
    word = lambda p: p.replace(r"\p{XDigit}", "[0-9A-Fa-f]")
    of = lambda c: "aA0"[1 if c.isupper() else 2 if c.isdigit() else 0]

    def mixed(t):
        if not re.search("[A-Za-z]", t) or len(re.findall("[0-9]", t)) < 2:
            return 0
        pairs = sum(x.isascii() and x.isalnum() and y.isascii() and y.isalnum() and of(x) != of(y) for x, y in zip(t, t[1:], strict=False))
        return pairs / sum(c.isalnum() for c in t)

    def kind(t, lead):
        if re.search(word(redaction.UUID), t):
            return None
        for k, p in redaction.FORMATS:
            if re.search(p, t, re.A):
                return k
        digest = re.search(word(redaction.HEX), t)
        if re.search(redaction.BEARER, lead) and len(t) >= limits.named:
            return "bearer"
        telling = len(t) >= limits.digest and re.search("[0-9]", t) and re.search("[A-Fa-f]", t) if digest else len(t) >= limits.named and mixed(t) >= limits.named_mixed
        if re.search(redaction.NAMED, lead, re.A) and telling:
            return "named"
        file = re.search(r"\.[A-Za-z0-9]{2,5}$", t) and t.count(".") == 1
        return "random" if len(t) >= limits.anywhere and not digest and mixed(t) >= limits.mixed and not re.search(redaction.PUBLIC, lead) and not file else None

    def part(m):
        v, rest = m[0], m.string[m.end() :]
        file = re.search(r"^\.[A-Za-z0-9]{2,5}(?:$|[?#])", re.split(redaction.SEGMENT, rest)[0])
        return v if re.search(word(redaction.UUID), v) or re.search(word(redaction.HEX), v) or mixed(v) < limits.mixed or file else mask("url", v)

    out, at, last = [], 0, ""
    for m in re.finditer(redaction.TOKEN, text):
        gap, t = text[at : m.start()], m[0]
        if t.startswith(("http://", "https://")):
            out += [gap, re.sub(redaction.SEGMENT, part, t)]
        else:
            k = kind(t, last + gap)
            out += [gap, mask(k, t) if k else t]
        at, last = m.end(), t
    return "".join(out) + text[at:]


def test_redaction_against_python(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = lambda n, a=letters: "".join(rng.choice(a) for _ in range(n))
    parts = [
        lambda: "sk-" + made(24), lambda: "ghp_" + made(30), lambda: "xoxb-" + made(14), lambda: "AKIA" + made(16, "ABCDEFGH0123456789"), lambda: made(9, "123456789") + ":" + made(35), lambda: "Bearer " + made(20),
        lambda: "password: " + made(18), lambda: "api_key = '" + made(20, "0123456789abcdef") + "'", lambda: made(40), lambda: made(40, "0123456789abcdef"), lambda: "a-file-name-with-many-words-2024-01-02-in-it",
        lambda: "123e4567-e89b-42d3-a456-426614174000", lambda: "https://x.org/inbox/" + made(36) + ".jpg", lambda: "ssh-ed25519 " + made(60), lambda: "file_id=" + made(50), lambda: "token is " + made(15), lambda: "plain words", lambda: "https://push.example.org/" + made(22) + "/title", lambda: "bearer \t " + made(30), lambda: "https://x.org/a-long-name-of-a-page-2024?key=" + made(30), lambda: "authorization_token => " + made(24),
        lambda: "AIza" + made(35), lambda: "getUserNameFromDatabaseConnectionPoolOfAll", lambda: "ecdsa-sha2-nistp256 " + made(50), lambda: "口令是" + made(20), lambda: "eyJ" + made(20) + "." + made(20) + "." + made(9),
    ]
    texts = ["", "short", *(f" {rng.choice(['and', '.', ',', 'x'])} ".join(p() for p in rng.choices(parts, k=rng.randint(1, 6))) for _ in range(120))]
    got = each(spark, texts, redaction.redacted)
    assert got == [plain_redaction(t) for t in texts]
    kinds = {k for r in each(spark, got, redaction.masks, "string") for k, _ in r}
    assert kinds >= {"sk", "github", "slack", "aws", "tg", "jwt", "google", "bearer", "named", "random", "url"}
    plain = ["a-file-name-with-many-words-2024-01-02-in-it", "123e4567-e89b-42d3-a456-426614174000", "getUserNameFromDatabaseConnectionPoolOfAll", "https://example.org/wiki/Some_long_title_of_a_page", "0123456789abcdef" * 4, "2024-01-02T03:04:05.678Z", "https://x.org/inbox/Ab3dE5gH7jK9mN1pQ3sT5vW7.jpg"]
    assert each(spark, plain, redaction.redacted) == plain
    assert each(spark, got[:40], redaction.redacted) == got[:40]  # what is masked stays as it is


# -- names


def test_glossary_and_attribution(spark):
    lines = spark.createDataFrame([("# comment",), ("- Rex / the dog = a pet; Mia = a cat",), ("#! parent Pup < Rex",), ("Pup = a small one",), ("#! foreign zoo / farm",), ("no names here",)], "value string")
    aliases, parents, foreign = entities.glossary(lines)
    names = {r["alias"]: r["name"] for r in aliases.collect()}
    assert names == {"rex": "Rex", "the dog": "Rex", "mia": "Mia", "pup": "Pup"} and {r["word"] for r in foreign.collect()} == {"zoo", "farm"}
    up = {r["name"]: r["parent"] for r in parents.collect()}
    assert up == {"Pup": "Rex"}
    rows = [
        ("Rex barks", "the dog barked", "", "ok"), ("Pup barks", "Rex barked", "", "ok"), ("Pup barks", "Rex barked in the zoo", "", "review"), ("Mia sleeps", "it slept", "Mia came", "ok"),
        ("Mia sleeps", "Rex slept", "Mia came", "review"), ("it sleeps (Mia)", "it slept", "", "strip"), ("Mia sleeps", "Rex slept", "", "reject"), ("Mia sleeps", "it slept", None, "review"), ("it sleeps", None, None, "ok"),
    ]
    df = spark.createDataFrame(rows, "content string, source string, context string, want string")
    got = entities.attribution(df, names, up, ["zoo", "farm"]).collect()
    assert [(r["content"], r["verdict"]) for r in got] == [(r["content"], r["want"]) for r in got]


# -- records


def test_export_comes_back(spark, tmp_path):
    facts = spark.createDataFrame([(k, f"fact {k}") for k in range(6)], "fact_id long, content string")
    links = spark.createDataFrame([(k, k * 10 + n) for k in range(6) for n in range(k)], "fact_id long, evidence_id long")
    rows = spark.createDataFrame([(k % 2, k) for k in range(6)], "batch_id long, fact_id long")
    found = records.export(rows, records.dumped(facts, links=links), str(tmp_path / "out"))
    assert found.count() == 6
    lines = {r["fact_id"]: json.loads(r["line"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert lines[3] == {"fact": {"fact_id": 3, "content": "fact 3"}, "links": [{"evidence_id": 30}, {"evidence_id": 31}, {"evidence_id": 32}]}
    log = spark.createDataFrame([("b1", 1, 10), ("b1", 1, 11), ("b2", 2, 20)], "batch_id string, parent_id long, atom_id long")
    back = {(r["fact_id"], r["status"]) for r in records.rolled_back(log, F.lit("b1")).collect()}
    assert back == {(1, "candidate"), (10, "invalid"), (11, "invalid")}


def test_telemetry_keeps_no_text(spark):
    messages = spark.createDataFrame([(1, "a secret question", "recall", 2.0), (2, "x", "skip", 1.0)], "run_id long, text string, decision string, latency_ms double")
    hits = spark.createDataFrame([(1, 7, 1, 0.5, "abc"), (1, 8, 2, 0.4, "de")], "run_id long, fact_id long, rank int, score double, snippet string")
    runs, found = records.telemetry(messages, hits)
    got = {r["run_id"]: r.asDict() for r in runs.collect()}
    assert got[1]["returned"] == 2 and got[2]["returned"] == 0 and len(got[1]["query_hash"]) == 16 and got[1]["v_engine"] == records.VERSIONS["engine"]
    assert "text" not in runs.columns and [r["snippet_chars"] for r in found.orderBy("rank").collect()] == [3, 2]


def plain_window(doc, words, limit):
    if len(doc) <= limit:
        return doc
    sentences = [s for s in re.split("\1", re.sub(r"([.!?])\s+", "\\1\1", doc)) if s.strip(" ")]
    hits = [sum(s.lower().count(w) for w in words) for s in sentences]
    n, i = max((h, i) for i, h in enumerate(hits))
    if n == 0:
        return doc[:limit]
    out = sentences[i]
    for s in sentences[i + 1 :]:
        if len(out) + 1 + len(s) > limit:
            break
        out += " " + s
    for s in reversed(sentences[:i]):
        if len(out) + 1 + len(s) > limit:
            break
        out = s + " " + out
    return out


def test_best_windows(spark, sf):
    from recollect.plans import queries as plans
    from recollect.sources import bindings

    texts = {r["fact_id"]: r["content"] for r in bindings.facts(spark, sf).collect()}
    got = {r["fact_id"]: r["window"] for r in plans.QUERIES["best_windows"](spark, sf).collect()}
    assert got == {i: plain_window(texts[i], ("thean", "waser", "outhe"), 300) for i in got} and len(got) > 100


def test_notes(spark, sf):
    note = "## Summary\n- one\n- two\n## Other\n- no\n## Pending\n* call Ann\n- none\n## State\n- tired"
    when = lambda t: F.lit(t).cast("timestamp")
    out = lambda most, today="2024-01-05": each(spark, [note], lambda n: records.injected(n, when("2024-01-02 10:00:00"), F.lit(date.fromisoformat(today)), most=most))[0]
    assert out(1200).split("\n")[1:] == ["Summary:", "- one", "- two", "Pending:", "- call Ann", "State:", "- tired"]
    assert out(1200, "2024-02-05") == ""
    short = out(130)
    assert "call Ann" in short and "one" not in short
    from recollect.plans import queries as plans

    rows = plans.QUERIES["handoff_notes"](spark, sf).collect()
    assert rows and all(len(r["injected"]) <= 1200 for r in rows)


def test_replies(spark):
    replies = {'```json\n{"a": 1}\n```': {"a": 1}, 'Sure: {"a": [1, 2,],} ok': {"a": [1, 2]}, "no json": None, '{"a": 1': {}, '{"a": {"b": 2}}': {"a": {"b": 2}}}
    got = each(spark, list(replies), records.tolerant_json)
    assert [json.loads(x) if x else None for x in got] == list(replies.values())
    assert each(spark, ["what about that", "hm", "🙂🙂🙂🙂🙂🙂🙂"], lambda m: records.worth_rewriting(m, F.lit(False))) == [True, False, False]


def test_masks_of_documents(spark, sf):
    from recollect.plans import queries as plans
    from recollect.sources import bindings

    want = set()
    for r in bindings.facts(spark, sf).collect():
        found = re.findall(r"\[redacted:([a-z]+):", plain_redaction(r["content"]))
        want |= {(r["fact_id"], k, found.count(k)) for k in found}
    assert {tuple(r) for r in plans.QUERIES["redaction_masks"](spark, sf).collect()} == want


@pytest.mark.parametrize("now", ["2024-01-20 00:00:00"])
def test_expired(spark, now):
    at = lambda d: datetime(2024, 1, d)
    archive = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(1)), (2, 3, at(10)), (3, 4, at(1))], "batch_id long, fact_id long, opened_at timestamp")
    gone = records.expired(archive, spark.createDataFrame([(1, 2)], "batch_id long, fact_id long"), spark.createDataFrame([(3,)], "batch_id long"), F.lit(now).cast("timestamp"))
    assert [tuple(r) for r in gone.select("batch_id", "fact_id").collect()] == [(1, 1)]


def test_large_batches_find_the_same(spark, sf, monkeypatch):
    from recollect.operators import recall
    from recollect.sources import bindings

    facts = bindings.facts(spark, sf).select("fact_id", "content")
    terms = spark.createDataFrame([("q1", 1, "the"), ("q1", 2, "waser"), ("q2", 1, "an"), ("q3", 1, "e"), ("q4", 1, "zzzz"), ("q5", 1, "é")], "query_id string, term_rank int, term string")
    vectors = bindings.vectors(spark, sf)
    queries = vectors.filter("fact_id % 9 = 0").select(F.concat(F.lit("q"), "fact_id").alias("query_id"), F.col("fact_id").alias("own_id"), F.col("vec").alias("query_vec"))
    found = lambda: ({tuple(r) for r in recall.term_matches(facts, terms).select("query_id", "term", "fact_id").collect()}, {tuple(r) for r in recall.vector_channel(vectors, queries, 5, 0.1, "own_id").collect()})
    few = found()
    monkeypatch.setattr(recall, "SMALL", 1)
    many = found()
    assert few[0] == many[0] and few[1] == many[1] and len(few[0]) > 100 and len(few[1]) > 50


def test_working_set_and_bin(spark):
    from recollect.operators import lifecycle

    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    state = spark.createDataFrame([(1, 1, "candidate", "active", False), (2, 1, "confirmed", "active", True), (3, 4, "uncertain", "cold", False)], "fact_id long, version int, status string, layer string, user_pinned boolean")
    picks = spark.createDataFrame([(1, 5, "noise"), (2, 5, "noise"), (3, 6, "noise")], "fact_id long, batch_id long, category string")
    archive, log = lifecycle.deleted(state, picks, now)
    assert {(r["fact_id"], r["version"], r["status"], r["layer"]) for r in log.collect()} == {(1, 2, "invalid", "cold"), (3, 5, "uncertain", "cold")}
    back, log2 = lifecycle.restored(log, archive, F.lit(5), now)
    assert [(r["fact_id"], r["version"], r["status"], r["layer"]) for r in log2.collect()] == [(1, 3, "candidate", "active")]
    assert lifecycle.restored(log2, archive.unionByName(back), F.lit(5), now)[0].count() == 0  # once


def test_stale_rules(spark):
    """Each rule by itself: a pair that is fine but for one thing; and a null never passes."""
    from recollect.operators import provenance

    base = dict(subject="user", status="candidate", pinned=False, valid_from="2024-01-01", created_at="2024-01-01", valid_to=None, key="k", value="a", polarity=True)
    later = base | dict(valid_from="2024-02-01", value="b")
    cases = {
        "ok": [({}, {}), ({}, dict(value="a", polarity=False)), ({}, dict(status="confirmed")), (dict(valid_from=None), {}), (dict(key=None), dict(slot="asked")), ({}, dict(value=None))],
        "subject": [(dict(subject="assistant_a"), {}), (dict(subject=None), {})],
        "not-owner": [(dict(subject="us"), dict(subject="us")), (dict(subject=None), dict(subject=None))],
        "old-not-plain": [(dict(status="confirmed"), {}), (dict(pinned=True), {}), (dict(valid_to="2024-01-05"), {})],
        "new-not-live": [({}, dict(status="superseded")), ({}, dict(valid_to="2024-03-01"))],
        "not-later": [({}, dict(valid_from="2024-01-01")), (dict(valid_from=None, created_at=None), {}), ({}, dict(valid_from=None, created_at=None))],
        "not-own-words": [({}, dict(said="assistant_a")), ({}, dict(said=None))],
        "key": [({}, dict(key="other"))],
        "same-value": [({}, dict(value="a")), (dict(value=None), dict(value=None))],
        "no-slot": [(dict(key=None), {}), ({}, dict(key=None)), (dict(key=None), dict(key=None, slot="  "))],
    }
    facts, pairs, said, want = [], [], [], {}
    for reason, some in cases.items():
        for old, new in some:
            k = len(want) * 2 + 2
            slot, speaker = new.pop("slot", None), new.pop("said", "user")
            facts += [(k, *(base | old).values()), (k + 1, *(later | new).values())]
            pairs.append((k, k + 1, slot))
            said += [(k + 1, speaker)] if speaker else []
            want[k] = reason
    pairs += [(1, 1, None), (0, 2, None), (2, 10**6, "x")]
    facts.append((1, *base.values()))
    schema = "fact_id long, subject string, status string, pinned boolean, valid_from string, created_at string, valid_to string, key string, value string, polarity boolean"
    out = provenance.stale_checked(spark.createDataFrame(pairs, "old_id long, new_id long, slot string"), spark.createDataFrame(facts, schema), spark.createDataFrame(said, "fact_id long, actor string")).collect()
    got = {(r["old_id"], r["new_id"]): r["reason"] for r in out}
    assert {k: got[k, k + 1] for k in want} == want
    assert got[1, 1] == "same-row" and got[0, 2] == "unknown-fact" and got[2, 10**6] == "unknown-fact"
