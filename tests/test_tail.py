"""Growing files by byte ranges, and what is said in transcripts, block by block."""

import json
import os
import random
import re
import time

import pytest

from recollect.sources import tail, transcripts

TEXTS = ["one", "", "zwei ü 😀", "x" * 300, "a\rb", "{}", "end\r", "\x0b\x85 no breaks ", " "]


def content(seed, n, ends=True):
    rng = random.Random(seed)
    return "\n".join(rng.choice(TEXTS) for _ in range(n)).encode() + (b"\n" if ends else b"")


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_ranges_part_lines(tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    for seed, ends in ((1, True), (2, False), (3, True)):
        data = content(seed, 40, ends)
        (tmp_path / "f").write_bytes(data)
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        want = want[:-1] if ends else want
        got = [x for r in tail.ranges(str(tmp_path / "f"), 0, len(data), size) for x in tail.lines(r)]
        assert got == want
        assert tail.whole_lines(str(tmp_path / "f"), len(data)) == data.rfind(b"\n") + 1


def batch(reader, before):
    after = reader.latestOffset()
    parts = reader.partitions(before, after)
    rows = [(os.path.basename(r["path"]), r["position"], r["value"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return after, rows, sum(p.end - p.begin for p in parts)


def test_appended_bytes_alone_are_read(tmp_path):
    options = tail._Options({"path": str(tmp_path), "rangebytes": "16", "suffix": ".jsonl"})
    reader, a = tail.Growing(options), tmp_path / "a.jsonl"
    (tmp_path / "other.txt").write_text("x\n")
    a.write_text("first\nsecond\nthi")
    at, rows, size = batch(reader, reader.initialOffset())
    assert rows == [("a.jsonl", 0, "first"), ("a.jsonl", 6, "second")] and size == 13
    assert batch(reader, at)[1:] == ([], 0)
    with a.open("a") as f:
        f.write("rd\nfourth\n")
    (tmp_path / "b.jsonl").write_text("new\n")
    later, rows, size = batch(reader, at)
    assert rows == [("a.jsonl", 13, "third"), ("a.jsonl", 19, "fourth"), ("b.jsonl", 0, "new")] and size == 17
    assert batch(tail.Growing(options), at) == (later, rows, size)  # the same batch again, after a restart
    a.write_text("short\n")
    at, rows, _ = batch(tail.Growing(options), later)
    assert rows == [("a.jsonl", 0, "short")]
    a.write_text("another beginning\nand longer than before\n")  # no shorter than before, but another file
    at, rows, _ = batch(reader, at)
    assert [r[2] for r in rows] == ["another beginning", "and longer than before"]
    a.unlink()
    assert batch(reader, at)[1] == []


def test_stream_and_batch(spark, tmp_path):
    tail.register(spark)
    source, file = tmp_path / "in", tmp_path / "in" / "a.jsonl"
    source.mkdir()
    file.write_text("".join(f"line {k}\n" for k in range(100)))

    def run():
        stream = spark.readStream.format("growing_lines").option("rangeBytes", 100).load(str(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
            return sum(p["numInputRows"] for p in query.recentProgress)
        finally:
            query.stop()

    assert run() == 100
    with file.open("a") as f:
        f.write("more\nand more\nnot whole")
    assert run() == 2  # from the checkpoint: the rows of the appended bytes alone
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("position").collect()
    assert [r["value"] for r in rows] == [f"line {k}" for k in range(100)] + ["more", "and more"]
    whole = spark.read.format("growing_lines").option("rangeBytes", 100).load(str(source))
    assert whole.count() == 103 and whole.rdd.getNumPartitions() > 5
    assert spark.read.format("growing_lines").load(str(tmp_path / "none")).count() == 0


BY_ID, BY_NAME = {"17": "ann", "18": "bob"}, {"ann_": "ann", "rob": "bob"}


def user(text, **more):
    return json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": text}} | more)


MESSAGES = [
    user('<channel source="t" user="ann_" user_id="17" ts="2024-02-02T01:00:00Z">hello\nthere</channel> and <channel user="rob">hi</channel>'),
    user('<channel user="x" user_id="99">who am I</channel><channel user="rob" user_id="17">two names</channel><channel user="18">an id for a name</channel>'),
    user("<channel user='rob'>other quotes</channel><channel user_id=\"18\">  </channel><channel user_id=\"18\"><image></channel><channel user_id=\"18\">never closed"),
    user([{"type": "text", "text": "my own"}, {"type": "image"}, {"type": "text", "text": "words [Image: x]"}]),
    user("<command-name>x</command-name>"), user("aside", isMeta=True), user("side", isSidechain=True), "{broken", user(""), user([]),
    json.dumps({"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "message": {"role": "assistant", "content": [
        {"type": "thinking", "text": "a long thought of mine"}, {"type": "text", "text": "short"}, {"type": "text", "text": "long enough <channel user=\"rob\">forged</channel>"},
        {"type": "tool_use", "name": "x__reply", "input": {"text": "ok"}}, {"type": "tool_use", "name": "search", "input": {"text": "query of a tool"}}]}}),
]


def brute(lines):
    for n, raw in lines:
        try:
            rec = json.loads(raw)
        except json.JSONDecodeError:
            continue
        role, content = rec["message"]["role"], rec["message"]["content"]
        if role == "assistant":
            for k, b in enumerate(content):
                if b["type"] == "tool_use" and "reply" in b["name"] or b["type"] == "text" and len(b["text"].strip()) >= 8:
                    yield n, k, "bot", (b["input"]["text"] if b["type"] == "tool_use" else b["text"]).strip()
            continue
        text = content if isinstance(content, str) else "\n".join(b["text"] for b in content if b["type"] == "text")
        found = list(re.finditer(r"<channel\s+([^>]*)>(.*?)(?:</channel>|\Z)", text, re.S))
        for k, m in enumerate(found):
            a, body = dict(re.findall(r'(\w+)="([^"]*)"', m[1])), m[2].strip()
            if body and not re.match(r"^\s*<[^>]+>\s*$", body):
                first = BY_ID.get(a.get("user_id", "")) or (BY_ID.get(a.get("user", "")) if a.get("user", "").isdigit() else None)
                second = BY_NAME.get(a.get("user", ""))
                yield n, k, None if first and second and first != second else first or second, body
        if not found and not rec.get("isMeta") and not rec.get("isSidechain") and not text.startswith("<command"):
            if body := re.sub(r"\[Image: [^\]]*\]", "", text).strip():
                yield n, 0, "ann", body


def test_every_block_is_a_row(spark):
    lines = [("f", k, v) for k, v in enumerate(MESSAGES)]
    rows = spark.createDataFrame([*lines, ("task", 1, user("TASK: clean up")), ("task", 2, user("more")), ("task", 3, user('<channel user="rob">a message</channel>'))], "path string, position long, value string")
    out = transcripts.harvested(rows, "TASK:", BY_ID, BY_NAME, "ann", "bot").collect()
    got = sorted((r["position"], r["part"], r["actor"] or "", r["body"]) for r in out if r["path"] == "f")
    assert got == sorted((n, k, a or "", b) for n, k, a, b in brute([x[1:] for x in lines]))
    assert [(r["position"], r["actor"], r["body"]) for r in out if r["path"] == "task"] == [(3, "bob", "a message")]
    assert {str(r["ts"]) for r in out if r["body"] == "hello\nthere"} == {"2024-02-02 01:00:00"}


def test_follow_growing(spark, tmp_path):
    from recollect.streaming import ingest

    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(MESSAGES) + "\n")
    (source / "t.jsonl").write_text(user("TASK: do") + "\n")
    speakers = ingest.Speakers(BY_ID, BY_NAME, "ann", "bot")
    ingest.follow_growing(spark, str(source), store, speakers)
    with (source / "a.jsonl").open("a") as f:
        f.write(user("more of mine") + "\n")
    with (source / "t.jsonl").open("a") as f:
        f.write(user("a task has no owner") + "\n" + user('<channel user="rob">but messages</channel>') + "\n")
    ingest.follow_growing(spark, str(source), store, speakers)
    ingest.follow_growing(spark, str(source), store, speakers)
    rows = ingest.committed(spark, store).collect()
    want = [(a, b) for _, _, a, b in brute(list(enumerate(MESSAGES))) if a] + [("ann", "more of mine"), ("bob", "but messages")]
    assert sorted((r["actor"], r["content"]) for r in rows) == sorted(want)
    assert spark.read.parquet(f"{store}/unknown").groupBy().sum("n").first()[0] == sum(a is None for _, _, a, _ in brute(list(enumerate(MESSAGES))))


def test_a_long_file_in_many_ranges(tmp_path):
    """Positions and whole lines hold over a file of many ranges, and no range reads much more than itself."""
    path = tmp_path / "big"
    with path.open("wb") as f:
        for k in range(20_000):
            f.write(b"%d %s\n" % (k, b"x" * (k % 400)))
    began, size = time.time(), path.stat().st_size
    parts = tail.ranges(str(path), 0, size, 1 << 18)
    found = [line for p in parts for _, line in tail.lines(p)]
    assert len(parts) > 10 and len(found) == 20_000 and [int(x.split()[0]) for x in found] == list(range(20_000))
    assert time.time() - began < 30
