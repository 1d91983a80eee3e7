"""Names in texts against regular expressions, and verdicts against the rules in plain Python."""

import random
import re

import pandas as pd
import pytest

from recollect.operators import names

ALIASES = [("ann", "Ann"), ("annabel", "Annabel"), ("ann lee", "Ann"), ("小白", "Bai"), ("大小白狗", "Dog"), ("白狗", "Dog"), ("鱼", "Fish"), ("gpt-4", "G4"), ("GPT", "G"), ("a.b", "AB"), ("lee ann", "Lee"), ("üla", "Ula"), ("aa", "AA"), ("aaa", "AAA"), ("", "none"), (None, "x")]
PARENTS = [("G4", "G"), ("Dog", "Bai")]


def brute_mentions(text, aliases=ALIASES):
    taken, out = [], []
    seen = {}
    for a, n in aliases:
        if a and len(a) > 1:
            seen[a.lower()] = min(n, seen.get(a.lower(), n))
    spans = []
    low = names.folded(text)
    for a, n in seen.items():
        plain = re.fullmatch(r"[A-Za-z0-9_.\-]+", a)
        pattern = f"(?={re.escape(a)})" if not plain else f"(?<![A-Za-z0-9])(?={re.escape(a)}(?![A-Za-z0-9]))"
        spans += [(m.start(), m.start() + len(a), n, a) for m in re.finditer(pattern, low)]
    for s, e, n, a in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if not any(s < te and ts < e for ts, te in taken):
            taken.append((s, e))
            out.append((s, e, n, a))
    return sorted(out)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["ann", "annabel", " lee ", "Ann Lee Ann", "小白", "狗", "大小白狗", "鱼", "gpt-4", "GPT", "gpt-45", "a.b", "aaaa", "ÜLA", " ", "x", ".", "İ", "😀"]
    return ["", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(n))]


@pytest.mark.parametrize(("part", "portion"), [(50_000, 1 << 20), (4, 1 << 20), (50_000, 7)])
def test_mentions(spark, monkeypatch, part, portion):
    monkeypatch.setattr(names, "PORTION", portion)
    texts = random_texts(300)
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, content string").repartition(3)
    found = names.mentions(rows, spark.createDataFrame(ALIASES, "alias string, name string"), part=part).collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["name"], r["alias"]))
    fold = lambda t: names.folded(t)
    assert {k: sorted(v) for k, v in got.items()} == {k: m for k, t in enumerate(texts) if (m := brute_mentions(fold(t)))}


@pytest.mark.parametrize("part", [50_000, 4])
def test_portions_without_names(spark, part):
    """A portion in which nobody is named has no rows, but columns of text all the same."""
    row = lambda *x: spark.createDataFrame([x], "id string, content string")
    rows = row("x:1", "nobody here").union(row("x:2", "ann"))  # a task for each
    found = names.mentions(rows, spark.createDataFrame(ALIASES, "alias string, name string"), part=part).collect()
    assert [tuple(r) for r in found] == [("x:2", "Ann", "ann", 0, 3)]


def test_work_follows_the_matches():
    """A dictionary of many aliases that begin alike, and a long text: all places at once, nothing per alias."""
    trie = names.Trie([f"name{k:05d}" for k in range(20_000)] + ["e0", "name"])
    found = list(trie.matches(["name" * 20_000 + "name00042 e0"]))
    assert len(found) == 20_004 and any(trie.terms[n] == "name00042" for _, n, _, _ in found)


def brute_verdict(row, foreign):
    parents, order = dict(PARENTS), ("ok", "strip", "review", "reject")
    groups = lambda t: {n for _, _, n, _ in brute_mentions(t or "")}
    label = re.sub(names.LABEL, "", row["content"])
    src = groups(row["source"]) | {n for a, n in ALIASES if a and a.lower() == (row["actor"] or "").lower()}
    loose = src | {n for a, n in ALIASES if a and len(a) == 1 and a in (row["source"] or "")}
    ctx, of = groups(row["context"]), next((n for a, n in ALIASES if a and a.lower() == (row["subject"] or "").lower()), None)
    out_there = any(w in "\n".join(x for x in (row["source"], row["context"]) if x) for w in foreign)
    inside, bare = groups(label), groups(re.sub(names.NOTE, " ", label))
    worst, why = 0, set()
    for k in inside | ({of} if of else set()):
        up = parents.get(k)
        if k in loose:
            v = "ok"
        elif up in loose:
            v = "review" if out_there else "ok"
        elif k in ctx:
            v = "review" if src - {k} or (up and out_there) else "ok"
        elif up in ctx:
            v = "review"
        elif k in inside and k not in bare and k != of:
            v = "strip"
        elif k in inside and src - {k}:
            v = "reject"
        else:
            v = "review"
        why.add((order.index(v), k))
        worst = max(worst, order.index(v))
    return order[worst], sorted(k for r, k in why if r == worst) if worst else []


def test_support(spark):
    rng = random.Random(9)
    bits = ["ann", "小白", "大小白狗", "gpt-4", "gpt", "鱼", "(gpt)", "（小白）", "he", "abroad"]
    say = lambda n: " ".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    rows = [(k, rng.choice(["", "ann (08-03 20:26): "]) + say(3), rng.choice([say(3), None]), rng.choice([say(2), None, ""]), rng.choice(["ann", "GPT", "nobody", None]), rng.choice(["ann", "user", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, content string, source string, context string, subject string, actor string")
    out = names.supported(df, spark.createDataFrame(ALIASES, "alias string, name string"), spark.createDataFrame(PARENTS, "name string, parent string"), ["abroad"])
    got = {r["id"]: (r["verdict"], r["names"]) for r in out.collect()}
    want = {r["id"]: brute_verdict(r, ["abroad"]) for r in df.collect()}
    assert got == want and {v for v, _ in want.values()} == {"ok", "strip", "review", "reject"}


def test_match_order(spark):
    found = spark.createDataFrame([(1, "A", "a", 5, 9), (1, "B", "b", 0, 2), (1, "C", "c", 3, 5), (1, "D", "d", 9, 11), (2, "A", "a", 0, 4)], f"id long, {names.SPANS}")
    known = spark.createDataFrame([("A", False, 3), ("B", True, 90), ("C", True, 90), ("D", True, 2)], "name string, direct boolean, df long")
    assert [r["name"] for r in names.match_order(found, known).filter("id = 1").orderBy("place").collect()] == ["D", "B", "C", "A"]


def test_a_batch_is_matched_by_portions(monkeypatch):
    """What a task holds follows a portion of text, not the rows that Spark hands over at once; no row is lost."""
    monkeypatch.setattr(names, "PORTION", 50)
    texts = [*random_texts(400), None, "x" * 200, "", "ann"]
    frame = pd.DataFrame({"id": range(len(texts)), "content": texts})
    runs = list(names._portions(frame))
    assert pd.concat(runs).equals(frame) and list(names._portions(frame[:0]))[0].empty
    assert len(runs) > 50 and all(len(r) == 1 or sum(len(t or "") for t in r["content"]) <= 50 for r in runs)
