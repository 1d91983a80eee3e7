"""Cut-off JSON at every place, and repeats of the last kept turn against a scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import records, timeline

REPLIES = [
    {"a": 1, "b": [1, 2.5, {"c": "x"}], "d": {"e": None, "f": True}, "g": "end"}, {}, {"text": 'with "quotes", \\ and é\n', "n": [[], {}, [""]]}, {"deep": {"er": {"est": ["y", False, -1e5]}}}, {"k,:{}": "v,:{}[]"},
]


def longest(text):
    """By trying all places: the longest prefix that brackets (and a quote) make an object."""
    for end in range(len(text), 0, -1):
        part, stack, inside, skip = text[:end], [], False, False
        for c in part:
            if skip:
                skip = False
            elif inside:
                skip, inside = c == "\\", c != '"'
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]":
                stack.pop()
        for tried in (part + ('"' if inside else "") + "".join(reversed(stack)),):
            try:
                if isinstance(found := json.loads(tried), dict):
                    return found
            except ValueError:
                pass
    return None


def size(x):
    return len(x) + sum(map(size, x.values())) if isinstance(x, dict) else sum(1 + size(y) for y in x) if isinstance(x, list) else len(x) if isinstance(x, str) else 0


@pytest.mark.parametrize("indent", [None, 2])
def test_every_prefix(indent):
    for reply in REPLIES:
        text = json.dumps(reply, indent=indent)
        assert json.loads(records.closed(text)) == reply
        for end in range(1, len(text)):
            found = json.loads(records.closed(text[:end]))
            want = longest(text[:end])
            # A number that may go on is not taken, and is all by which the two may differ.
            assert found == want or text[end - 1] in "0123456789.e-" and size(want) - size(found) <= 1, text[:end]
    assert records.closed("no object") is None and records.closed('{"a": }') == '{}' and records.closed("{]") == "{}"


def test_replies(spark):
    rows = [("```json\n{\"a\": [1, 2,],}\n```", {"a": [1, 2]}), ('Sure: {"a": "b"} and more', {"a": "b"}), ('{"a": "b", "c": ["d", "e', {"a": "b", "c": ["d", "e"]}), ("none", None), (None, None), ('```json\n{"a": {"b": 1, "c', {"a": {"b": 1}})]
    out = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(rows)], "id int, reply string").select("id", records.tolerant_json(F.col("reply")).alias("j")).collect()
    assert {r["id"]: r["j"] and json.loads(r["j"]) for r in out} == {k: want for k, (_, want) in enumerate(rows)}


def test_repeats_of_the_last_kept_turn(spark):
    rng = random.Random(6)
    rows, at = [], {}
    for k in range(700):
        path = rng.choice("abc")
        at[path] = at.get(path, 0) + rng.choice([0, 20, 40, 50, 61, 200])
        rows.append((k, path, rng.choice(["u", "u", "u", "v", None]) if path != "c" else "u", rng.choice(["x", "x", "y"]) if path != "c" else "same", at[path]))
    df = spark.createDataFrame(rows, "id long, path string, actor string, content string, s long").withColumn("occurred_at", F.timestamp_seconds("s")).repartition(4)
    kept, last = set(), {}
    for k, path, actor, content, s in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        p = last.get(path)
        if p and None not in (actor, content) and p[:2] == (actor, content) and s - p[2] <= 60:
            continue
        last[path] = (actor, content, s)
        kept.add(k)
    got = timeline.without_repeats(df, 60)
    assert got.columns == df.columns and {r["id"] for r in got.collect()} == kept


def test_only_atoms_of_facts_that_can_be_split_are_compared(spark):
    """A number of atoms that decides alone costs no comparison; the verdicts are those of the rules, for repeated facts as well."""
    said = {k: " ".join(f"word{k} number{j} stands here." for j in range(k)) for k in range(9)}
    facts = [*said.items(), (9, said[4]), (9, said[4]), (10, said[2]), (11, said[2]), (12, said[3])]
    atoms = [(k, j, f"word{k} number{j} stands here.", f"word{k} number{j} stands here.") for k in range(9) for j in range(k)]
    atoms += [(9, j, f"word4 number{j} stands here.", f"word4 number{j} stands here.") for j in range(4)]
    atoms += [(10, 0, "word2 number0 stands", "word2 number0"), (10, 1, "word2 number7 stands", "word2 number1"), (11, 1, "qqqq zzzz xxxx", "stands"), (11, 2, "abc", "stands")]
    atoms += [(12, 0, "word3 number0 stands", "stands"), (12, 1, " word3 number0 stands", "stands"), (77, 0, "of no fact", "fact"), (77, 1, "of no fact", "fact")]
    out = records.splits(spark.createDataFrame(facts, "fact_id long, content string"), spark.createDataFrame(atoms, "fact_id long, n long, content string, quote string"))
    want = [(k, k, "atomic" if k < 2 else "split" if k < 7 else "too-many-atoms") for k in range(9)]
    want += [(9, 8, "too-many-atoms")] * 2 + [(10, 2, "invented-number"), (11, 2, "not-from-original"), (12, 2, "duplicate-atom")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
