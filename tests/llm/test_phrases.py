"""Operator 13 against counts of all phrases in plain Python and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import phrases


def brute(rows, least, share=80, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if a >= least}
        longer = Counter()
        for p, a in many.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        found = []
        for p, a in many.items():
            if len(p) > 1 and 100 * longer[p] < share * a:
                cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def got(df, **more):
    return sorted(map(tuple, phrases.collocations(df, **more).collect()))


@pytest.mark.parametrize(("least", "budget", "portion", "first"), [(3, 1_000_000, 8 << 20, 2000), (2, 40, 2000, 25), (3, 400, 100, 2000)])
def test_against_counts(spark, docs, monkeypatch, least, budget, portion, first):
    """Small budgets make prefixes of several words, small portions part leaves and long texts."""
    monkeypatch.setattr(phrases, "PORTION", portion)
    monkeypatch.setattr(phrases, "ROWS", 1000)
    monkeypatch.setattr(phrases, "DEALT", 10_000 if budget < 1000 else 10**10)
    df = docs.filter("doc_id % 3 = 0").repartition(3)
    assert got(df, least=least, budget=budget, first=first) == brute([(r["lang"], r["text"]) for r in df.collect()], least, first=first)


ODD = ["a b a b a b", "A B, a b. a b\na b", "the the the the the the the", "x\x01y x\x01y x\x01y", "é ü é ü é ü é Ü", "a b c a b c", "", None, ".,;:!?\n", "one", " \t a  \t b "]


@pytest.mark.parametrize("budget", [4, 1000])
def test_odd_texts(spark, odd, none, budget):
    df = spark.createDataFrame([(lang, t) for t in ODD for lang in ("en", None, "und", "de")], "lang string, text string").repartition(3)
    assert got(df, least=2, budget=budget) == brute([(r["lang"], r["text"]) for r in df.collect()], 2)
    assert got(odd, least=2, budget=budget) == brute([(r["lang"], r["text"]) for r in odd.collect()], 2)
    assert got(none) == []


def test_leaves():
    for size, top in ((0, 3), (1, 3), (500, 3), (500, 60), (300, 1 << 20)):
        words = [np.random.default_rng(k).integers(0, top, size) for k in range(4)]
        rows, n = phrases.leaves(words)
        want = sorted(Counter(zip(*(w.tolist() for w in words), strict=True)).items())
        assert [(tuple(r), c) for *r, c in zip(*(r.tolist() for r in rows), n.tolist(), strict=True)] == want


def test_a_group_is_a_tree():
    """From its prefixes down a group has whole counts and nothing under `least`; whole phrases are added up."""
    rows = [("a b c", 5), ("a b d", 2), ("a e", 1), ("b", 4), ("b", 3)]
    table = lambda group: pa.table({"group": [group] * 5, "lang": ["x"] * 5, "suffix": [s for s, _ in rows], "n": [n for _, n in rows]})
    nodes = lambda group: {(r["phrase"], r["words"], r["f"]) for r in phrases.subtrees(table(group), 10, 4).to_pylist()}
    assert nodes(3) == {("a", 1, 8), ("b", 1, 7), ("a b", 2, 7), ("a b c", 3, 5)}
    assert nodes(13) == {("a b", 2, 7), ("a b c", 3, 5)}
    assert nodes(43) == {("a b c", 3, 5), ("a b d", 3, 2), ("a e", 2, 1), ("b", 1, 7)}


def test_scores_pass_64_bits(spark):
    rows = [("x", "a", 1, 4 * 10**17), ("x", "b", 1, 5 * 10**17), ("x", "a b", 2, 3 * 10**17 + 7)]
    row = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long"), 10**18).first()
    assert row["score"] == 2_000_000 * (3 * 10**17 + 7) // (9 * 10**17) and (row["l"], row["r"]) == (4 * 10**17, 5 * 10**17)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want, query = con.sql(phrases.OP13_SQL), phrases.op13_phrases(spark, sf)
    assert query.columns == want.columns
    assert sorted(map(tuple, query.collect())) == sorted(want.fetchall())


def test_suffixes_travel_packed():
    """Many suffixes of few groups are few rows, of a fraction of their bytes, and come back as they were."""
    rng = np.random.default_rng(4)
    strings = pa.array([f"wörd{k}" for k in range(300)])
    columns, n = phrases.leaves([rng.integers(1, 301, 60_000), rng.integers(0, 301, 60_000)])
    group = columns[0] % 7
    batches = list(phrases._packed("de", strings, columns, n, group))
    table = pa.Table.from_batches(batches)
    assert table.num_rows <= 7 + len(batches) and sum(len(x.as_py()) for x in table.column("packed")) < 8 * len(n)
    got = []
    for g in range(7):
        rows = phrases.unpacked(table.filter(pa.array(table.column("group").to_numpy() == g))).to_pylist()
        got += [(r["group"], r["lang"], r["suffix"], r["n"]) for r in rows]
    want = [(g, "de", " ".join(strings[c - 1].as_py() for c in x if c), m) for *x, m, g in zip(*(c.tolist() for c in columns), n.tolist(), group.tolist(), strict=True)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("portion", [5 << 20, 1000])
def test_rows_of_a_portion_are_bounded(spark, monkeypatch, portion):
    """A portion makes no more rows where there are more groups, and each group comes whole from its part."""
    monkeypatch.setattr(phrases, "PORTION", portion)
    rng = np.random.default_rng(5)
    strings = pa.array([f"wörd{k}" for k in range(300)])
    columns, n = phrases.leaves([rng.integers(1, 301, 60_000), rng.integers(0, 301, 60_000)])
    for groups in (700, 20_000):
        group = (columns[0] * 300 + columns[1]) % groups
        batches = [b for lang in ("de", "en") for b in phrases._packed(lang, strings, columns, n, group, phrases.PARTS)]
        assert sum(b.num_rows for b in batches) <= 2 * (phrases.PARTS + len(batches))
        table = pa.Table.from_batches(batches)
        part = table.filter(pa.array(table.column("part").to_numpy() == 5))
        regrouped = pa.Table.from_batches(phrases._regrouped(part.to_batches())).sort_by("group")
        whole = [{(lang, s, m) for lang, s, m in zip(*(t.column(c).to_pylist() for c in ("lang", "suffix", "n")), strict=True)} for t in phrases._by_group(regrouped.to_batches(max_chunksize=3))]
        words = lambda k: " ".join(strings[c[k] - 1].as_py() for c in columns if c[k])
        mine = sorted({int(g) for g in group[group % phrases.PARTS == 5]})
        assert whole == [{(lang, words(k), int(n[k])) for lang in ("de", "en") for k in np.flatnonzero(group == g)} for g in mine]
