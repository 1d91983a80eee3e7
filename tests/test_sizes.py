"""What larger tables brought to light: results that must equal SQL's, and work that must not grow faster than the input."""

import datetime
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from recollect.functions import scores, text
from recollect.operators import benchmark, entities, graphs, index, reports, timeline
from recollect.plans import queries


def test_rounding_is_that_of_sql(spark):
    """F.round lifts every second of these halves where the double lies below it."""
    halves = [(2 * k + 1) / 20000 for k in range(20000)]
    rows = spark.createDataFrame([(x,) for x in halves], "x double").select("x", scores.rounded(F.col("x"), 4).alias("r")).collect()
    want = dict(duckdb.sql("SELECT x, round(x, 4) FROM (SELECT (2 * k + 1) / 20000::DOUBLE AS x FROM range(20000) t(k))").fetchall())
    assert {r["x"]: r["r"] for r in rows} == want


def test_bounds_of_words_are_those_of_sql(spark):
    """A letter beyond ASCII ends a word for SQL's patterns."""
    said = ["Ourä", "weérth", "our own", "ours", "éthus", "thus", "xthus", "because_of", "ébecause", "alwaysé", "élikes", "so that"]
    for pattern in (r"(?i)^(?:i|we|my|our)\b", reports.CAUSE, reports.ALWAYS, reports.STANCE):
        rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", F.col("x").rlike(text.plain_bounds(pattern)).alias("r")).collect()
        assert {r["x"]: r["r"] for r in rows} == {x: duckdb.execute("SELECT regexp_matches(?, ?)", [x, pattern]).fetchall()[0][0] for x in said}
    summaries = spark.createDataFrame([(1, "Weärst said the very words", [0, 2])], "cluster long, summary string, cited array<long>")
    members = spark.createDataFrame([(1, k, "words", True, f"2024-01-0{k + 1}", ["a"]) for k in (0, 2)], "cluster long, id long, content string, own boolean, day string, events array<string>")
    assert [r["reason"] for r in reports.summary_checked(summaries, members, spark.createDataFrame([], "cluster long"), F.lit(False)).collect()] == ["first-person"]


def test_spans_by_either_way(spark):
    """Few terms and many, among them overlapping ones, quotes of patterns and signs of two code units, against a plain scan; no row for each size at each place."""
    terms = ["aa", "aba", "ab", "b\\Ea", ".*", "ä😀", "the", "them", "em 😀a"]
    texts = ["aaaa", "abaababa", "x b\\Ea.* ä😀ä😀", "Them the EM 😀a them 😀a", "", "a", None, "aab" * 2000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    dictionary = spark.createDataFrame([(t, "k") for t in terms], "term string, kind string")
    want = set()
    for i, x in enumerate(texts):
        found = [(p, p + len(t), t) for t in terms for p in range(len(x or "")) if (x or "").lower().startswith(t, p)] if len(x or "") < 100 else None
        want |= {(i, t, p) for p, e, t in found if not any((a, b) != (p, e) and a <= p and b >= e for a, b, _ in found)} if found is not None else {(i, t, p) for k in range(2000) for t, p in (("aa", 3 * k), ("aba", 3 * k + 1)) if t == "aa" or k < 1999} | {(i, "ab", 5998)}
    for scan in (200, 0):
        assert {(r["id"], r["term"], r["pos"]) for r in entities.spans(rows, dictionary, scan).collect()} == want


def test_similar_sets_need_no_key_for_each_pair_of_grams(spark, monkeypatch):
    """Texts of few letters share rare pairs of them: what is written stays within a few rows for each, and no similar pair is lost."""
    rng = np.random.default_rng(5)
    sets = [sorted(set(map(int, rng.integers(0, 90, rng.integers(8, 40))))) for _ in range(300)]
    sets += [s[:-1] for s in sets[:40]]
    rows = spark.createDataFrame([(k, k % 2, [str(x) for x in s]) for k, s in enumerate(sets)], "id long, source long, grams array<string>")
    classes, _ = graphs.gram_classes(rows, "source")
    written, plain = [], graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df: written.append(plain(df)) or written[-1])
    got = {(r["a"], r["b"]) for r in graphs.jaccard_pairs(classes, 0.65, "source").collect()}
    kept = {r["id"] for r in classes.collect()}
    want = {(a, b) for a in kept for b in kept if a < b and a % 2 == b % 2 and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.65}
    assert got == want and max(df.count() for df in written) <= 2 * len(sets)


def test_blocks_of_vectors_are_large(spark):
    """A vector is sent to as many tiles as there are blocks, not to one for each thousand vectors."""
    assert graphs._parts(600_000) <= 40 and graphs._parts(500) == 1
    v = np.random.default_rng(2).normal(size=(2600, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vec array<double>")
    sims = np.round(v @ v.T, 6)
    assert {(r["a"], r["b"]) for r in graphs.cosine_pairs(rows, 0.999).collect()} == {(a, b) for a, b in zip(*map(list, np.nonzero(sims >= 0.999))) if a < b}


def test_coverage_counts_only_what_stands_twice(spark):
    rows = [(c, i) for c in range(6) for i in range(12) if (c * 7 + i * 5) % 4 < 2] + [(9, 99), (0, 0)]
    parents = [(p, i) for p in range(5) for i in range(12) if (p + i) % 3] + [(0, 1)]
    got = reports.covered(spark.createDataFrame(rows, "cluster long, id long"), spark.createDataFrame(parents, "parent long, id long"))
    mine = lambda c: {i for x, i in rows if x == c}
    best = lambda c: max(len(mine(c) & {i for q, i in parents if q == p}) for p in range(5))
    assert {(r["cluster"], r["own"], r["best"]) for r in got.collect()} == {(c, len(mine(c)), best(c)) for c, _ in rows}
    keys = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(cluster" in line and "parent" in line]
    assert not keys


def test_postings_are_made_where_their_block_lies(spark, tmp_path, monkeypatch):
    """No posting is shuffled: words and runs are grouped in the tasks that the texts of their blocks came to."""
    from pyspark.sql import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.update({path.split("/")[-2]: self._df._jdf.queryExecution().executedPlan().toString()}) or write(self, path, *a, **k))
    index.append(spark.createDataFrame([(k, f"fact {k} of this") for k in range(50)], "fact_id long, content string"), str(tmp_path / "i"), 0)
    assert [plans[t].count("Exchange ") - plans[t].count("BroadcastExchange ") for t in ("words", "runs")] == [1, 1]


def test_later_siblings_write_no_pairs(spark, monkeypatch):
    """Facts of few words share three with most others: what is written stays within a few rows for each, by any blocks, with copies and ties, as brute force has it."""
    rng = np.random.default_rng(3)
    start, hour = datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    sets = [sorted({f"w{x}" for x in rng.integers(0, 14, rng.integers(2, 9))}) for _ in range(60)] + [[f"v{k}" for k in range(300)]] * 3
    facts = [(k, f"s{k % 2}" if k % 29 else None, start + hour * int(rng.integers(0, 60)) if k % 31 else None, sets[int(rng.integers(0, len(sets)))]) for k in range(400)]
    rows = spark.createDataFrame(facts, "fact_id long, subject string, valid_from timestamp_ntz, words array<string>")
    want = set()
    for k, subject, at, words in facts:
        met = [(-len(set(words) & set(w)), -(t - start) / hour, i) for i, s, t, w in facts if s == subject and s and at and t and t > at + 12 * hour]
        want |= {(k, i, -n, place) for place, (n, _, i) in enumerate(sorted(x for x in met if x[0] <= -3)[:5], 1)}
    written, plain = [], graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df: written.append(plain(df)) or written[-1])
    for asking, offered in ((1 << 17, 1 << 18), (30, 50)):
        for name, size in (("ASKING", asking), ("LEAST", min(asking, 2048)), ("OFFERED", offered)):
            monkeypatch.setattr(timeline, name, size)
        assert {tuple(r) for r in timeline.later_siblings(rows).collect()} == want
    assert max(df.count() for df in written) <= len(facts)


def test_passages_are_counted_where_they_meet_their_question(spark, monkeypatch):
    """No row for each word or pair of characters of a passage."""
    plans, plain = [], graphs.saved
    monkeypatch.setattr(graphs, "saved", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    asked = spark.createDataFrame([(1, "blue birds sing"), (2, None), (3, "a")], "question_id long, question string")
    stacks = spark.createDataFrame([(1, 10, "blue birds, blue sky"), (1, 11, None), (1, 12, "nothing"), (2, 10, "x"), (3, 10, "a")], "question_id long, passage_id long, content string")
    found = {(r["question_id"], r["arm"], r["passage_id"], r["rank"]) for r in benchmark.ranked(asked, stacks).collect()}
    assert found == {(1, arm, 10, 1) for arm in benchmark.ARMS} | {(1, "grams", 12, 2), (1, "hybrid", 12, 2), (3, "grams", 10, 1), (3, "hybrid", 10, 1)}
    assert "Generate" not in plans[0] and not any("explode(words" in p or "regexp_replace" in p for p in plans[1:])


def test_telemetry_needs_no_table_of_keys_for_each_answer(spark, sf):
    shown = queries.telemetry_report(spark, sf)
    assert "Expand" not in shown._jdf.queryExecution().executedPlan().toString() and shown.count() == 15


def test_bigrams_of_a_line_are_made_once(spark, sf):
    """They are made before a line meets its sentences, not for each of these."""
    for query in ("gate_replay", "postcheck_reasons"):
        above = queries.QUERIES[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
        assert not re.search(r"lower\((one|three|source)#\d+\), \\s\+", above)


def test_large_sets_meet_in_tiles_of_their_own(spark, monkeypatch):
    """Sets that fill one, two and three words with chance bits, in many small blocks: as brute force has it, and each tile in a task of its own."""
    rng = np.random.default_rng(7)
    sets = [sorted(set(map(int, rng.choice(400, n, replace=False)))) for n in (4, 20, 40, 60, 70, 110, 150) for _ in range(12)]
    sets += [s[: -(len(s) // k)] for k in (3, 4, 6) for s in sets[::2]]
    rows = spark.createDataFrame([(k, k % 2, [str(x) for x in s]) for k, s in enumerate(sets)], "id long, source long, grams array<string>")
    classes, _ = graphs.gram_classes(rows, "source")
    monkeypatch.setattr(graphs, "LEAST", 10)
    used, plain = [], graphs._in_tiles
    monkeypatch.setattr(graphs, "_in_tiles", lambda dealt, tiles, *a: used.append((tiles.count(), out := plain(dealt, tiles, *a))) or out)
    got = {(r["a"], r["b"]) for r in graphs.jaccard_pairs(classes, 0.65, "source").collect()}
    kept = {r["id"] for r in classes.collect()}
    j = lambda a, b: round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 6)
    assert got == {(a, b) for a in kept for b in kept if a < b and a % 2 == b % 2 and j(a, b) >= 0.65} and len(got) > 50
    assert used[0][0] > 10 and used[0][1].rdd.getNumPartitions() == used[0][0]


def test_links_are_few(spark, monkeypatch):
    """Vectors of a few dense groups have pairs by the square; a tile writes fewer links than it has vectors, and the components are the same."""
    rng = np.random.default_rng(4)
    v = np.concatenate([c + 0.3 * rng.normal(size=(70, 6)) for c in rng.normal(size=(5, 6))] + [rng.normal(size=(30, 6))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([*((k, x.tolist()) for k, x in enumerate(v)), (900, None)], "id long, vec array<double>")
    for fewest, threshold in ((1024, 0.9), (100, 0.9), (100, 0.97)):
        monkeypatch.setattr(graphs, "FEWEST", fewest)
        parts = graphs._parts(len(v) + 1)
        links = [(r["a"], r["b"]) for r in graphs.cosine_links(rows, threshold).collect()]
        pairs = {(a, b) for a, b in zip(*map(list, np.nonzero(np.round(v @ v.T, 6) >= threshold))) if a < b}
        assert set(links) <= pairs and len(links) < (len(v) + 1) * parts and (len(links) < len(pairs) / 3 or threshold > 0.9)
        label = list(range(len(v)))
        for _ in v:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        got = {r["id"]: r["component"] for r in graphs.components(graphs.cosine_links(rows, threshold), rows).collect()}
        assert got == dict(enumerate(label)) | {900: 900}


def test_rounds_of_merges_deal_each_tile_to_a_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = np.concatenate([c + 0.2 * rng.normal(size=(9, 4)) for c in np.eye(4)[:3]] + [np.eye(4)[3:]] * 2)
    rows = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v)], "id long, component long, vec array<double>")
    monkeypatch.setattr(graphs, "FEWEST", 12)
    used, plain = [], graphs._in_tiles
    monkeypatch.setattr(graphs, "_in_tiles", lambda dealt, tiles, *a: used.append((tiles.count(), out := plain(dealt, tiles, *a))) or out)
    got = {r["id"]: r["cluster"] for r in graphs.merge_rounds(rows, 0.8).collect()}
    assert got == dict(enumerate(graphs.average_linkage(v, 0.8).tolist())) and len(set(got.values())) < len(v)
    assert used[0][0] == 6 and used[0][1].rdd.getNumPartitions() == 6
