"""Operators 2, 4, 5, 7, 8, 9, 10 and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from recollect.llm import langid, licenses, pii, quality, sharding, simhash, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- licenses


def brute_labels(words):
    line = " " + " ".join(words) + " "
    found = []
    for r in licenses.rules():
        if f" {r.keyword} " in line:
            for m in re.finditer(r.pattern, line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, r.priority, r.number, r.label))
    inside = lambda x, y: y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and ((y[0], y[1]) != (x[0], x[1]) or (-y[2], y[3]) < (-x[2], x[3]))
    return [x for x in found if not any(y is not x and inside(x, y) for y in found)]


def check_licenses(rows, texts):
    for (_, text), row in zip(texts, rows, strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        base = [(k, label) for p, label in licenses.BASE.items() for q in [p.split()] for k in range(len(words) - len(q) + 1) if words[k : k + len(q)] == q]
        assert row["n_words"] == len(words)
        assert sorted((b["start"], b["label"]) for b in row["base"]) == sorted(base)
        assert sorted((s["start"], s["end"], s["priority"], s["number"], s["label"]) for s in row["spans"]) == sorted(brute_labels(words))


def test_licenses(spark, odd, none, docs):
    assert len(licenses.rules()) > 300 and len(licenses.SIGNATURES) > 150
    assert not licenses.ungated()
    for df in (odd, docs):
        rows = licenses.scanned(df, "doc_id", "text").collect()
        check_licenses(rows, [(r["doc_id"], r["text"]) for r in rows])
    assert licenses.scanned(none, "doc_id").count() == 0


NOTICES = {
    "Released under WTFPL.": "wtfpl",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Neither the name of Foo, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "see https://creativecommons.org/licenses/by-sa/4.0/ for it": "cc-by-sa-4.0",
    "THE BEER-WARE LICENSE: you can buy me a beer in return": "beerware",
    "a permission of no kind, and software without a word on its use": "",
}


def test_wording_of_licenses(spark):
    texts = list(NOTICES)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = licenses.scanned(rows, "doc_id", "text").collect()
    check_licenses(found, [(r["doc_id"], r["text"]) for r in found])
    assert {r["text"]: ",".join(sorted({s["label"] for s in r["spans"]})) for r in found} == NOTICES
    many = "gpl and the mit license " * 20_000  # one text with tens of thousands of places
    row = licenses.scanned(spark.createDataFrame([(many,)], "text string"), "text").first()
    assert len(row["base"]) == 20_000 and len(row["spans"]) == 40_000


def test_license_digest(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.op2_licenses(spark, sf).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]] or ""))
        base = [(k, label) for p, label in licenses.BASE.items() for q in [p.split()] for k in range(len(words) - len(q) + 1) if words[k : k + len(q)] == q]
        more = brute_labels(words)
        starts = [k for k, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base})) and r["labels"] == ",".join(sorted({x for _, x in base} | {x[4] for x in more}))
        assert r["score"] == max([0, *(x[2] for x in more), *([licenses.BASE_SCORE] if base else [])]) / 100


# -- quality


def brute_statistics(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, none, docs):
    for df in (odd, docs):
        for r in quality.statistics(df.select("doc_id", "text"), "doc_id", "text").collect():
            want = brute_statistics(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.kept(none).count() == 0
    assert quality.kept(odd).columns == odd.columns


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = np.stack([rng.normal(1.6, 0.05, n), rng.normal(0.2, 0.02, n), rng.normal(0.95, 0.02, n)], 1)
    x[:40] += [0.6, 0.3, -0.2]  # a tenth lies far off, on one side
    rows = spark.createDataFrame([(k, "en", "s", 1000, False, *map(float, v)) for k, v in enumerate(x)], "doc_id long, lang string, source string, n_words long, base_failed boolean, x1 double, x2 double, x3 double")
    got = {r["doc_id"]: r for r in quality.judged(rows, *quality.fit(rows)).collect()}
    lower_median = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    u = (x - lower_median(x)) * np.sqrt(1000 / (1000 + quality.SETTLED))
    floored = lambda c: np.where(np.eye(3, dtype=bool), np.maximum(c, np.array(quality.FLOORS) ** 2), c)
    mad = np.maximum(1.4826 * lower_median(np.abs(u)), quality.FLOORS)
    w = u / mad
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    starts = [(np.zeros(3), np.diag(mad**2)), (u.mean(axis=0), floored(np.cov(u.T, bias=True))), (np.zeros(3), floored(3 * np.diag(mad) @ (w.T @ w / n) @ np.diag(mad)))]
    ends = []
    for mean, cov in starts:
        before = None
        while True:
            d = np.einsum("ij,jk,ik->i", u - mean, np.linalg.inv(cov), u - mean)
            near = u[d <= np.sort(d)[int(np.ceil(quality.ALPHA * n)) - 1]]
            mean, cov = near.mean(axis=0), floored(np.cov(near.T, bias=True) * quality.consistency(quality.ALPHA))
            det = np.linalg.det(cov)
            if before is not None and det >= before * (1 - quality.SETTLES):
                break
            before = det
        ends.append((det, mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    inv = np.linalg.inv(cov)
    d = np.einsum("ij,jk,ik->i", u - mean, inv, u - mean)
    assert np.allclose([got[k]["distance2"] for k in range(n)], d, rtol=1e-6)
    assert not any(got[k]["kept"] for k in range(40)) and sum(got[k]["kept"] for k in range(40, n)) >= 0.99 * (n - 40)


def test_small_sources_fall_back_on_the_whole_language(spark):
    rng = np.random.default_rng(4)
    sizes = [("en", "a", 10_000), ("en", "b", 50), ("en", None, 60), ("de", "a", 30), (None, None, 20)]
    rows, outliers = [], set()
    for lang, source, n in sizes:
        x = np.stack([rng.normal(1.6, 0.05, n), rng.normal(0.2, 0.02, n), rng.normal(0.95, 0.02, n)], 1)
        x[:5] += [0.6, 0.3, -0.2]
        outliers |= set(range(len(rows), len(rows) + 5))
        rows += [(len(rows) + k, lang, source, 1000, False, *map(float, v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, base_failed boolean, x1 double, x2 double, x3 double")
    groups, of = quality.fit(df)
    assert {r["g"] for r in of.collect()} == {'{"lang":"en","source":"a"}', '{"lang":"en"}', "{}"}
    got = quality.judged(df, groups, of).collect()
    assert len(got) == len(rows) and all(r["distance2"] is not None for r in got)
    assert {r["doc_id"] for r in got if not r["kept"]} == outliers
    few = df.filter("lang = 'de'")  # fewer than LEAST in all: none is rejected
    assert all(r["kept"] for r in quality.judged(few, *quality.fit(few)).collect())


def test_chi_squared():
    assert quality.chi3_quantile(0.95) == pytest.approx(7.814728, abs=1e-5)
    draws = np.random.default_rng(0).normal(size=(200_000, 3))
    near = draws[(draws**2).sum(axis=1) <= quality.chi3_quantile(0.6)]
    assert quality.consistency(0.6) * near.var(axis=0).mean() == pytest.approx(1, abs=0.02)


# -- sharding


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards(spark, odd, none, docs, shards):
    for df in (odd, docs):
        rows = sharding.assign(df, shards).collect()
        counts = Counter(r["shard"] for r in rows)
        assert len(rows) == df.count() and max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
        for s, n in counts.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert sharding.assign(none, shards).count() == 0


def test_one_more_shard_moves_little(spark, sf):
    df = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    a, b = ({r["doc_id"]: r for r in sharding.assign(df, n).collect()} for n in (16, 17))
    assert sum(a[i]["shard"] != b[i]["shard"] for i in a) < 0.2 * len(a)
    over = sum(max(0, n - len(a) // 16 - 1) for n in Counter(r["home_shard"] for r in a.values()).values())
    assert sum(r["shard"] != r["home_shard"] for r in a.values()) <= over + 16


def test_a_repeated_key_is_split(spark):
    df = spark.createDataFrame([(7, "same")] * 500 + [(k, "x") for k in range(500)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.assign(df, 4).collect())
    assert set(counts.values()) == {250}


# -- top-k


@pytest.mark.parametrize("scale", [1, 2**20])
def test_threshold_algorithm(spark, scale):
    rng = np.random.default_rng(4)
    vectors = rng.integers(-20, 20, (700, 6)) * scale
    vectors[:100] = vectors[100:200]  # ties
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, v array<long>").repartition(3)
    got = topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 20, per_block=64).collect()
    want = set()
    for q in range(0, 700, 20):
        order = sorted((x for x in range(700) if x != q), key=lambda x: (-int(vectors[q] @ vectors[x]), x))[:20]
        want |= {(q, r + 1, x, int(vectors[q] @ vectors[x])) for r, x in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_the_threshold_stops_early():
    rows = np.zeros((4000, 2), np.int64)
    rows[:50] = 100
    best = np.full((1, 5), topk.NONE), np.full((1, 5), 2**62)
    assert topk.search(np.array([-1]), np.array([[1, 1]]), np.arange(4000), rows, best, 5) < 1000
    assert best[1].tolist() == [[0, 1, 2, 3, 4]]


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 2.0]), (1, [None, 1.0]), (2, None), (3, [inf, 0.0]), (4, [nan, 1.0]), (5, [0.5, -0.01]), (None, [1.0, 1.0]), (6, []), (7, [1.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0])]
    rows = topk.whole_vectors(spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, score string"))
    assert sorted((r["vec_id"], r["v"]) for r in rows.collect()) == [(0, [64, 128]), (5, [32, -1]), (7, [64]), (20, [64, 128]), (20, [64, 128])]
    got = topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 2).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0} == {(0, 1, 20), (0, 2, 20)}
    assert topk.top_k(rows.limit(0), rows.limit(0), 2).count() == 0


# -- language


def test_language(spark, odd, none, docs):
    found = langid.predict(docs, langid.fit(docs)).withColumn("held_out", langid.held_out()).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["held_out"] for r in found} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    model = langid.fit(docs)
    rows = langid.predict(odd, model, ("doc_id", "text")).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in rows)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none), ("doc_id",)).collect()} == {"und"}


def test_und_only_without_a_letter(spark, docs):
    model = langid.fit(docs)
    texts = ["5's", "'re 7", "12 !? 9", "", None, "ß", "'", "3.14 %", "ª"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["lang_pred"] for r in langid.predict(rows, model, ("text",)).collect()}
    assert {t for t in texts if got[t] == "und"} == {"12 !? 9", "", None, "'", "3.14 %"}


def test_language_against_brute_force(spark, docs):
    """The counts, the backoff and the scores once more, with dictionaries and without arrays."""
    import math
    import unicodedata

    import regex

    cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    words_of = lambda t: [w for w in cut.findall(unicodedata.normalize("NFC", (t or "").lower())) if regex.search(r"\p{L}", w)]
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            mine = counts.setdefault(r["lang"], [Counter() for _ in range(6)])
            for w in words_of(r["text"]):
                mine[0][w] += 1
                for k in range(1, 6):
                    mine[k].update(langid.grams(w, k))
    names = sorted(counts)

    def share(kind, gram):
        if not any(gram in counts[x][kind] for x in names):
            return None
        logs = [math.log(counts[x][kind][gram] + 0.5) - math.log(sum(counts[x][kind].values()) + 0.5 * (len(counts[x][kind]) + 1)) for x in names]
        top = max(logs)
        whole = top + math.log(sum(math.exp(v - top) for v in logs))
        return [v - whole for v in logs]

    def scored(w):
        if (v := share(0, w)) is not None:
            return v
        for k in range(5, 0, -1):
            known = [v for g in langid.grams(w, k) if (v := share(k, g)) is not None]
            if known:
                return [sum(c) / len(known) for c in zip(*known, strict=True)]
        return [0.0] * len(names)

    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs, sample=10**9, total=10**9), ("doc_id",)).collect()}
    memo = {}
    for r in rows:
        words = words_of(r["text"])
        sums = [0.0] * len(names)
        for w in words:
            v = memo.setdefault(w, None) or memo.__setitem__(w, scored(w)) or memo[w]
            sums = [a + b for a, b in zip(sums, v, strict=True)]
        z = [v / math.sqrt(max(1, len(words))) for v in sums]
        if not words:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        score = 1 / sum(math.exp(v - max(z)) for v in z)
        lang, found = got[r["doc_id"]]
        assert found == pytest.approx(score, rel=1e-3) and z[names.index(lang)] >= max(z) - 1e-3


def test_backoff_goes_to_shorter_grams():
    known = {(0, "known"): (0.5, 0.5), (1, "x"): (0.2, 0.8), (3, "abc"): (0.9, 0.1), (3, "bcz"): (0.1, 0.9)}
    rows = [(k, g, lang, np.log(v)) for (k, g), p in known.items() for lang, v in enumerate(p)]
    kinds, names, seen, logs = zip(*rows, strict=True)
    keys = np.array([langid.hashed(k, [g])[0] for k, g in zip(kinds, names, strict=True)])
    model = langid.Model.of(["a", "b"], np.array(kinds), keys, np.array(seen), np.array(logs), np.zeros((6, 2)))
    found = model.scored(["known", "xx", "zabcz", "q"])
    assert np.allclose(np.exp(found[:2]), [[0.5, 0.5], [0.2, 0.8]], atol=1e-6)
    assert np.allclose(found[2], np.log([[0.9, 0.1], [0.1, 0.9]]).mean(axis=0), atol=1e-6) and found[3].tolist() == [0.0, 0.0]
    one = langid.Model.of(["a", "b"], np.array([0]), langid.hashed(0, ["w"]), np.array([1]), np.log([0.5]), np.log(np.full((6, 2), 0.25)))
    assert np.allclose(np.exp(one.scored(["w"])), [[1 / 3, 2 / 3]], atol=1e-6)


# -- simhash


def brute_print(text, width=3):
    w = WORD.findall(lower(text or ""))
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    root = {p: p for p in set(prints)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in root}


def test_masks_cover():
    rng = np.random.default_rng(0)
    for radius in (1, 3, 5):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & flips for m in found)


def test_masks_keep_half_of_the_bits():
    for radius in (3, 5, 6, 8, 9):
        kept = [(m & 2**64 - 1).bit_count() for m in simhash.masks(radius)]
        assert len(kept) == 2 ** (radius + 1) - 1 and min(kept) >= 16 and max(kept) <= 48, radius
    rng = np.random.default_rng(0)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 6, replace=False))
        assert any(not m & flips for m in simhash.masks(6))


def test_simhash(spark, odd, none, docs):
    for df in (odd, docs):
        texts = [(r["doc_id"], r["text"]) for r in df.collect()]
        prints = [brute_print(t) for _, t in texts]
        of = brute_components(prints)
        least = {}
        for (i, _), p in zip(texts, prints, strict=True):
            if i is not None:
                least[of[p]] = min(i, least.get(of[p], i))
        want = sorted((str(i), p, str(least.get(of[p]))) for (i, _), p in zip(texts, prints, strict=True))
        got = sorted((str(r["doc_id"]), r["fp"] & 2**64 - 1, str(r["component_id"])) for r in simhash.groups(df).collect())
        assert got == want
        kept = simhash.kept(df)
        assert kept.columns == df.columns and kept.count() == len(set(of.values()))
    assert simhash.groups(none).count() == 0 and simhash.kept(none).count() == 0


@pytest.mark.parametrize("tile", [4, 20, 4096])
def test_large_buckets_are_dealt_to_parts(spark, tile):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    prints = {base}
    while len(prints) < 300:  # a chain of near fingerprints, most of them in one bucket
        prints.add(int(rng.choice(list(prints))) ^ (1 << int(rng.integers(0, 16))) ^ (1 << int(rng.integers(0, 16))))
    prints |= {int(x) for x in rng.integers(0, 2**62, 50)}
    nodes = spark.createDataFrame([(p, p) for p in prints], "a long, fp long").repartition(5)
    roots = {r["a"]: r["root"] for r in simhash.families(nodes, ("fp",), 3, tile).collect()}
    assert {p: roots.get(p, p) for p in prints} == brute_components(prints)


def test_parts_lose_no_link(spark):
    """Several groups dealt to parts: a dense one, one of small families, a chain, and one without links."""
    rng = np.random.default_rng(5)
    rows = [(0, 1 << k) for k in range(40)] + [(1, int(x) << 8 | k) for x in rng.integers(0, 2**40, 30) for k in range(3)]
    rows += [(2, (1 << k) - 1) for k in range(60)] + [(3, int(x)) for x in rng.integers(0, 2**62, 80)]
    near_of = lambda t: lambda x, others: np.bitwise_count(t.column("held").to_numpy()[others] ^ t.column("held").to_numpy()[x]) <= 1
    df = spark.createDataFrame([(g, 7, (g << 60) + k, fp) for k, (g, fp) in enumerate(rows)], "g long, parts int, name long, held long").repartition(3)
    for hubs in (0, 3, 1000):
        roots = {r["a"]: r["root"] for r in simhash.components(simhash.linked(df, near_of, hubs)).collect()}
        want = {}
        for g in range(4):
            of = brute_components([fp for h, fp in rows if h == g], 1)
            least = {}
            for k, (h, fp) in enumerate(rows):
                if h == g:
                    want[(g << 60) + k] = least.setdefault(of[fp], (g << 60) + k)
        assert {n: roots.get(n, n) for n in want} == want


def test_runs():
    import pyarrow as pa

    keys = np.repeat([1, 2, 5, 6, 9], [3, 1, 40, 2, 30])
    batches = [pa.RecordBatch.from_pydict({"k": keys[k : k + 7], "v": np.arange(len(keys))[k : k + 7]}) for k in range(0, len(keys), 7)]
    whole, over = [], []
    for table, starts in simhash.runs_of(batches, 1, 10):
        if starts is None:
            over += table.column("v").to_pylist()
        else:
            whole += [table.column("k")[int(s)].as_py() for s in starts]
    assert whole == [1, 2, 6] and over == [*range(4, 44), *range(46, 76)]


def test_filter_stops_no_member(spark):
    from recollect.llm.common import Filter

    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    found = Filter.of(keys)
    members = np.array([r["k"] for r in keys.collect()])
    others = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    assert found.has(members).all() and found.has(others).mean() < 0.02
    assert not Filter.of(keys.limit(0)).has(members).any()


# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    d = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


PII = ["a@b.c_d@e.f g@h", "aa.bb@c-d.e..f@g.h@i.j.", "1.2.3.4.5.6.7.8.9", "001.002.003.0004 0000255.1.1.1", "é😀 x@y.zz +1 (555) 123-4567 and 4111 1111 1111 1111-", "+1 +12345678 +1234567890 555.", "9" * 9000, "+1" + "(" * 5000, "a" * 30000 + "@", "1." * 3000, "a@" * 3000, "4111-1111-1111-1111 4111111111111111 12 34"]


def test_base_spans(spark, odd, none, docs):
    extra = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for df in (odd, docs, extra):
        texts = {(r["doc_id"], r["text"]) for r in df.collect()}
        want = {(i, tuple(brute_spans(t))) for i, t in texts}
        assert {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in pii.found(df).collect()} == want
        cleaned = pii.cleaned(df)
        assert cleaned.columns == df.columns and cleaned.count() == df.count()
        before = Counter((r["doc_id"], r["text"]) for r in df.collect() if not brute_spans(r["text"]))
        after = Counter((r["doc_id"], r["text"]) for r in cleaned.collect())
        assert not before - after  # clean texts stay as they are
    assert pii.found(none).count() == 0 and pii.cleaned(none).count() == 0


def brute_terms(texts, support):
    """For each text the places of its telling terms, with the greatest part of an entity's information that they reveal."""
    import math

    import regex

    bare = [re.sub(PATTERNS["email"], lambda m: " " * len(m[0]), t or "") for t in texts]
    digits = lambda v: re.sub("[^0-9]", "", v)
    entities = [{k + ":" + (digits(t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for k, a, b in brute_spans(t)} if t else set() for t in texts]
    words = [{w.lower() for w in regex.findall(r"\p{L}{3,}", t)} for t in bare]
    n, n_e, n_t, n_et, where = len(texts), Counter(), Counter(), Counter(), {}
    for t, es, ws in zip(texts, entities, words, strict=True):
        n_e.update(es)
        n_t.update(ws)
        for pair in ((e, w) for e in es for w in ws):
            n_et[pair] += 1
            where.setdefault(pair, set()).add(t)
    part = {p: math.log2(c * n / (n_e[p[0]] * n_t[p[1]])) / math.log2(n / n_e[p[0]]) for p, c in n_et.items() if len(where[p]) >= support and n_e[p[0]] < n}
    # Entities of fewer texts: terms of their sentences that no text has in which the two don't meet so.
    of_entity, near = {}, Counter()
    for t, es in zip(texts, entities, strict=True):
        for e in es:
            of_entity.setdefault(e, set()).add(t)
    part = {(e, w): v for (e, w), v in part.items() if len(of_entity[e]) >= support}
    for t in filter(None, texts):
        met = set()
        for s in re.split(r"(?<=[.!?])\s|\n", t):
            es = {k + ":" + (digits(s[a:b]) if k in ("card", "phone") else s[a:b].lower()) for k, a, b in brute_spans(s)}
            ws = {w.lower() for w in regex.findall(r"\p{L}{3,}", re.sub(PATTERNS["email"], lambda m: " " * len(m[0]), s))}
            met |= {(e, w) for e in es for w in ws}
        near.update(met)
    part |= {(e, w): len(of_entity[e]) / (len(of_entity[e]) + pii.SHRINK) for (e, w), c in near.items() if e in of_entity and len(of_entity[e]) < support and c == n_t[w]}
    out = []
    for text, es in zip(bare, entities, strict=True):
        of = lambda w, es=es: max((v for e in es if (v := part.get((e, w.lower()), 0)) >= pii.GENERALISE), default=None)
        out.append([(m.start(), m.end(), of(m[0])) for m in regex.finditer(r"\p{L}{3,}", text) if of(m[0])])
    return out


def test_telling_terms(spark):
    filler = "each of these words stands apart from all other sentences " * 4  # more than a window of a few dozen characters
    texts = [f"Zaphod Beeble wrote number {k} here. {filler} Some common words and box{k}@mail.org today, says BEEBLE." for k in range(30)]
    texts = [t.replace(f"box{k}@", "secret@") if k < 6 else t.replace("Zaphod Beeble", "a person").replace("BEEBLE", "she") for k, t in enumerate(texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.found(rows).collect():
        said = [texts[r["doc_id"]][t["start"] : t["end"]].lower() for t in r["terms"]]
        assert said == (["zaphod", "beeble", "beeble"] if r["doc_id"] < 6 else [])
    clean = {r["doc_id"]: r["text"] for r in pii.cleaned(rows).collect()}
    assert clean[2].startswith("  wrote number 2 here.") and clean[2].endswith("words and [EMAIL] today, says .") and "box9" not in clean[9]


@pytest.mark.parametrize("support", [1, 3])
def test_telling_terms_against_brute_force(spark, support):
    rng = np.random.default_rng(6)
    common, names = [f"word{c}" for c in "abcdefghijklmnop"], [f"name{c}" for c in "abcdefghij"]
    people = {n: e for n, e in zip(names, ["x@y.org", "a.b@c.de", "10.1.2.3", "+49 30 1234567", "4111 1111 1111 1111", "q@r.st", "10.9.9.9", "m@n.op", "u@v.wx", "k@l.mn"], strict=True)}
    texts = []
    for _ in range(160):
        words = rng.choice(common, 12).tolist()
        for name in rng.choice(names, rng.integers(0, 3), replace=False):
            words.insert(rng.integers(len(words)), people[name])
            if rng.random() < 0.95:
                words.insert(rng.integers(len(words)), str(rng.choice([name, name.upper(), f"né{name}"])))
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[5], None, "", "namea without its address"]
    texts += ["Ask Jane.Doe about it. Only jane knows rare@once.org today! word", "Zork wrote to two@twice.org, says word.\nNobody else", "Zork and two@twice.org again? Yes", "a line with +49 89 7654321 and Quux\nword", "a line with +49 89 7654321 and Quux\nword"]
    want = brute_terms(texts, support)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [(t["start"], t["end"], t["part"]) for t in r["terms"]] for r in pii.found(rows, support).collect()}
    assert {k: [x[:2] for x in v] for k, v in got.items()} == {k: [x[:2] for x in v] for k, v in enumerate(want)}
    assert sum(map(len, want)) > 20 and all(x[2] == pytest.approx(y[2]) for k, v in enumerate(want) for x, y in zip(got[k], v, strict=True))


def test_every_number_of_texts_is_covered(spark, docs):
    """Terms of entities that stand in one text only: on the given table these are all, so without them the method would add nothing."""
    found = {r["texts"]: r for r in pii.coverage(docs).collect()}
    assert found[1]["entities"] > 0 and 0 < found[1]["with_terms"] <= found[1]["entities"]
    rows = pii.found(docs).collect()
    assert sum(bool(r["terms"]) for r in rows) > 0 and all(r["base"] for r in rows if r["terms"])
    assert all(t["part"] < pii.REMOVE for r in rows for t in r["terms"] if found.keys() == {1})


def test_many_matches_in_one_text(spark):
    import time

    n = 32_000
    text = " ".join(f"u{k}@x{k % 7}.org" for k in range(n))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    row = pii.found(rows).collect()[0]
    assert len(row["base"]) == n and (row["base"][-1]["start"], row["base"][-1]["end"]) == (len(text) - len("u31999@x2.org"), len(text))
    assert pii.cleaned(rows).collect()[0]["text"] == " ".join(["[EMAIL]"] * n)
    assert time.time() - begun < 60


def test_replaced(spark):
    from recollect.llm.spans import replaced

    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 40):
        text = "".join(rng.choice(list("abc é😀"), 9000))
        spans = sorted((int(a), int(a + rng.integers(1, 300)), f"<{k}>") for k, a in enumerate(rng.integers(0, 9000, n)))
        spans = [(a, min(b, 9000), s) for a, b, s in spans]
        out, at = [], 0
        for a, b, label in spans:
            if a >= at:
                out += [text[at:a], label]
            at = max(at, b)
        row = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,label:string>>")
        assert row.select(replaced(row["t"], row["s"])).first()[0] == "".join(out) + text[at:]


def test_base_digest(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.op10_pii(spark, sf).collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_similar_groups_against_brute_force(spark, odd, none, docs):
    def shingles(text, width):
        words = (text or "").encode().lower().split()
        return [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []

    base = [r["text"] for r in docs.filter("length(text) > 600").orderBy("doc_id").limit(25).collect()]
    rng, rows = np.random.default_rng(3), []
    for n, text in enumerate(base):
        for edits in (0, 0, 1, 2, 3, 5, 8):
            words = text.split()
            for at in rng.integers(0, len(words), edits):
                words[at] = f"w{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words) if n else text))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "three small words"), (len(rows) + 3, "three  small words")]
    count, radius = 5, 4
    features = [np.array([xxhash.xxh64_intdigest(x, 42) for x in [*set(shingles(t, 1)), *shingles(t, 2)]], np.uint64) for _, t in rows]
    fp = simhash.majority(features, count)
    sets = [set(shingles(t, 5)) for _, t in rows]

    def joined(near):
        top = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if near(a, b):
                    x, y = top[a], top[b]
                    top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    tied = joined(lambda a, b: (np.bitwise_count(fp[a] ^ fp[b]) <= radius).any())
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    top = joined(lambda a, b: tied[a] == tied[b] and alike(a, b))
    every = joined(alike)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for per_task in (1024, 3):  # the same components when each root is dealt to many parts
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, count, radius, rows_per_task=per_task).collect()}
        assert got == dict(enumerate(top)) and len(set(top)) < len(rows) - 40
    assert len(set(top)) <= len(set(every)) + 3  # few of the links that all pairs of texts have are lost
    assert sorted(r["doc_id"] for r in simhash.kept_similar(df, count, radius).collect()) == sorted(set(top))
    assert simhash.similar_groups(none).count() == 0 and simhash.similar_groups(odd).count() == odd.count()
    kept = simhash.kept_similar(odd)
    assert kept.columns == odd.columns and len({r["text"] or "" for r in kept.collect()}) == kept.count()


def test_several_fingerprints_are_majorities():
    rng = np.random.default_rng(0)
    hashes = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 7, 1000)]
    got = simhash.majority(hashes, 3, portion=64)
    for h, prints in zip(hashes, got, strict=True):
        for k in range(3):
            values = [int(x) for x in simhash.mixed(h, k)]
            assert int(prints[k]) & 2**64 - 1 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
