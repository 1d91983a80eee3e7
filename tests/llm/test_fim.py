"""Operator 11 against regular expressions over whole texts, and its structures against plain counts."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from recollect.llm import fim


def brute(key, text, pattern, seed=7, rate=100, spm=50):
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(pattern, text, re.S)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or h[2] % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


PATTERNS = {
    "line": r"[^\n]*\n|[^\n]+",
    "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+",
    "word": r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+|$)[\x20\x09-\x0D]*(?=[^\x20\x09-\x0D]|$)",
    "character": r".",
}


def words(text):
    """Units of words: a text is parted before each word that has something before it."""
    at = [m.start() for m in re.finditer(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", text) if m.start()]
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)] if text else []


def check(rows, unit, **more):
    for r in rows:
        text = r["text"] or ""
        if unit == "word":
            want = brute(r["doc_id"], text, "|".join(re.escape(w) for w in sorted(set(words(text)), key=len, reverse=True)) or "x", **more) if len(text) < 2000 else None
            if want is None or want[0] != len(words(text)):  # one unit is the beginning of another
                assert r["n"] == len(words(text))
                continue
        else:
            want = brute(r["doc_id"], text, PATTERNS[unit], **more)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == text


def back(df):
    return df.withColumn("back", fim.restored(df["output"], df["form"]))


@pytest.mark.parametrize("unit", ["line", "sentence", "character", "word"])
def test_odd_texts(spark, odd, none, unit):
    extra = spark.createDataFrame([(k, t) for k, t in enumerate(["\n", "\n\n\n", "a\n\nb", "a <P> b\nc", "<S>", "x <M>", "< P>\n<", "ü\n.é!\n中\n😀", " lead\n", "a.b. .c", "\ttab word"])], "doc_id long, text string")
    for df in (odd, extra):
        rows = back(fim.transformed(df, unit=unit)).collect()
        assert len(rows) == df.count()
        check(rows, unit)
    assert fim.transformed(none, unit=unit).count() == 0


def test_rates_and_columns(spark, docs):
    df = docs.withColumns({"n": docs["doc_id"], "form": docs["lang"], "row": docs["source"]})
    out = back(fim.transformed(df, rate=60, spm=20, seed=11))
    assert set(out.columns) == {*df.columns, *fim.RESULTS, "back"} and "row" in out.columns
    rows = out.collect()
    check(rows, "line", rate=60, spm=20, seed=11)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_small_portions_change_nothing(docs, monkeypatch):
    def results(portion):
        found = []
        for (a, b), texts in zip([(0, 60), (60, 200)], [[r["text"] or "" for r in docs.orderBy("doc_id").collect()]] * 2, strict=True):
            data = [t.encode() for t in texts[a:b]]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
            held = np.frombuffer(b"".join(data), np.uint8)
            monkeypatch.setattr(fim, "PORTION", portion)
            for i, j in fim._portions(offsets):
                n, places, chars = fim.cuts(held[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], "sentence", np.arange(2 * (j - i)).reshape(-1, 2) % 3)
                found += [(x, *y) for x, y in zip(n.tolist(), (places - (offsets[i:j] - offsets[i])[:, None]).tolist(), strict=True)]
        return [x[0] for x in found]

    assert results(1 << 22) == results(5000) == results(1)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 5000])
def test_wavelet_matrix(size):
    values = np.random.default_rng(size).choice(7, size, p=[0.5, 0.02, 0.2, 0.08, 0.1, 0.05, 0.05]).astype(np.uint8)
    matrix = fim.WaveletMatrix(values)
    places = np.arange(size + 1)
    for c in range(8):
        before = np.concatenate([[0], np.cumsum(values == c)])
        assert (matrix.rank(c, places) == before).all()
        at = np.flatnonzero(values == c)
        if len(at):
            assert (matrix.select(c, np.arange(len(at))) == at).all()
    some = (1, 3, 5)
    at = np.flatnonzero(np.isin(values, some))
    if len(at):
        assert (matrix.place(some, np.arange(len(at))) == at).all()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(fim.OP11_SQL)
    got = fim.op11_fim(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
