"""Operators 1, 3 and 6 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recollect.llm import bpe, packing, segments, token_ids
from recollect.llm.common import new_path

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def libraries():
    return {"byte": Tokenizer.from_file(BYTE), "word": Tokenizer.from_file(WORD)}


ALPHABET = ["'s", "'S", "'re", "'", "’", " ", "  ", "\n", "\t", "a", "b", "É", "İ", "ß", "Σ", "1", "²", "٣", ".", "!", "é", "中", "한", "\x1c", "\x85", "\xa0", "　", "😀", "<|endoftext|>", "<|", "ª", "\x00"]


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_pieces_give_the_ids_of_the_library(kind, path, libraries):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    got = [x.tolist() for _, x in segments.library_table(path, kind).encode(texts)]
    assert got == [e.ids for e in libraries[kind].encode_batch(texts, add_special_tokens=False)]


def test_a_long_text_is_cut_between_words(libraries, monkeypatch):
    monkeypatch.setattr(segments, "PORTION", 50)
    texts = ["some words, and it's 12 o'clock  \n again " * 20, "", "x" * 300, "short"]
    got = [x.tolist() for _, x in segments.library_table(BYTE, "byte").encode(texts)]
    assert got == [libraries["byte"].encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=1200), max_size=4))
def test_simple8b_round_trip(lists):
    arrays = [np.array(x, np.uint64) for x in lists]
    data = b"".join(r + b"\n" for r in token_ids.records(list(range(len(arrays))), arrays))
    back = list(token_ids.read_records(data, portion=700))
    assert [(i, x.tolist()) for i, x in back] == list(enumerate(lists))


def test_simple8b_packs_and_escapes():
    words, used = token_ids.pack_blocks(np.array([1] * 60 + [2**62], np.uint64), np.array([61]))
    assert used.tolist() == [3] and words[0] >> np.uint64(60) == 0 and words[1] >> np.uint64(60) == token_ids.ESCAPE


def test_token_files(spark, odd, none, libraries):
    path = new_path(spark, "test-files")
    token_ids.write_token_files(odd, path, BYTE, per_file=5)
    got = token_ids.token_index(spark, path).orderBy("start").collect()
    want = sorted(((r["doc_id"], libraries["byte"].encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g["doc_id"] for g in got] == [i for i, _ in want]
    at = 0
    for g in got:
        assert g["start"] == at
        at += g["n_tokens"]
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted([(g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got], key=key) == sorted([(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want], key=key)
    lists = token_ids.read_token_files(spark, path).orderBy("file", "place").collect()
    assert [len(r["ids"]) for r in lists] == [g["n_tokens"] for g in got]
    path = new_path(spark, "test-none")
    token_ids.write_token_files(none, path, BYTE)
    assert token_ids.token_index(spark, path).count() == 0


def test_bpe_words_by_speculation_are_exact(libraries):
    pairs = bpe.BytePairs(BYTE)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghilnorstuvwyzéä-") for _ in range(rng.randint(1, 20))) for _ in range(3000)] + ["a" * 3000, " " * 100, "ab" * 999]
    got = [np.frombuffer(x, np.uint32).tolist() for x in pairs.encode_words([w.encode() for w in words])]
    assert got == [pairs.merged(w.encode()) for w in words]
    spoken = [(w, g) for w, g in zip(words, got, strict=True) if w.isalpha()]
    assert [g for _, g in spoken] == [libraries["byte"].encode(w, add_special_tokens=False).ids for w, _ in spoken]
    assert any(pairs.proposal(w.encode()) != g for w, g in zip(words, got, strict=True))  # some guesses do fail


def test_bpe(spark, odd, none, libraries):
    rows = bpe.decoded(bpe.encoded(odd, BYTE).withColumnRenamed("score", "decoded").withColumn("n", __import__("pyspark").sql.functions.size("ids")), BYTE)
    got = sorted((str(r["doc_id"]), r["n"], r["decoded"]) for r in rows.select("doc_id", "n", "decoded").collect())
    want = []
    for r in odd.collect():
        ids = libraries["byte"].encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), libraries["byte"].decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encoded(none, BYTE).count() == 0


def test_bpe_query(spark, sf, docs, libraries):
    got = {r["doc_id"]: r for r in bpe.op3_bpe(spark, sf).collect()}
    for r in docs.collect():
        ids = libraries["byte"].encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["n_tokens"] == len(ids)


def check_pieces(pieces, docs, library):
    want = defaultdict(list)
    for r in docs:
        want[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    per, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        per[p["doc_id"]].append((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, lists in want.items():
        assert sum(n for _, n, _, _ in per[i]) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for start, n, crc, total in sorted(per[i]):
                assert (start, total) == (at, len(lists[0])) and crc == zlib.crc32(np.array(lists[0][at : at + n], "<u4").tobytes())
                at += n
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packing(spark, sf, docs, odd, none, libraries):
    sizes = check_pieces(packing.pieces(docs).collect(), docs.collect(), libraries["word"])
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    check_pieces(packing.pieces(odd).collect(), odd.collect(), libraries["word"])
    assert packing.pieces(none).count() == 0


def test_sum_of_squares_places_by_the_least_sum():
    rng = random.Random(5)
    packer = packing.SumOfSquares(window=16)
    for k in range(400):
        size = rng.randint(1, 15)
        before = packer.levels.copy()
        chosen = packer.level_for(size)

        def cost(h, before=before, size=size):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            return int((after**2).sum())

        options = [h for h in range(16 - size + 1) if h == 0 or before[h]]
        assert chosen in options and cost(chosen) == min(map(cost, options))
        packer.add(k, np.arange(size, dtype=np.uint32))
    packer.settle()
    assert not packer.levels.any()


@pytest.mark.parametrize(("least", "most"), [(1, 150), (40, 60), (64, 65)])
def test_filling_up_moves_little_and_loses_nothing(least, most):
    """Also where no two items fit together, so that all sequences stay open to the end, and where all are full at once."""
    rng = np.random.default_rng(7)
    packer = packing.SumOfSquares(window=64)
    sizes = rng.integers(least, most, 2000)
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n, dtype=np.uint32))
    opened = int(packer.levels.sum())
    assert opened == sum(map(len, packer.open)) and (opened == 2000) == (least == 40) and (opened < 200 or least == 40)
    packer.settle()
    per, sequences = defaultdict(list), Counter()
    for owner, ids, start, sequence, offset in packer.placed:
        assert offset == sequences[sequence] and ids.tolist() == list(range(start, start + len(ids)))
        per[owner].append((start, len(ids)))
        sequences[sequence] += len(ids)
    for k, n in enumerate(sizes):
        at = 0
        for start, size in sorted(per[k]):
            assert start == at
            at += size
        assert at == n
    assert sum(n != 64 for n in sequences.values()) <= 6 and all(n & (n - 1) == 0 for n in sequences.values())
    if least == 1:
        assert packer.moved < 0.05 * sizes.sum()
