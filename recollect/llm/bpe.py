"""Operator 3: byte-level BPE, encoding and decoding, by speculation and verification.

A word is first cut greedily into the longest tokens.  That is a guess; it is the right encoding exactly when
every adjacent pair of its tokens is compatible, i.e. no merge across their border would have come before
the merges that made the two tokens.  All distinct pairs of a batch are tested together, with array
operations: both tokens are taken apart at their inner border, the later merge first, and at each step the
pair now facing each other must have no merge that was due earlier.  Only words with an incompatible pair are
merged exactly, in the order of the merges' ranks.

Results for odd input: a null text is an empty one (no ids, and an empty text again); equal rows give equal
rows; an empty table gives no rows; null ids decode to an empty text; other columns are kept by ``encoded`` and
``decoded`` (a clashing ``ids`` or ``decoded`` column is replaced).
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text
from .segments import PieceTable, byte_chars, slices

NEVER = np.iinfo(np.int32).max


class BytePairs:
    """Tokens and merges of a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {chr(c): b for b, c in byte_chars().items()}
        ids = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*ids.values(), *self.special.values())
        self.ids, self.longest = ids, max(map(len, ids))
        self.bytes = [b""] * self.size
        for t, i in ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, token)
        self.rank = np.full(self.size, -1, np.int32)  # of the merge that makes a token; -1 for single bytes
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        for rank, (a, b) in enumerate(pairs):
            a, b = (bytes(map(byte_of.__getitem__, x)) for x in (a, b))
            x, y, made = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = rank, made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        keys = np.array([x * self.size + y for x, y in self.merges], np.int64)
        order = keys.argsort()
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int32)[order]
        joined = b"".join(self.bytes)
        self.flat = np.frombuffer(joined, np.uint8)
        self.length = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.first = np.cumsum(self.length) - self.length
        #: Tokens that merging their own bytes doesn't give back are never proposed.
        self.proposed = {t: i for t, i in ids.items() if len(t) == 1 or self.merged(t) == [i]}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes together gives just these two."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER, np.int64)
        while len(live):
            clash = self.rank_of(a, b) < limit
            good[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)  # among equal ranks the merge further left comes first
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def proposal(self, word: bytes) -> list[int]:
        out, at, end, known = [], 0, len(word), self.proposed
        while at < end:
            stop = min(end, at + self.longest)
            while (token := known.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: always the merge of least rank, and of these the leftmost."""
        ids, merges = [self.ids[word[k : k + 1]] for k in range(len(word))], self.merges
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(*m, k) for k in range(len(ids) - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, made) for rank, made, k in heap]
        heapify(heap)
        while heap:
            rank, k, made = heappop(heap)
            if ids[k] < 0 or (j := after[k]) >= len(ids) or merges.get((ids[k], ids[j]), (-1,))[0] != rank:
                continue
            ids[k], ids[j] = made, -1
            after[k] = n = after[j]
            if n < len(ids):
                before[n] = k
                if m := merges.get((made, ids[n])):
                    heappush(heap, (m[0], k, m[1]))
            if (p := before[k]) >= 0 and (m := merges.get((ids[p], made))):
                heappush(heap, (m[0], p, m[1]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as u32 bytes."""
        lists = [self.proposal(w) for w in words]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))
        border = np.ones(len(flat), bool)  # with a token of the same word before it
        ends = np.cumsum(size)
        border[(ends - size)[size > 0]] = False
        at = np.flatnonzero(border)
        pairs, which = np.unique(flat[at - 1] * self.size + flat[at], return_inverse=True)
        wrong = at[~self.compatible(pairs // self.size, pairs % self.size)[which]]
        for k in np.unique(ends.searchsorted(wrong, side="right")):
            lists[k] = self.merged(words[k])
        return [pack(f"<{len(x)}I", *x) for x in lists]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(2)
def _pairs(path: str) -> BytePairs:
    return BytePairs(path)


@lru_cache(2)
def _table(path: str) -> PieceTable:
    pairs = _pairs(path)
    return PieceTable("byte", pairs.encode_words, pairs.special)


def encoded(df: DataFrame, tokenizer: str, column: str = "text") -> DataFrame:
    """`df` with ``ids`` (array of int), the encoding of `column`."""
    df = df.drop("ids").withColumn(column, whole_text(column))
    name = df.columns.index(column)

    def run(batches):
        table = _table(tokenizer)
        for batch in slices(batches):
            rows, lists, size = 0, [], 0

            def out(last):
                lengths = np.fromiter(map(len, lists), np.int64, len(lists))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                values = np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.int32)
                part = batch.slice(last - len(lists), len(lists))
                return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, values)], [*batch.schema.names, "ids"])

            for _, x in table.encode(batch.column(name).to_pylist()):
                rows += 1
                lists.append(x)
                size += len(x)
                if size > 1_000_000:
                    yield out(rows)
                    lists, size = [], 0
            yield out(rows)

    return df.mapInArrow(run, _with(df, "ids array<int>"))


def decoded(df: DataFrame, tokenizer: str, column: str = "ids") -> DataFrame:
    """`df` with ``decoded`` in place of `column`: the text of the ids, bytes that are no UTF-8 replaced."""
    df = df.drop("decoded").withColumn(column, F.coalesce(F.col(column), F.array().cast("array<int>")))
    rest = [c for c in df.columns if c != column]

    def run(batches, portion=1_000_000):
        pairs = _pairs(tokenizer)
        for batch in batches:
            lists = batch.column(column)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                parts = [pairs.decode(values[k : min(k + portion, b)]) for k in range(a, b, portion)]
                texts.append(b"".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "decoded"])

    return df.mapInArrow(run, _with(df.select(rest), "decoded string"))


def _with(df: DataFrame, field: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), field])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = encoded(documents(spark, sf_dir).select("doc_id", "text"), path).drop("text")
    rows = rows.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)})
    return decoded(rows, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
