"""Operator 8: language ID by word-first backoff.

A word that was seen in training is scored by the logarithm of its frequency in each language.  An unseen word is scored by its
character n-grams instead: by those of length five that are known, or if there is none by those of length four, and so
on down to single characters.  Scores are made relative to the other languages before they are added up.

The model is fitted on a bounded sample of labelled rows: about `SAMPLE` documents of each language (drawn by a hash of ``doc_id``), or
fewer if there are more than `TOTAL` / `SAMPLE` languages, or if these have more than a language's part of `BYTES`.  Of these it keeps every
language, every word and every n-gram, each with the languages that it was seen in; so what is sent to the tasks is bounded by the sample, in
rows and in bytes, however long texts are.

Results for odd input: null and empty texts and texts without a letter are ``und`` with score 0; without a labelled row
everything is ``und``; a null ``doc_id`` is not held out and not learned from; rows with a null ``lang`` are not learned from;
a tie goes to the language that sorts first; repeated rows give equal rows; an empty table gives no rows; columns
that are not asked for are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, written
from .segments import LETTER, Pieces, PieceTable, classes, lower_nfc, portions, slices

#: Labelled documents that a language is learned from, and those of all languages.
SAMPLE, TOTAL = 2000, 200_000
#: Bytes of text that all languages are learned from, and the fewest that one is (a hundred languages still have that much each).
BYTES, LEAST_BYTES = 64 << 20, 640 << 10
LONGEST = 5
#: What an unseen word or n-gram counts as.
SMOOTH = 0.5
UNDETERMINED = "und"


def letters(piece: str) -> bool:
    """Whether there is a letter in it (``'s`` has one)."""
    return any(classes(0x110000 if ord(c) > 0x3000 else 0x3001)[ord(c)] == LETTER for c in piece)


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with a space on either side; single characters without."""
    s = f" {word} " if n > 1 else word
    return [s[k : k + n] for k in range(len(s) - n + 1)]


def hashed(kind: int, grams: list[str]) -> np.ndarray:
    """A key for each gram of a kind; kind 0 is words, n the n-grams."""
    return np.fromiter((xxh64_intdigest(g.encode("utf-8", "surrogatepass"), kind) for g in grams), np.uint64, len(grams))


@dataclass
class Model:
    """Known words and n-grams by the sorted 64-bit hashes of their kind and text (a few bytes each, far less than strings would take).

    Of each it has the languages it was seen in and the logarithm of its frequency there; `rest[kind]` is that of one that was not seen.
    """

    languages: list[str]
    keys: np.ndarray
    kinds: np.ndarray
    offsets: np.ndarray
    seen: np.ndarray
    logs: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, languages: list[str], kinds: np.ndarray, keys: np.ndarray, seen: np.ndarray, logs: np.ndarray, rest: np.ndarray) -> Model:
        """From a row for each gram and language."""
        at = np.lexsort((seen, keys))
        distinct, first = np.unique(keys[at], return_index=True)
        return cls(languages, distinct, kinds[at][first].astype(np.uint8), np.append(first, len(keys)), seen[at].astype(np.int32), logs[at].astype(np.float32), rest.astype(np.float32))

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """For each row the logarithm of each language's share in the gram."""
        n = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = self.rest[self.kinds[rows]]
        out[np.repeat(np.arange(len(rows)), n), self.seen[at]] = self.logs[at]
        out -= out.max(axis=1, keepdims=True, initial=-np.inf)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def scored(self, words: list[str]) -> np.ndarray:
        """The scores of words in each language: of the word if it is known, else the mean of its longest n-grams that are."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        rows = self.find(hashed(0, words))
        out[rows >= 0] = self.shares(rows[rows >= 0])
        todo = np.flatnonzero(rows < 0)
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            parts = [grams(words[k], n) for k in todo]
            sizes = np.array([len(p) for p in parts])
            rows, owner = self.find(hashed(n, [g for p in parts for g in p])), np.repeat(np.arange(len(todo)), sizes)
            owner, rows = owner[rows >= 0], rows[rows >= 0]
            known = np.bincount(owner, minlength=len(todo))
            sums = np.zeros((len(todo), len(self.languages)))
            np.add.at(sums, owner, self.shares(rows))
            out[todo[known > 0]] = sums[known > 0] / known[known > 0, None]
            todo = todo[known == 0]
        return out

    def table(self) -> PieceTable:
        """Each piece's scores and its weight (1 for a word, 0 for what is none), as float32 bytes."""

        def encode(pieces: list[bytes]) -> list[bytes]:
            words = [p.decode("utf-8") for p in pieces]
            mine = np.array([letters(w) for w in words], bool)
            out = np.zeros((len(words), len(self.languages) + 1), np.float32)
            out[mine, -1] = 1
            out[mine, :-1] = self.scored([w for w, m in zip(words, mine, strict=True) if m])
            return [row.tobytes() for row in out]

        # As many bytes for many languages as for a few.
        return PieceTable("word", encode, {}, keep=max(1000, 40_000 * 16 // max(16, len(self.languages))))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL, size: int = BYTES) -> Model:
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row for each language
    if not sizes:
        return Model.of([], np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0), np.zeros((LONGEST + 1, 0)))
    each, most = min(sample, total / len(sizes)), max(size / len(sizes), min(size, LEAST_BYTES))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000_000)) / 1_000_000_000
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"], most / max(r["bytes"], 1))) for r in sizes], "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", "text")  # one row for each language

    def count(batches):
        counts: dict[str, list[Counter]] = {}

        def out():
            parts = [(lang, kind, c) for lang, cs in counts.items() for kind, c in enumerate(cs) if c]
            counts.clear()
            sizes = [len(c) for _, _, c in parts]
            join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([lang for lang, _, _ in parts], object), sizes), pa.string()),
                    pa.array(np.repeat(np.array([kind for _, kind, _ in parts], np.int32), sizes)),
                    pa.array(join([hashed(kind, list(c)) for _, kind, c in parts], np.uint64).view(np.int64)),
                    pa.array(join([np.fromiter(c.values(), np.int64, len(c)) for _, _, c in parts], np.int64)),
                ],
                ["lang", "kind", "key", "n"],
            )

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = counts.setdefault(lang, [Counter() for _ in range(LONGEST + 1)])
                for _, parts in portions([lower_nfc(text.lower())]):
                    found = Pieces(parts, "word")
                    words = [p.decode("utf-8", "replace") for p in found.distinct]
                    for w, n in zip(words, np.bincount(found.codes, minlength=len(words)).tolist(), strict=True):
                        if letters(w):
                            mine[0][w] += n
                if len(mine[0]) > 10_000:
                    spell(counts)
                    yield out()
        spell(counts)
        yield out()

    def spell(counts):
        for cs in counts.values():
            for w, n in cs[0].items():
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        cs[k][g] += n

    each = drawn.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counted = written(each, "gram-counts")
    names = sorted(r["lang"] for r in sizes)
    totals = {(r["lang"], r["kind"]): (r["total"], r["distinct"]) for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).collect()}
    number = F.create_map(*(F.lit(x) for k, name in enumerate(names) for x in (name, k)))
    rows = counted.select("kind", "key", F.element_at(number, F.col("lang")).alias("lang"), "n").toArrow()  # of the sample: numbers alone
    kinds, langs, keys = (rows.column(c).to_numpy() for c in ("kind", "lang", "key"))
    size = np.array([[totals.get((x, kind), (0, 0)) for x in names] for kind in range(LONGEST + 1)], float)
    below = np.log(size[:, :, 0] + SMOOTH * (size[:, :, 1] + 1))
    logs = np.log(rows.column("n").to_numpy() + SMOOTH) - below[kinds, langs]
    return Model.of(names, kinds, keys.view(np.uint64), langs, logs, np.log(SMOOTH) - below)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score (a softmax of the summed scores, tempered by the number of words)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # what the sample holds
    place = keep.index("text") if "text" in keep else len(keep)
    rest = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        model = sent.value
        table, wide = model.table(), len(model.languages) + 1
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in slices(batches):
            texts = [lower_nfc((t or "").lower()) for t in batch.column(place).to_pylist()]
            sums = np.zeros((len(texts), wide))
            for numbers, parts in portions(texts):
                found = Pieces(parts, "word")
                values = np.frombuffer(b"".join(table.ids_of(found.distinct)), np.float32).reshape(-1, wide)
                running = np.zeros((len(found.codes) + 1, wide))
                np.cumsum(values[found.codes], axis=0, dtype=float, out=running[1:])
                np.add.at(sums, numbers, running[found.offsets[1:]] - running[found.offsets[:-1]])
            words = np.round(sums[:, -1:])
            z = sums[:, :-1] / np.sqrt(np.maximum(words, 1))
            known = (words[:, 0] > 0) & bool(model.languages)
            which, score = np.full(len(texts), wide - 1), np.zeros(len(texts))
            if model.languages and len(texts):
                best = z.argmax(axis=1)
                share = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
                which, score = np.where(known, best, which), np.where(known, share, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names[which], pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rest.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs), ("doc_id",))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
