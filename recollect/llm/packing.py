"""Operator 6: packing documents into sequences of a fixed length, by the sum-of-squares rule.

Each task packs the documents of its own partition.  A document of `window` ids or more fills whole
sequences first; what is left of it is one item.  With N(h) the number of open sequences that are filled
to level h, an item of size s goes to the level (or a new sequence) for which the sum of N(h)^2 over all
levels is least afterwards; a full sequence is closed.  The numbers N(h) are the level array, and they
alone decide.  When a partition ends, the fullest open sequences are filled up with what the emptiest ones hold, cutting a piece
where the sequence is full; so what the rule placed stays where it is but for the emptiest.  What is
left at the end of the partition goes into sequences whose lengths are powers of two, which need no
padding.  So every id is in exactly one piece, and none is lost.

A task holds the ids of its open sequences alone, two bytes each where the vocabulary allows; the rule keeps these few.  If no two items of a
partition fit together they are all of it that is no full window, which the size of a partition bounds.

Results for odd input: a null text is an empty one, whose only id is the end id; equal rows are packed like
any others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text
from .segments import library_table, slices

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Packs items, one after the other; `placed` are the pieces that are settled: (owner, ids, start, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.levels = np.zeros(window, np.int64)  # N(h); N(0) stays 0
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: the sequences, each a list of pieces
        self.placed: list[tuple] = []
        self.moved = 0  # ids that filling up has put elsewhere

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for owner, ids, start in pieces:
            self.placed.append((owner, ids, start, self.next, at))
            at += len(ids)
        self.next += 1

    def level_for(self, size: int) -> int:
        """The fill level to add an item of this size to; 0 begins a sequence.  The fuller level wins a tie."""
        n, top = self.levels, self.window - size
        after = np.append(n[size:], 0)  # N at the level reached; a full sequence no longer counts
        cost = 2 * (after - n[: top + 1]) + 2  # how the sum of squares changes: (a+1)^2 - a^2 + (b-1)^2 - b^2
        cost[top] = 1 - 2 * n[top]
        usable = n[: top + 1] > 0
        cost[0] = 2 * after[0] + 1 if size < self.window else 0
        usable[0] = True
        best = np.where(usable, cost, np.iinfo(np.int64).max)
        return top - int(best[::-1].argmin())

    def add(self, owner, ids: np.ndarray) -> None:
        window = self.window
        whole = len(ids) // window * window
        for at in range(0, whole, window):
            self._close([(owner, ids[at : at + window], at)])
        if not (size := len(ids) - whole):
            return
        h = self.level_for(size)
        sequence = self.open[h].pop() if h else []
        if h:
            self.levels[h] -= 1
        rest = ids[whole:]
        sequence.append((owner, rest.astype(np.uint16 if rest.max() < 1 << 16 else np.uint32), whole))
        if h + size == window:
            self._close(sequence)
        else:
            self.open[h + size].append(sequence)
            self.levels[h + size] += 1

    def settle(self) -> None:
        """At the end: fills up the fullest open sequences from the emptiest until one is left, which is cut at powers of two."""
        sequences = [(h, x) for h in range(self.window - 1, 0, -1) for x in self.open[h]]
        self.open = [[] for _ in range(self.window)]
        self.levels[:] = 0
        full, empty = 0, len(sequences) - 1
        while full < empty:
            level, pieces = sequences[full]
            left, from_ = sequences[empty]
            owner, ids, start = from_.pop(0)
            taken = ids[: self.window - level]
            self.moved += len(taken)
            pieces.append((owner, taken, start))
            if len(taken) < len(ids):
                from_.insert(0, (owner, ids[len(taken) :], start + len(taken)))
            sequences[full], sequences[empty] = (level + len(taken), pieces), (left - len(taken), from_)
            if level + len(taken) == self.window:
                self._close(pieces)
                full += 1
            if not from_:
                empty -= 1
        row = sequences[full][1] if full == empty else []
        while row:
            left = 1 << (sum(len(x[1]) for x in row).bit_length() - 1)
            taken = []
            while left:
                owner, ids, start = row.pop(0)
                if len(ids) > left:
                    row.insert(0, (owner, ids[left:], start + left))
                    ids = ids[:left]
                taken.append((owner, ids, start))
                left -= len(ids)
            self._close(taken)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (u32, little-endian), doc_tokens, sequence_id, offset.

    Sequence ids are unique in the table: the partition in the upper bits, a number in the lower 40.
    """

    def packed(batches) -> Iterator[pa.RecordBatch]:
        table = library_table(tokenizer, "word")
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)

        def out():
            rows, packer.placed = packer.placed[:2000], packer.placed[2000:]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r[0][0] for r in rows], pa.int64()),
                    "start": pa.array([r[2] for r in rows], pa.int64()),
                    "length": pa.array([len(r[1]) for r in rows], pa.int64()),
                    "ids": pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary()),
                    "doc_tokens": pa.array([r[0][1] for r in rows], pa.int64()),
                    "sequence_id": pa.array([r[3] for r in rows], pa.int64()),
                    "offset": pa.array([r[4] for r in rows], pa.int64()),
                }
            )

        for batch in slices(batches):
            doc_ids = batch.column(0).to_pylist()
            for k, ids in table.encode(batch.column(1).to_pylist()):
                packer.add((doc_ids[k], len(ids) + 1), np.append(ids, np.uint32(end_id)))
                if len(packer.placed) >= 2000:
                    yield out()
        packer.settle()
        while packer.placed:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(packed, SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir))
