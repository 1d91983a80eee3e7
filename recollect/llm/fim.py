"""Operator 11: fill-in-the-middle by a wavelet matrix over character classes.

A text is cut into units (lines, sentences, words or characters) and two cuts between units, drawn by a hash of the row's key, part it
into prefix, middle and suffix.  The bytes of a portion of texts become classes (`CLASSES`), and these a wavelet matrix of three
bit vectors.  How many units there are up to some place is a sum of ranks of the classes that end (or begin) a unit; the place of a cut is a
``select`` where one class decides, and a bisection on the sum of ranks where several do.  Code points are counted in the same way: places less
the rank of continuation bytes.  All texts of a portion are asked at once.

A text is put out whole, as prefix-suffix-middle (``psm``) or suffix-prefix-middle (``spm``); `restored` turns that back into the text.

Results for odd input: null and empty texts, and texts that hold a marker themselves, are ``plain`` (the text as it is) and have no counts of
prefix and middle; a null key is drawn like an empty one; equal rows give equal rows; an empty table gives no rows; columns of the
input that are named like one of the results are replaced by it, all others stay.  A portion is at least one text, so memory is that of the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts are handled in portions of about so many bytes.
PORTION = 1 << 22
#: Classes of bytes; START and STOP_START begin a word (behind white space or at the beginning of a text), STOP is one of ``.!?``.
CLASSES = OTHER, NEWLINE, SPACE, STOP, START, STOP_START, CONTINUED = range(7)
BITS = 3
#: The classes at whose bytes units part, and whether the cut is behind the byte (1) or before it (0).
UNITS = {
    "line": ((NEWLINE,), 1),
    "sentence": ((NEWLINE, STOP, STOP_START), 1),
    "word": ((START, STOP_START), 0),
    "character": ((OTHER, NEWLINE, SPACE, STOP, START, STOP_START), 0),
}
RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


class Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th (from 0) one, or zero."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        held = self.words[word] if bit else ~self.words[word]
        each = np.unpackbits(held.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(each, axis=1) > (k - before[word])[:, None]).argmax(axis=1)


class WaveletMatrix:
    """Ranks and selects over a sequence of small numbers."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.size, self.levels, self.starts = len(values), [], []
        for level in reversed(range(bits)):
            up = (values >> level) & 1 == 1
            self.levels.append((level, Bits(up), self.size - int(up.sum())))
            values = np.concatenate([values[~up], values[up]])
        self.first = {c: int(self._down(c, np.zeros(1, np.int64))[0]) for c in range(1 << bits)}

    def _down(self, c: int, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = zeros + ones if c >> level & 1 else at - ones
        return at

    def rank(self, c: int, at: np.ndarray) -> np.ndarray:
        """How often `c` stands before each place."""
        return self._down(c, at) - self.first[c]

    def select(self, c: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) `c`."""
        at = self.first[c] + k
        for level, bits, zeros in reversed(self.levels):
            at = bits.select(at - zeros, 1) if c >> level & 1 else bits.select(at, 0)
        return at

    def ranks(self, some: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How often any of `some` stands before each place."""
        return sum(self.rank(c, at) for c in some)

    def place(self, some: tuple[int, ...], k: np.ndarray) -> np.ndarray:
        """The place of the k-th (from 0) of any of `some`: a select of one class, a bisection on the ranks of several."""
        if len(some) == 1:
            return self.select(some[0], k)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), self.size, np.int64)  # ranks(low) <= k < ranks(high)
        for _ in range(self.size.bit_length() + 1):
            half = (low + high) >> 1
            beyond = self.ranks(some, half) > k
            low, high = np.where(beyond, low, half), np.where(beyond, half, high)
        return low


def _table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    table[0x0A] = NEWLINE
    table[[ord(c) for c in ".!?"]] = STOP
    table[0x80:0xC0] = CONTINUED
    return table


TABLE = _table()


def classes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8; `begins` are the places where a text begins."""
    found = TABLE[data]
    if not len(found):
        return found
    white = (found == SPACE) | (found == NEWLINE)
    before = np.ones(len(data), bool)
    before[1:] = white[:-1]
    before[begins] = True
    start = before & ~white
    found[start & (found == OTHER)] = START
    found[start & (found == STOP)] = STOP_START
    return found


def cuts(data: np.ndarray, offsets: np.ndarray, unit: str, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that lie in `data` from one offset to the next: units, the places of both cuts and the code points before each of
    begin, first and second cut.  `draws` has two numbers for each text, which are taken modulo units + 1."""
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    some = end > begin
    matrix = WaveletMatrix(classes(data, begin[some]))
    parting, behind = UNITS[unit]
    # A unit parts from the next at each such byte but the last (behind it) or the first (before it) of the text.
    base = matrix.ranks(parting, np.where(some, begin + 1 - behind, begin))
    last = matrix.ranks(parting, np.where(some, end - behind, begin))
    n = np.where(some, last - base + 1, 0)
    wanted = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.where(wanted == 0, begin[:, None], end[:, None])
    inner = (wanted > 0) & (wanted < n[:, None])
    asked = (base[:, None] + wanted - 1)[inner]
    if len(asked):
        places[inner] = matrix.place(parting, asked) + behind
    marks = np.concatenate([begin[:, None], places], axis=1)
    return n, places, marks - matrix.rank(CONTINUED, marks.ravel()).reshape(marks.shape)


def _portions(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PORTION, side="right")) - 1)
        yield first, last
        first = last


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(df: DataFrame, key: str = "doc_id", column: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """`df` with n (units), form, prefix_chars, middle_chars and output; of a hundred texts `rate` are rearranged, and of these `spm` as spm."""
    rest = [c for c in df.columns if c not in RESULTS]
    rows = df.select(F.struct(*rest).alias("row"), whole_text(column).alias("text"), F.array(*draws(key, seed)).alias("draws"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            numbers = batch.column(2).flatten().to_numpy().reshape(-1, 4)
            for first, last in _portions(offsets):
                at, mine = offsets[first : last + 1] - offsets[first], numbers[first:last]
                held = data[offsets[first] : offsets[last]]
                n, places, chars = cuts(held, at, unit, mine[:, :2])
                raw = held.tobytes()
                forms, outputs = [], []
                for (a, b), (x, y), (_, _, h3, h4) in zip(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), places.tolist(), mine.tolist(), strict=True):
                    text = raw[a:b]
                    if not text or h3 % 100 >= rate or any(mark in text for mark in marks):
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = raw[a:x], raw[x:y], raw[y:b]
                    forms.append("spm" if h4 % 100 < spm else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if forms[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(n, pa.int64()),
                        pa.array(forms, pa.string()),
                        *(pa.array(chars[:, k + 1] - chars[:, k], pa.int64(), mask=plain) for k in (0, 1)),
                        pa.array(outputs, pa.binary()).view(pa.string()),
                    ],
                    ["row", *RESULTS],
                )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in RESULTS.items())
    return rows.mapInArrow(run, schema).select("row.*", *RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text, from what `transformed` has made of it.  No part of a rearranged text holds a marker, so each splits it once."""
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    rest = lambda text: F.substr(text, F.lit(len(PREFIX) + 1))
    tail = part(output, SUFFIX, 2)
    psm = F.concat(rest(part(output, SUFFIX, 1)), part(tail, MIDDLE, 2), part(tail, MIDDLE, 1))
    tail = part(output, PREFIX, 2)
    spm = F.concat(part(tail, MIDDLE, 1), part(tail, MIDDLE, 2), rest(part(output, PREFIX, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda text: F.sha2(text, 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    x AS (SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
    y AS (SELECT *, array_to_string(l[1:least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(l[greatest(a, b) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM y"""
