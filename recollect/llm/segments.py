"""Cutting texts into the pieces that the tokenizers' patterns find, and encoding each distinct piece once.

The two patterns are

* ``byte``:  ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
* ``word``:  NFC and lower case first, then ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``

Both only look at the class of a code point (space, letter, number, other), at single spaces before a
run and at the apostrophe endings, so a column of texts is cut with a few array operations.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points with the property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Texts are handled in portions of about so many code points; a longer text is cut between two words.
PORTION = 500_000
#: Below this, no code point has been added since Unicode 15.1.
_LATE = regex.compile("[\u1c89-\U0010ffff]")
_CUT = regex.compile(r"\p{L} (?=\p{L})")


#: Most texts stay below this code point, and a small table is enough.
SMALL = 0x3001


@lru_cache(2)
def classes(size: int) -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    table = np.array([of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(size)], np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def byte_classes() -> np.ndarray:
    """For UTF-8 whose only characters beyond ASCII are letters from U+00C0 to U+027F: their bytes count as letters."""
    return np.concatenate([classes(SMALL)[:128], np.full(128, LETTER, np.uint8)])


def only_letters_beyond_ascii(data: bytes) -> bool:
    a = np.frombuffer(data, np.uint8)
    return a.max() < 0xCA and not (a == 0xC2).any() and b"\xc3\x97" not in data and b"\xc3\xb7" not in data


def slices(batches, rows: int = 600):
    """The record batches in slices, so that few texts are Python strings at once."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def portions(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, parts of them) of at most about PORTION code points; a long text has several parts, in order."""
    numbers, parts, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            end = len(text)
            if end - at > PORTION and (m := _CUT.search(text, at + PORTION)):
                end = m.end() - 1
            if size and size + end - at > PORTION:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(k)
            parts.append(text[at:end])
            size += end - at
            at = end
            if not text:
                break
    if numbers:
        yield numbers, parts


def piece_starts(cp: np.ndarray, bounds: np.ndarray, kind: str) -> np.ndarray:
    """Which code points (or bytes, as uint8) begin a piece; `bounds` are the places where a text begins."""
    n = len(cp)
    c = (byte_classes() if cp.dtype == np.uint8 else classes(SMALL) if cp.max() < SMALL else classes(sys.maxunicode + 1))[cp]
    start = np.ones(n, bool)
    np.not_equal(c[1:], c[:-1], out=start[1:])
    start[bounds] = True
    if kind == "byte":
        white = c == SPACE
        last = np.zeros(n, bool)  # the last of a run of white space, with something behind it
        np.greater(white[:-1], white[1:], out=last[:-1])
        last[bounds[1:] - 1] = False
        start |= last
        start[np.flatnonzero(last & (cp == 32)) + 1] = False
    else:
        start |= c == NUMBER
    at = np.flatnonzero((cp == 39) & start)
    if len(at):
        around = np.concatenate([cp, np.zeros(4, cp.dtype)])
        if kind == "word":
            around = np.where((around >= 65) & (around <= 90), around + 32, around)
        edge = np.ones(n + 4, bool)
        edge[:n] = False
        edge[bounds] = True
        long = np.ones(n + 4, bool)
        long[:n] = start
        a, b = around[at + 1], around[at + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & ~edge[at + 1]
        two = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        two &= ~edge[at + 1] & ~edge[at + 2]
        long[at[one] + 1] = False
        long[at[one] + 2] = True
        long[at[two] + 1] = False
        long[at[two] + 2] = False
        long[at[two] + 3] = True
        start = long[:n]
        start[bounds] = True
    return start


def lower_nfc(text: str) -> str:
    """What NFC and lower case of the ``word`` pattern change about the borders of pieces; the pieces are lower-cased later."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text).replace("İ", "i̇")


def unknown(text: str) -> bool:
    return bool(_LATE.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class Pieces:
    """The pieces of some texts: ``codes`` into ``distinct`` (bytes), and where each text's codes begin."""

    def __init__(self, parts: list[str], kind: str):
        each = [p.encode("utf-8", "surrogatepass") for p in parts]
        data = b"".join(each)
        if not data:
            self.codes, self.distinct = np.zeros(0, np.int32), []
            self.offsets = np.zeros(len(parts) + 1, np.int64)
            return
        if only_letters_beyond_ascii(data):
            lengths = np.fromiter(map(len, each), np.int64, len(parts))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            starts = places = np.flatnonzero(piece_starts(np.frombuffer(data, np.uint8), bounds[:-1][lengths > 0], kind))
        else:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.flatnonzero(piece_starts(cp, bounds[:-1][lengths > 0], kind))
            width = 1 + (cp >= 0x80).view(np.uint8) + (cp >= 0x800) + (cp >= 0x10000)
            places = (np.cumsum(width, dtype=np.int64) - width)[starts]
        offsets = np.append(places, len(data)).astype(np.int32)
        array = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        self.codes = array.indices.to_numpy()
        self.distinct = array.dictionary.to_pylist()
        self.offsets = np.searchsorted(starts, bounds)


class PieceTable:
    """Encodes texts by encoding each distinct piece once; pieces met lately are kept, at most twice `keep` of them."""

    def __init__(self, kind: str, encode: Callable[[list[bytes]], list[bytes]], special: dict[str, int], whole: Callable[[str], np.ndarray] | None = None, keep: int = 120_000):
        """`whole` encodes a text with code points that this Python's tables don't know yet."""
        self.kind, self.encode_pieces, self.keep, self.whole = kind, encode, keep, whole
        self.special = special
        self.splits = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        new, old = self.new, self.old
        found = [new.get(p) for p in pieces]
        missing = [k for k, v in enumerate(found) if v is None]
        rest = []
        for k in missing:
            if (v := old.get(pieces[k])) is None:
                rest.append(k)
            else:
                found[k] = new[pieces[k]] = v
        for k, v in zip(rest, self.encode_pieces([pieces[k] for k in rest]), strict=True):
            found[k] = new[pieces[k]] = v
        if len(new) > self.keep:
            self.old, self.new = new, {}
        return found

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = Pieces(parts, self.kind)
        values = self.ids_of(pieces.distinct)
        flat = np.frombuffer(b"".join(values), np.uint32)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        first = np.cumsum(size) - size
        n = size[pieces.codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[pieces.codes] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[pieces.offsets]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, its ids as uint32), in order; each text is one item."""
        if self.kind == "word":
            texts = [lower_nfc(t) for t in texts]
        pieces, owner, fixed = [], [], {}
        for k, t in enumerate(texts):
            if self.kind == "word" and self.whole and unknown(t):
                pieces.append("")
                fixed[len(pieces) - 1] = self.whole(t)
            elif self.splits and "<" in t and (found := list(self.splits.finditer(t))):
                at = 0
                for m in found:
                    pieces += [t[at : m.start()], ""]
                    owner += [k, k]
                    fixed[len(pieces) - 1] = np.array([self.special[m[0]]], np.uint32)
                    at = m.end()
                pieces.append(t[at:])
            else:
                pieces.append(t)
            owner.append(k)
        held: list[np.ndarray] = []
        of = 0
        for numbers, parts in portions(pieces):
            ids, offsets = self._parts(parts)
            for j, k in enumerate(numbers):
                if owner[k] != of:
                    yield of, held[0] if len(held) == 1 else np.concatenate(held)
                    held, of = [], owner[k]
                held.append(fixed[k] if k in fixed else ids[offsets[j] : offsets[j + 1]])
        if texts:
            yield of, held[0] if len(held) == 1 else np.concatenate(held)


#: GPT-2's printable stand-ins for bytes: printable Latin-1 stands for itself, the others for 256 and up, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


@lru_cache(1)
def byte_chars() -> dict[int, int]:
    rest = [b for b in range(256) if b not in set(_PRINTED)]
    return {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(rest)}


@lru_cache(4)
def library_table(path: str, kind: str) -> PieceTable:
    """A table whose pieces the tokenizers library encodes."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, chars = tokenizer.model, byte_chars()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    white = set(WHITE_SPACE)

    def encode(pieces: list[bytes]) -> list[bytes]:
        out = []
        for p in pieces:
            if kind == "word":
                s = p.decode("utf-8")
                if ord(s[0]) in white:
                    out.append(b"")
                    continue
                p = "".join(map(str.lower, s)).encode()
            ids = [t.id for t in model.tokenize(p.decode("latin-1").translate(chars))]
            out.append(pack(f"<{len(ids)}I", *ids))
        return out

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    return PieceTable(kind, encode, special, whole)
