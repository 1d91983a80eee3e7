"""Operator 1: token ids in Simple-8b files.

File format.  A file is a run of records, one for each document, in ascending order of ``doc_id``
(files in the order of their names).  All numbers are little-endian.

    record := "S8B1"  n_blocks:u32  doc_id:i64  n_ids:u64  n_words:u64  offset:u32 * n_blocks  word:u64 * n_words  "\\n"

The ids of a document are cut into blocks of 512; ``offset[k]`` is the first word of block k, so blocks
can be decoded on their own.  A word has a selector in its top four bits and packs as many values of the
selector's width as its count says, the first in the lowest bits.  The last word of a block is filled up
with zeros.  Selector 15 is an escape: the next word is one value of up to 64 bits.

Spark's text writer commits the files (a record is one row of bytes, and ``"\\n"`` its line end) and the
binaryFile source reads them, so any store that Spark reaches will do and a lost task is simply run anew.

Results for odd input: a null text is an empty one (its only id is the end id); a null ``doc_id`` sorts first
and comes back as null (it is stored as the smallest long); rows with equal ``doc_id`` stand in the order of
their texts' hashes; an empty table gives no file and no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, whole_text, written
from .segments import library_table, slices

MAGIC = b"S8B1"
BLOCK = 512
#: Widths of the selectors 0 to 13 (fixed values); as many values as fit 60 bits.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
ESCAPE = 15
NULL_ID = -(2**63)
_HEAD = struct.Struct("<4sIqQQ")


# -- coding --------------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 64 stands for 61 and more."""
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    if not high.any():
        return low.astype(np.uint8)
    bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low)
    return np.where(bits > 60, 64, bits).astype(np.uint8)


def _windows(bits: np.ndarray) -> dict[int, np.ndarray]:
    """For each count n, the maximum of n values from each place on, along the rows."""
    out = {1: bits}
    for n, (a, b) in {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (10, 10), 30: (20, 10), 60: (30, 30)}.items():
        w = out[a].copy()
        w[:, :-a] = np.maximum(w[:, :-a], out[b][:, a:])
        out[n] = w
    return out


def pack_blocks(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) for blocks of `sizes` consecutive values, none over BLOCK."""
    rows = len(sizes)
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = int(sizes.max()) + 60
    first = np.cumsum(sizes) - sizes
    place = np.repeat(np.arange(rows) * width - first, sizes) + np.arange(int(sizes.sum()))
    flat = np.zeros(rows * width, np.uint64)
    flat[place] = values
    choice = np.full((rows, width), ESCAPE, np.uint8)
    most = _windows(_bits(flat).reshape(rows, width))
    for s in range(len(WIDTHS) - 1, -1, -1):  # the longest count that fits is set last
        choice[most[int(COUNTS[s])] <= WIDTHS[s]] = s
    choice = choice.ravel()
    step = np.concatenate([COUNTS, [0, 1]]).astype(np.int64)
    take = np.concatenate([np.ones(14, np.int64), [0, 2]])
    row, at, used = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):  # all blocks go forward by one word at a time
        where = row * width + at
        s = choice[where]
        found.append((row, used[row], where))
        used[row] += take[s]
        at = at + step[s]
        on = at < sizes[row]
        row, at = row[on], at[on]
    base = np.cumsum(used) - used
    to = np.concatenate([base[r] + u for r, u, _ in found])
    where = np.concatenate([w for _, _, w in found])
    selector = choice[where]
    words = np.zeros(int(used.sum()), np.uint64)
    for s in np.unique(selector):
        mine = selector == s
        t, w = to[mine], where[mine]
        if s == ESCAPE:
            words[t] = np.uint64(ESCAPE << 60)
            words[t + 1] = flat[w]
            continue
        word = np.full(len(t), np.uint64(int(s) << 60))
        for k in range(int(COUNTS[s])):
            word |= flat[w + k] << np.uint64(k * int(WIDTHS[s]))
        words[t] = word
    return words, used


def unpack_blocks(words: np.ndarray, used: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of blocks of `used` words and `sizes` values each."""
    total = int(sizes.sum())
    selector = (words >> np.uint64(60)).astype(np.uint8)
    count = np.concatenate([COUNTS, [0, 0]])[selector].astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (marked := selector == ESCAPE).any():
        # In a run of words that look like escapes every second one is a value; so is the word behind an escape that ends a run.
        edge = np.flatnonzero(marked & ~np.concatenate([[False], marked[:-1]]))
        run = np.cumsum(np.isin(np.arange(len(words)), edge)) - 1
        escape = marked & ((np.arange(len(words)) - edge[np.maximum(run, 0)]) % 2 == 0)
        raw[1:] = escape[:-1]
        count[raw] = 1
    block = np.repeat(np.arange(len(used)), used)
    ends = np.cumsum(count)
    before = np.concatenate([[0], ends])[np.cumsum(used) - used]  # of all words before the block
    first = np.cumsum(sizes) - sizes
    start = ends - count - before[block] + first[block]
    limit = (first + sizes)[block]
    out = np.zeros(total + 60, np.uint64)
    for s in np.unique(selector[~raw]) if len(words) else ():
        if s == ESCAPE:
            continue
        mine = np.flatnonzero((selector == s) & ~raw)
        mask, b, e, w = np.uint64((1 << int(WIDTHS[s])) - 1), start[mine], limit[mine], words[mine]
        for k in range(int(COUNTS[s])):
            on = b + k < e
            out[(b + k)[on]] = ((w >> np.uint64(k * int(WIDTHS[s]))) & mask)[on]
    out[start[raw]] = words[raw]
    return out[:total]


def _block_sizes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(blocks of each list, size of each block)."""
    blocks = -(-lengths // BLOCK)
    sizes = np.full(int(blocks.sum()), BLOCK, np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    sizes[last] = (lengths - (blocks - 1) * BLOCK)[blocks > 0]
    return blocks, sizes


def records(doc_ids: list[int | None], lists: list[np.ndarray]) -> list[bytes]:
    """A record for each list of ids, without its line end."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    blocks, sizes = _block_sizes(lengths)
    words, used = pack_blocks(np.concatenate(lists).astype(np.uint64) if lists else np.zeros(0, np.uint64), sizes)
    ends = np.concatenate([[0], np.cumsum(used)])
    out, b = [], 0
    for doc_id, n, k in zip(doc_ids, lengths, blocks, strict=True):
        offsets = ends[b : b + k + 1]
        head = _HEAD.pack(MAGIC, k, NULL_ID if doc_id is None else doc_id, n, offsets[-1] - offsets[0])
        out.append(head + (offsets[:-1] - offsets[0]).astype("<u4").tobytes() + words[offsets[0] : offsets[-1]].astype("<u8").tobytes())
        b += k
    return out


def read_records(data: bytes, portion: int = 400_000) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a file's bytes; `portion` ids or one document are decoded at once."""
    held: list[tuple[int, int, int, np.ndarray, np.ndarray]] = []
    at, size = 0, 0

    def decoded():
        n = np.array([x[1] for x in held], np.int64)
        blocks, sizes = _block_sizes(n)
        words = np.concatenate([x[4] for x in held])
        used = np.concatenate([np.diff(np.append(x[3], x[2])) for x in held]).astype(np.int64)
        values = unpack_blocks(words, used, sizes)
        for x, end, m in zip(held, np.cumsum(n), n, strict=True):
            yield None if x[0] == NULL_ID else x[0], values[end - m : end]

    while at < len(data):
        magic, k, doc_id, n, n_words = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        at += _HEAD.size
        offsets = np.frombuffer(data, "<u4", k, at)
        words = np.frombuffer(data[at + 4 * k : at + 4 * k + 8 * n_words], "<u8")
        at += 4 * k + 8 * n_words + 1
        held.append((doc_id, n, n_words, offsets, words))
        size += n
        if size >= portion:
            yield from decoded()
            held, size = [], 0
    if held:
        yield from decoded()


# -- Spark ---------------------------------------------------------------------------------------


#: Bytes that a file may come to: it is read back as one value.
FILE = 1 << 28


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, per_file: int = 4096) -> None:
    """Encodes ``text`` and writes the ids, with `end_id` behind each document, to `path`.

    The rows are dealt to tasks by ranges of ``doc_id`` before they are encoded, so each text moves once.  A file has `per_file` documents,
    or fewer where so many of the longest one would come to more than `FILE` bytes.
    """
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    per_file = max(1, min(per_file, FILE // (8 * longest + 64)))  # a byte of text is one id at most, and that at most a word of 64 bits

    def encode(batches):
        table = library_table(tokenizer, "byte")
        for batch in slices(batches):
            ids, lists, size = [], [], 0
            doc_ids = batch.column(0).to_pylist()
            for k, x in table.encode(batch.column(1).to_pylist()):
                ids.append(doc_ids[k])
                lists.append(np.append(x, np.uint32(end_id)))
                size += len(x)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(records(ids, lists), pa.binary())})
                    ids, lists, size = [], [], 0
            yield pa.RecordBatch.from_pydict({"record": pa.array(records(ids, lists), pa.binary())})

    tie = F.xxhash64("text")
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(encode, "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", per_file)
        .text(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (array of long), and ``file`` and ``place`` in the order of the files."""

    def decode(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                place = 0
                for part in _portions(read_records(data.as_buffer().to_pybytes())):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [file.as_py()] * len(part),
                            "place": pa.array(range(place, place + len(part)), pa.int64()),
                            "doc_id": pa.array([x[0] for x in part], pa.int64()),
                            "ids": pa.array([x[1].astype(np.int64) for x in part], pa.list_(pa.int64())),
                        }
                    )
                    place += len(part)

    return _files(spark, path).mapInArrow(decode, "file string, place long, doc_id long, ids array<long>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _portions(items, size: int = 500_000):
    part, n = [], 0
    for x in items:
        part.append(x)
        n += len(x[1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, from the files alone: doc_id, start, n_tokens and ids_crc32 of each document."""

    def decode(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                rows, start = [], 0
                for doc_id, ids in read_records(data.as_buffer().to_pybytes()):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), *arrays], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = written(_files(spark, path).mapInArrow(decode, "file string, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-index")
    # One row for each file: a window over them all is small.
    sizes = rows.groupBy("file").agg(F.sum("n_tokens").alias("size"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")  # noqa: E731  file names are not in order beyond so many digits
    order = Window.orderBy(number(r"/part-(\d+)-[^/]*$"), number(r"-c(\d+)\.[^/]*$"))
    before = sizes.select("file", (F.sum("size").over(order) - F.col("size")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)
