"""A data source for files of lines that grow: ``spark.readStream.format("growing_lines")`` and ``spark.read`` of the same.

An offset says for each file how many bytes of whole lines have been taken, and a checksum of its first line.  A batch reads what lies between two
offsets and nothing else: appended bytes alone.  A last line that no line break ends yet waits for it.  A file that is shorter than before, or whose
first line is another, was written anew and is read from its beginning.  What is to be read of a file is cut into ranges of `rangeBytes`, each a partition:
a line belongs to the range in which it begins.  So files of any size are read by many tasks, and a task holds one range and one line.

Columns: path, position (the byte at which the line begins, which names the line for good), value (without its line break; bytes that are no
UTF-8 are replaced).  Empty lines are left out.  Files are opened by their URI through the readers that all executors have, so the folder may lie in any
store that they know.

Options: ``path`` (a file or a folder), ``suffix`` (of the files' names, default none), ``rangeBytes`` (default 64 MB).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
BLOCK = 1 << 20
#: Rows of a record batch.
ROWS = 2000
SCHEMA = "path string, position long, value string"


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    #: Whether a line begins at `begin`, whatever stands before it.
    first: bool


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files at or below `uri`; names that begin with ``_`` or ``.`` are not data."""
    store, where = _opened(uri)
    head = uri[: len(uri) - len(where)] if uri.endswith(where) else ""
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        return []
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
    named = lambda f: f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))
    return sorted((head + f.path, f.size) for f in found if named(f))


def whole_lines(path: str, size: int, known: int = 0) -> int:
    """The number of bytes up to and with the last line break among the first `size`; `known` are known to end with one."""
    store, where = _opened(path)
    with store.open_input_file(where) as f:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return known


def head(path: str, limit: int) -> int:
    """A checksum of the first line (of its first `BLOCK` bytes), among the first `limit` bytes of the file."""
    store, where = _opened(path)
    with store.open_input_file(where) as f:
        return zlib.crc32(f.read(min(limit, BLOCK)).split(b"\n", 1)[0])


def ranges(path: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(path, at, min(at + size, end), at == begin) for at in range(begin, end, size)]


def lines(part: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin in a range; the last one is read beyond its end."""
    store, where = _opened(part.path)
    with store.open_input_file(where) as f:
        at = part.begin if part.first else part.begin - 1  # a line break just before the range begins a line in it
        f.seek(at)
        held, skip = b"", not part.first
        while at < part.end or held:
            block = f.read(BLOCK)
            held += block
            begin = 0
            while (stop := held.find(b"\n", begin)) >= 0:
                if not skip:
                    yield at + begin, held[begin:stop]
                skip, begin = False, stop + 1
                if at + begin >= part.end:
                    return
            held, at = held[begin:], at + begin
            if not block:
                if held and not skip:
                    yield at, held
                return


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    positions, values, size = [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(values), pa.string()), pa.array(positions, pa.int64()), pa.array(values, pa.string())], ["path", "position", "value"])

    for position, line in lines(part):
        if line := line.rstrip(b"\r"):
            positions.append(position)
            values.append(line.decode("utf-8", "replace"))
            size += len(line)
            if len(values) >= ROWS or size >= BLOCK:
                yield out()
                positions, values, size = [], [], 0
    if values:
        yield out()


class _Options:
    def __init__(self, options):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE))


class Whole(DataSourceReader):
    """Everything that is there, with a last line that no line break ends."""

    def __init__(self, options: _Options):
        self.options = options

    def partitions(self):
        return [r for path, size in files(self.options.path, self.options.suffix) for r in ranges(path, 0, size, self.options.size)] or [Range("", 0, 0, True)]

    def read(self, partition):
        return batches(partition) if partition.end else iter(())


class Growing(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options
        self.known: dict[str, list[int]] = {}

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        found = {}
        for path, size in files(self.options.path, self.options.suffix):
            before = self.known.get(path, [0, 0])
            end = whole_lines(path, size, before[0] if size >= before[0] and before[0] and head(path, before[0]) == before[1] else 0)
            if end:
                found[path] = [end, head(path, end)]
        self.known = found
        return {"files": json.dumps(found)}

    def partitions(self, start, end):
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (size, first) in after.items():
            done, same = before.get(path, [0, first])
            out += ranges(path, done if same == first and size >= done else 0, size, self.options.size)
        return out

    def read(self, partition):
        return batches(partition)

    def commit(self, end):
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls):
        return "growing_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Whole(_Options(self.options))

    def streamReader(self, schema):
        return Growing(_Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
