"""Series files that collectors are still writing, as a stream.

Spark's own file source reads a file once, when it appears.  Collectors append to their
files for as long as they run, so this source remembers how far each file has been read:
its offsets are sizes by file name.  A batch is cut into byte ranges, each a partition;
a line belongs to the range that holds its line break, so any cut gives the same lines
and a line that is still being written waits for its end.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "growing_lines"
SCHEMA = "file string, head string, place long, value string"
# Bytes of one partition, and of one read.
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LINES_AT_ONCE = 10_000


class Range(InputPartition):
    """The bytes of one file that a task reads."""

    def __init__(self, file: str, begin: int, end: int) -> None:
        self.file, self.begin, self.end = file, begin, end


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def ranges(start: dict[str, int], end: dict[str, int], size: int = RANGE_BYTES) -> list[Range]:
    """What came to the files between two offsets, in pieces of at most ``size`` bytes."""
    found = []
    for file, upto in sorted(end.items()):
        begun = start.get(file, 0)
        if upto < begun:
            raise ValueError(f"{file} shrank from {begun} to {upto} bytes; series files only grow")
        found += [Range(file, at, min(at + size, upto)) for at in range(begun, upto, size)]
    return found


def line_begin(file: pa.NativeFile, place: int) -> int:
    """Where the line that holds byte ``place`` begins."""
    while place > 0:
        begin = max(0, place - READ_BYTES)
        file.seek(begin)
        before = file.read(place - begin).rfind(b"\n")
        if before >= 0:
            return begin + before + 1
        place = begin
    return 0


def lines_ending_in(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines whose break lies in [begin, end), each with the place it begins at."""
    place = line_begin(file, begin)
    file.seek(place)
    rest = b""
    at = place
    while at < end:
        block = file.read(min(READ_BYTES, end - at))
        if not block:
            return
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield place, line
            place += len(line) + 1


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["path"]
        self.pattern = options.get("pattern", "*")
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, base = open_folder(self.base)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {
            posixpath.relpath(f.path, base): f.size
            for f in found
            if f.type == fs.FileType.File and f.size and fnmatch.fnmatch(f.base_name, self.pattern)
        }

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(self.base)
        with store.open_input_file(f"{base}/{partition.file}") as file:
            # the first line tells what the columns are, however far the file has been read
            _, head = next(lines_ending_in(file, 0, file.size()), (0, b""))
            rows: list[tuple[int, bytes]] = []
            for row in lines_ending_in(file, partition.begin, partition.end):
                rows.append(row)
                if len(rows) >= LINES_AT_ONCE:
                    yield self._batch(partition.file, head, rows)
                    rows = []
            if rows:
                yield self._batch(partition.file, head, rows)

    @staticmethod
    def _batch(file: str, head: bytes, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        text = lambda raw: raw.removesuffix(b"\r").decode("utf-8", "replace")
        n = len(rows)
        name = posixpath.basename(file)
        return pa.RecordBatch.from_pydict(
            {"file": [name] * n, "head": [text(head)] * n, "place": [p for p, _ in rows], "value": [text(v) for _, v in rows]}
        )


class GrowingLines(DataSource):
    """``file`` (its name), ``head`` (its first line), ``place`` (where the line begins, in bytes) and ``value``.

    Options: ``path``, ``pattern`` of file names, ``rangeBytes`` of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))
