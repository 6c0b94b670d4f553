"""IDX image files: many tasks read one file, many tasks write one folder.

An IDX file has a header (magic, images, height, width, as big-endian 32-bit numbers)
and then the pixels of all images, one byte each.  So where an image lies follows
from its number: a file is cut into byte ranges of whole images, each read by a task
of its own, and no task holds more than a batch of it.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from flowloom.sources.tail import open_folder

FORMAT = "idx_images"
SCHEMA = "file string, image long, features array<double>"
# The magic number of image files, and the layout of the header.
IDX_IMAGES_MAGIC = 2051
HEADER = ">iiii"
HEADER_BYTES = struct.calcsize(HEADER)
RANGE_BYTES = 32 << 20
IMAGES_AT_ONCE = 1024
# Images of one written file at most; a task holds so many.
IMAGES_PER_FILE = 16_384


class Images(InputPartition):
    """Some neighbouring images of one file."""

    def __init__(self, file: str, begin: int, end: int, pixels: int) -> None:
        self.file, self.begin, self.end, self.pixels = file, begin, end, pixels


def read_header(head: bytes, size: int) -> tuple[int, int]:
    """Number of images and pixels of each; raises on another magic number or a file that is too short."""
    if len(head) < HEADER_BYTES:
        raise ValueError(f"an IDX header has {HEADER_BYTES} bytes, got {len(head)}")
    magic, count, height, width = struct.unpack(HEADER, head)
    if magic != IDX_IMAGES_MAGIC:
        raise ValueError(f"expected magic {IDX_IMAGES_MAGIC}, got {magic}")
    if size < HEADER_BYTES + count * height * width:
        raise ValueError(f"{count} images of {height} x {width} pixels do not fit in {size} bytes")
    return count, height * width


def files_below(path: str) -> list[fs.FileInfo]:
    """The file of a path, the files of a folder, or those whose name matches the last part."""
    store, base = open_folder(path)
    found = store.get_file_info(base)
    if found.type == fs.FileType.File:
        return [found]
    pattern = "*"
    if found.type == fs.FileType.NotFound:
        base, pattern = posixpath.split(base)
    inside = store.get_file_info(fs.FileSelector(base))
    kept = [f for f in inside if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
    if not kept:
        raise FileNotFoundError(path)
    return sorted(kept, key=lambda f: f.path)


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Images]:
        found = []
        store, _ = open_folder(self.path)
        for info in files_below(self.path):
            with store.open_input_file(info.path) as file:
                count, pixels = read_header(file.read(HEADER_BYTES), info.size)
            step = max(1, self.size // max(pixels, 1))
            found += [Images(info.path, at, min(at + step, count), pixels) for at in range(0, count, step)]
        return found or [Images("", 0, 0, 1)]

    def read(self, partition: Images) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(self.path)
        if partition.begin == partition.end:
            return
        with store.open_input_file(partition.file) as file:
            for begin in range(partition.begin, partition.end, IMAGES_AT_ONCE):
                count = min(IMAGES_AT_ONCE, partition.end - begin)
                file.seek(HEADER_BYTES + begin * partition.pixels)
                raw = np.frombuffer(file.read(count * partition.pixels), dtype="uint8", count=count * partition.pixels)
                ends = np.arange(0, (count + 1) * partition.pixels, max(partition.pixels, 1), dtype="int32")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([partition.file] * count),
                        pa.array(np.arange(begin, begin + count, dtype="int64")),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(raw / 255.0)),
                    ],
                    names=["file", "image", "features"],
                )


class ImageWriter(DataSourceArrowWriter):
    """Files of at most ``IMAGES_PER_FILE`` images, named by the job and anew by every attempt of a task."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.width, self.job = options["path"], int(options["width"]), uuid.uuid4().hex
        if schema.names != ["pixels"]:
            raise ValueError("write one column: pixels, an array of numbers from 0 to 255")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = open_folder(self.path)
        store.create_dir(base, recursive=True)
        written = Written([])
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                images = np.stack(held)
                height = images.shape[1] // self.width
                name = f"{base}/{self.job}-{uuid.uuid4().hex}.idx"
                written.files.append(name)
                with store.open_output_stream(name) as file:
                    file.write(struct.pack(HEADER, IDX_IMAGES_MAGIC, len(images), height, self.width))
                    file.write(images.tobytes())
                held.clear()

        for batch in iterator:
            for row in batch.column(0).to_pylist():
                held.append(np.array(row, dtype="uint8"))
                if len(held) >= IMAGES_PER_FILE:
                    flush()
        flush()
        return written

    def abort(self, messages: list) -> None:
        store, _ = open_folder(self.path)
        for message in messages:
            for name in message.files if message else []:
                store.delete_file(name)

    def commit(self, messages: list) -> None:
        """Of the files of this job keep only those of the successful attempts."""
        store, base = open_folder(self.path)
        kept = {name for message in messages if message for name in message.files}
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.base_name.startswith(self.job) and info.path not in kept:
                store.delete_file(info.path)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class IdxImages(DataSource):
    """``file``, ``image`` (its number in the file) and ``features``, pixels as doubles in 0..1.

    Options: ``path``; ``rangeBytes`` of a partition when reading; ``width`` of an image when writing.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options), schema)
