"""Lines of block-compressed (BGZF) text files, one file read by many tasks.

A BGZF file is a row of small gzip members, each with its own size in its header. Files are cut by bytes; a
task looks for the first member that begins in its part and reads on from there. A line belongs to the
task in whose members the line break before it lies, so a task ends its last line in the members that follow,
and a line that covers whole parts is read once. Paths are opened by pyarrow's file systems, local or
remote. A gzip file without block sizes is one task's work, as is every file's first line.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 32 << 20
_START = b"\x1f\x8b\x08\x04"
_LONGEST = 1 << 16
_BATCH = 4096


def member_size(raw: bytes, at: int = 0) -> int | None:
    """Bytes of the member that begins at `at`, from its header; None if none does."""
    if raw[at : at + 4] != _START or len(raw) < at + 18:
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    place, end = at + 12, at + 12 + extra
    while place + 4 <= min(end, len(raw)):
        size = struct.unpack_from("<H", raw, place + 2)[0]
        if raw[place : place + 2] == b"BC" and size == 2 and place + 6 <= len(raw):
            return struct.unpack_from("<H", raw, place + 4)[0] + 1
        place += 4 + size
    return None


def first_member(file: pa.NativeFile, start: int, size: int) -> int:
    """Where the first member at or after start begins; the file's size if none does.

    What looks like a header must be followed by another, or by the file's end, where its size says.
    """
    while start < size:
        file.seek(start)
        window = file.read(2 * _LONGEST + 64)
        at = window.find(_START)
        while 0 <= at < _LONGEST:
            length = member_size(window, at)
            if length:
                after = window[at + length : at + length + 18]
                if start + at + length == size or (len(after) == 18 and member_size(after)):
                    return start + at
            at = window.find(_START, at + 1)
        start += _LONGEST
    return size


def members(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Start and text of every member from the one at `start` on."""
    while start < size:
        file.seek(start)
        head = file.read(_LONGEST)
        length = member_size(head)
        if not length:
            raise ValueError(f"no block begins at byte {start}")
        yield start, zlib.decompress(head[:length], 31)
        start += length


def lines(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines whose preceding line break lies in a member that begins in start .. end; also the first if start is 0."""
    active, held = start == 0, []
    for at, text in members(file, first_member(file, start, size), size):
        if at >= end and not active:
            return
        first = 0
        while (cut := text.find(b"\n", first)) >= 0:
            if active:
                yield b"".join([*held, text[first:cut]])
            held, active, first = [], True, cut + 1
            if at >= end:
                return
        if active:
            held.append(text[first:])
    if active and any(held):
        yield b"".join(held)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    size: int


class BgzfReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(root))
        files = sorted((f for f in found if f.is_file and f.base_name[0] not in "_."), key=lambda f: f.path)
        out = []
        for f in files:
            with system.open_input_file(f.path) as file:
                step = self.split if member_size(file.read(_LONGEST)) else max(f.size, 1)
            out += [Part(f.path, a, min(a + step, f.size), f.size) for a in range(0, f.size, step)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_file(partition.path) as file:
            blocks = member_size(file.read(_LONGEST)) is not None
            held: list[bytes] = []
            for line in lines(file, partition.start, partition.end, partition.size) if blocks else _plain(file):
                held.append(line.removesuffix(b"\r"))
                if len(held) == _BATCH:
                    yield _batch(name, held)
                    held = []
            if held:
                yield _batch(name, held)


def _batch(name: str, found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string())], names=["file", "value"])


def _plain(file: pa.NativeFile) -> Iterator[bytes]:
    """Lines of any gzip file, all members after another."""
    file.seek(0)
    unpack, held = zlib.decompressobj(31), b""
    while raw := file.read(1 << 20):
        while raw:
            held += unpack.decompress(raw)
            raw = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        *whole, held = held.split(b"\n")
        yield from whole
    if held:
        yield held


def _system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class BgzfSource(DataSource):
    """format("bgzf"): file and value of every line; option split, the bytes of a part."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema: StructType) -> BgzfReader:
        return BgzfReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))


def read_bgzf(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """file and value of every line of a file or of the files in a folder."""
    spark.dataSource.register(BgzfSource)
    return spark.read.format("bgzf").option("split", split).load(path)
