"""Block-gzip text files: read in parts by many tasks, and written by the tasks that have the lines.

A block-gzip file is a chain of gzip members of at most 64 KB, each of which states its own size in its header. A reader that is
given a range of bytes finds the first block in it by these headers, so one file is read by as many tasks as it has ranges; the driver looks at
sizes only. Lines belong to the range in which the block stands where they begin.

    spark.dataSource.register(BlockGzip)
    spark.read.format("block_gzip").load("calls.vcf.gz")                      # value string, a row a line
    lines.write.format("block_gzip").mode("append").option("header", head).save("folder")

Files are opened with Arrow's file systems (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Compressed bytes that one task reads, text that a written block holds, and bytes that are fetched at a time.
SPLIT_BYTES, BLOCK_TEXT, FETCH = 16 << 20, 65280, 1 << 18
#: Text that goes on as one batch.
BATCH_TEXT = 1 << 22
#: Bytes in which a range's first block is looked for: a block is no larger than 64 KB, and its successor must be in sight as well.
SIGHT = 3 << 16
MAGIC = b"\x1f\x8b\x08\x04"
#: Fixed value: the empty block that ends a file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a file that are read at a time to find the end of its header.
HEAD = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def block_size(data: bytes, at: int = 0) -> int | None:
    """The size of the block whose header stands at ``at``; None if none does, or not all of it is there."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    more = struct.unpack_from("<H", data, at + 10)[0]
    field, end = at + 12, at + 12 + more
    if end > len(data):
        return None
    while field + 4 <= end:
        size = struct.unpack_from("<H", data, field + 2)[0]
        if data[field : field + 2] == b"BC" and size == 2 and field + 6 <= end:
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    return None


def block_text(data: bytes, at: int, size: int) -> bytes:
    """The text of one whole block; raises zlib.error or ValueError if it is none."""
    more = struct.unpack_from("<H", data, at + 10)[0]
    text = zlib.decompress(data[at + 12 + more : at + size - 8], -15)
    check, length = struct.unpack_from("<II", data, at + size - 8)
    if zlib.crc32(text) != check or len(text) & 0xFFFFFFFF != length:
        raise ValueError("a block's checksum does not hold")
    return text


def first_block(data: bytes, ends: bool) -> int | None:
    """Where the first whole block in ``data`` begins, whose successor is a block too or, if ``ends``, the end of the data."""
    at = data.find(MAGIC)
    while at >= 0:
        size = block_size(data, at)
        if size and at + size <= len(data):
            after = at + size
            if block_size(data, after) or (ends and after == len(data)):
                try:
                    block_text(data, at, size)
                    return at
                except (zlib.error, ValueError):
                    pass
        at = data.find(MAGIC, at + 1)
    return None


def blocks_from(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks from ``start`` on, where one begins."""
    held, base = b"", start
    while True:
        file.seek(base + len(held))
        fresh = file.read(FETCH)
        held += fresh
        at = 0
        while (size := block_size(held, at)) and at + size <= len(held):
            yield base + at, block_text(held, at, size)
            at += size
        if not fresh:
            if at < len(held):
                raise ValueError(f"the file breaks off in the block at byte {base + at}")
            return
        if not at and len(held) > 2 * SIGHT:
            raise ValueError(f"no block at byte {base}")
        held, base = held[at:], base + at


def text_of_range(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The lines that belong to the bytes from ``start`` to ``end`` of a file, as text in pieces that end with a line."""
    begin = 0
    if start:
        file.seek(start)
        seen = file.read(min(SIGHT, size - start))
        at = first_block(seen, start + len(seen) == size)
        if at is None or start + at >= end:
            return
        begin = start + at
    skipping, held = start > 0, []
    for at, text in blocks_from(file, begin):
        if skipping:  # the line that began before belongs to the range before
            if at >= end:
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skipping = text[cut + 1 :], False
        if at >= end:  # only the line that is still open, or begins right here
            cut = text.find(b"\n")
            if cut >= 0:
                yield b"".join([*held, text[: cut + 1]])
                return
        held.append(text)
        if at < end and sum(map(len, held)) > BATCH_TEXT and (cut := text.rfind(b"\n")) >= 0:
            yield b"".join([*held[:-1], text[: cut + 1]])
            held = [text[cut + 1 :]]
    if not skipping:
        yield b"".join(held)


def lines_of(text: bytes) -> pa.RecordBatch:
    """A row a line."""
    lines = text.decode("utf-8", "replace").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\r") for x in lines], pa.string())], ["value"])


@dataclass
class Range(InputPartition):
    """A range of bytes of a file of known size."""

    path: str
    size: int
    start: int
    end: int


class BlockGzipReader(DataSourceReader):
    """Ranges of the files: of ``files``, a JSON list of paths and sizes, or of the file or folder at ``path``."""

    def __init__(self, options: dict[str, str]) -> None:
        self._split = int(options.get("splitBytes", SPLIT_BYTES))
        self._files = json.loads(options["files"]) if "files" in options else self._listed(options["path"])

    @staticmethod
    def _listed(path: str) -> list[tuple[str, int]]:
        system, inner = opened(path)
        scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        return sorted((scheme + x.path, x.size) for x in found)

    def partitions(self) -> list[Range]:
        found = [Range(path, size, at, min(at + self._split, size)) for path, size in self._files for at in range(0, size, self._split)]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end:
            system, path = opened(partition.path)
            with system.open_input_file(path) as file:
                for text in text_of_range(file, partition.size, partition.start, partition.end):
                    if text:
                        yield lines_of(text)


def block(text: bytes) -> bytes:
    """One block of at most BLOCK_TEXT bytes of text."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(data) + 25) + data + struct.pack("<II", zlib.crc32(text), len(text))


def packed(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The blocks of a file whose text comes in pieces, and its end."""
    held = b""
    for piece in pieces:
        held += piece
        at = 0
        while len(held) - at >= BLOCK_TEXT:
            yield block(held[at : at + BLOCK_TEXT])
            at += BLOCK_TEXT
        held = held[at:]
    if held:
        yield block(held)
    yield END_BLOCK


@dataclass
class Written(WriterCommitMessage):
    """A finished file under the name it has until all tasks are done, and the name it gets."""

    hidden: str
    name: str


class BlockGzipWriter(DataSourceArrowWriter):
    """One file a task, each with the whole header. Files appear under their names when all tasks are done; those of failed attempts go."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self._folder, self._header = options["path"].rstrip("/"), options.get("header", "")
        self._suffix, self._overwrite = options.get("suffix", ".vcf.gz"), overwrite
        self._run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self._folder)
        system.create_dir(folder, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self._run}{self._suffix}"
        hidden = f"_{name}.{context.taskAttemptId()}"

        def pieces() -> Iterator[bytes]:
            if self._header:
                yield (self._header.rstrip("\n") + "\n").encode()
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                yield "".join([f"{x}\n" for x in lines if x is not None]).encode()

        with system.open_output_stream(f"{folder}/{hidden}", compression=None) as out:
            for data in packed(pieces()):
                out.write(data)
        return Written(hidden, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self._folder)
        if self._overwrite:
            done = {m.hidden for m in messages if m}
            for x in system.get_file_info(fs.FileSelector(folder)):
                if x.type == fs.FileType.File and x.base_name not in done:
                    system.delete_file(x.path)
        for m in filter(None, messages):
            system.move(f"{folder}/{m.hidden}", f"{folder}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self._folder)
        for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith("_part-") and self._run in x.base_name:
                system.delete_file(x.path)


class BlockGzip(DataSource):
    """The format ``block_gzip``: lines of block-gzip files, as ``value``."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BlockGzipReader:
        return BlockGzipReader(self.options)

    def writer(self, schema, overwrite: bool) -> BlockGzipWriter:
        return BlockGzipWriter(self.options, overwrite)


def read_blocks(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value) a row a line of the block-gzip files, given as paths and sizes."""
    spark.dataSource.register(BlockGzip)
    return spark.read.format("block_gzip").option("files", json.dumps(files)).option("splitBytes", split_bytes).load()


def write_blocks(lines: DataFrame, header: str, path: str, column: str = "value") -> None:
    """Write text lines as a folder of block-gzip files, each a whole file under the header. Null lines are left out."""
    lines.sparkSession.dataSource.register(BlockGzip)
    lines.select(F.col(column).alias("value")).write.format("block_gzip").mode("append").option("header", header).save(path)


def head_of(path: str, mark: bytes = b"#") -> tuple[bool, bytes]:
    """Whether a file is block-gzip, and its first lines that begin with ``mark``; whether plain or gzip, no more is read than these need."""
    system, inner = opened(path)
    with system.open_input_file(inner) as file:
        raw = file.read(HEAD)
        packed_, blocked = raw[:2] == MAGIC[:2], bool(block_size(raw))
        unpack, text, at = zlib.decompressobj(31), b"", 0
        while raw:
            if not packed_:
                text += raw
            else:
                while raw:
                    text += unpack.decompress(raw)
                    raw = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
            while (cut := text.find(b"\n", at)) >= 0:
                if not text.startswith(mark, at):
                    return blocked, text[:at]
                at = cut + 1
            if at < len(text) and not text.startswith(mark, at):
                break
            raw = file.read(HEAD)
        return blocked, text if text.startswith(mark, at) else text[:at]
