"""Blocked gzip files (BGZF) as lines, read in ranges: a compressed file that splits.

A BGZF file is a chain of gzip members of at most 64 KB, each of which tells its own length in its header. A range of the file's bytes is
one partition: its task finds the first member that begins in it, by a member's signature, its chain to the next one and its
checksum, inflates the members that begin in the range, and gives the lines that begin behind their newlines; the last of these it
reads to its end, in the next range's members if need be. So every line is read once, by whatever ranges.

It is a data source of Spark's Python API: `spark.read.format("bgzf")`, after `register(spark)`. Files are opened through Arrow's file
systems (local, S3, GCS, HDFS by URI), by the tasks; the driver asks only for their sizes. Writing gives one file for each task, under
a temporary name until all have ended.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "value string, file string, block long"
#: Bytes of a range, and text of a member.
RANGE, MEMBER = 64 << 20, 0xFF00
#: How a member begins, and the empty member that ends a file.
SIGNATURE = b"\x1f\x8b\x08\x04"
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Text of a batch of lines.
BATCH = 1 << 20


def opened(file: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if ":" not in file.split("/", 1)[0]:
        return fs.LocalFileSystem(), os.path.abspath(file)
    return fs.FileSystem.from_uri(re.sub("^([^:/]+:)/(?!/)", r"\1///", file))


def member_size(header: bytes) -> int | None:
    """The length of the member that begins with these bytes, as its extra field BC tells it; None if it isn't one."""
    if len(header) < 18 or header[:4] != SIGNATURE:
        return None
    extra, at = header[12 : 12 + struct.unpack_from("<H", header, 10)[0]], 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + size
    return None


def inflated(member: bytes) -> bytes:
    """A member's text. ValueError if it is broken or its checksum is another."""
    try:
        begin = 12 + struct.unpack_from("<H", member, 10)[0]
        text = zlib.decompress(member[begin:-8], -15)
    except (zlib.error, struct.error) as e:
        raise ValueError(f"broken member: {e}") from None
    if struct.unpack("<II", member[-8:]) != (zlib.crc32(text), len(text)):
        raise ValueError("a member doesn't have its checksum")
    return text


def member(text: bytes) -> bytes:
    """The member that holds a text of at most MEMBER bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(text) + pack.flush()
    return SIGNATURE + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


class _Members:
    """The members of a file."""

    def __init__(self, file: str):
        system, path = opened(file)
        self.file, self.raw = file, system.open_input_file(path)
        self.size = self.raw.size()

    def read(self, at: int) -> tuple[int, bytes]:
        """Where the member at that place ends, and its text."""
        size = member_size(self.raw.read_at(min(1024, self.size - at), at))
        if size is None or at + size > self.size:
            raise ValueError(f"{self.file}: no member at byte {at}")
        return at + size, inflated(self.raw.read_at(size, at))

    def first(self, start: int, end: int) -> int | None:
        """The first member that begins in a range."""
        if start == 0:
            return 0
        # A member is 64 KB at most, so one begins in the range's first 64 KB, or none that isn't behind the file's end.
        held = self.raw.read_at(min((1 << 16) + 4, self.size - start), start)
        at = held.find(SIGNATURE)
        while at >= 0 and start + at < end:
            try:
                after, _ = self.read(start + at)
                if after == self.size or self.raw.read_at(4, after) == SIGNATURE:
                    return start + at
            except ValueError:  # these bytes stand inside a member
                pass
            at = held.find(SIGNATURE, at + 1)
        return None


def range_lines(file: str, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines that belong to a range of a file, some at a time, without their ends."""
    members = _Members(file)
    at = members.first(start, end)
    if at is None or at >= end:
        return
    skip, parts, size = at > 0, [], 0
    while at < members.size:
        inside = at < end
        at, text = members.read(at)
        if skip:
            cut = text.find(b"\n")
            if not inside:
                return  # no line begins in this range
            if cut < 0:
                continue
            text, skip = text[cut + 1 :], False
        if not inside:
            cut = text.find(b"\n")
            parts.append(text if cut < 0 else text[:cut])
            if cut >= 0:
                yield b"".join(parts).split(b"\n")
                return
            continue
        parts.append(text)
        size += len(text)
        if size >= BATCH and b"\n" in text:
            whole = b"".join(parts)
            cut = whole.rfind(b"\n")
            yield whole[:cut].split(b"\n")
            parts, size = [whole[cut + 1 :]], 0
    rest = b"".join(parts)
    if rest:
        yield (rest[:-1] if rest.endswith(b"\n") else rest).split(b"\n")


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.range = json.loads(options["files"]), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in self.files:
            system, path = opened(file)
            size = system.get_file_info(path).size or 0
            out += [_Range(file, a, min(size, a + self.range)) for a in range(0, size, self.range)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        for lines in range_lines(partition.file, partition.start, partition.end):
            values = [x.decode("utf-8", "replace") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([partition.file] * len(values), pa.string()), pa.array([partition.start] * len(values), pa.int64())], names=["value", "file", "block"])


class _Written(WriterCommitMessage):
    def __init__(self, part: int, name: str):
        self.part, self.name = part, name


class _Writer(DataSourceWriter):
    """Lines as BGZF, a file for each task."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> _Written:
        system, folder = opened(self.path)
        system.create_dir(folder)
        part = TaskContext.get().partitionId()
        name = f"_part-{part:05d}-{uuid.uuid4().hex}"
        held = bytearray()
        with system.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                held += (row[0] or "").encode() + b"\n"
                while len(held) >= MEMBER:
                    out.write(member(bytes(held[:MEMBER])))
                    del held[:MEMBER]
            if held:
                out.write(member(bytes(held)))
            out.write(LAST)
        return _Written(part, name)

    def commit(self, messages: list) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/{m.name}", f"{folder}/part-{m.part:05d}.bgz")

    def abort(self, messages: list) -> None:
        system, folder = opened(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/{m.name}")


class BgzfSource(DataSource):
    """Options: files, a JSON list of them, and rangeBytes for reading; a path for writing."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BgzfSource)


def read_lines(spark: SparkSession, files: list[str], range_bytes: int = RANGE) -> DataFrame:
    """(value, file, block): the lines of BGZF files, and the range that each stands in. Lines of a range are in order, in one partition."""
    register(spark)
    return spark.read.format("bgzf").option("files", json.dumps(files)).option("rangeBytes", range_bytes).load()


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines, a column of strings, as BGZF files in a folder."""
    register(lines.sparkSession)
    lines.toDF("value").write.format("bgzf").mode("append").option("path", path).save()
