"""A data source for compressed text whose partitions are Zstandard frames or gzip blocks.

Headers alone say where a frame ends: the blocks of a Zstandard frame carry
their sizes, and blocked gzip (BGZF) its members'.  Runs of frames of some
megabytes are partitions; a task unpacks its own as a stream and reads on into
the next ones until its last document ends.  A document belongs to the
partition in which the separator before it begins.  Other gzip files have no
such sizes and are one partition each, read as a stream too.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "sparktok_frames"
#: Packed bytes of a partition, bytes read at once, and bytes of texts of one batch.
PARTITION_BYTES, READ, BATCH_BYTES = 16 << 20, 1 << 20, 4 << 20
ZSTD_MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A50
SCHEMA = "text string, _file string, _start long"


def split_path(path: str) -> tuple[fs.FileSystem, str]:
    """Where a URI, or a local path, points to: its store and its name there."""
    if path.startswith("file:"):
        path = unquote(re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def open_file(path: str) -> pa.NativeFile:
    """A file by its URI, or a local one by its path."""
    there, name = split_path(path)
    return there.open_input_file(name)


def zstd_frames(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(begin, end) of each frame, read from headers alone."""
    at, size = 0, file.size()

    def take(count: int) -> bytes:
        nonlocal at
        file.seek(at)
        got = file.read(count)
        if len(got) < count:
            raise ValueError("a Zstandard frame is cut off")
        at += count
        return got

    while at < size:
        begin = at
        (magic,) = struct.unpack("<I", take(4))
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            skipped = struct.unpack("<I", take(4))[0]
            at += skipped
        elif magic == ZSTD_MAGIC:
            flags = take(1)[0]
            single, checksum = flags >> 5 & 1, flags >> 2 & 1
            at += (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
            while True:
                head = int.from_bytes(take(3), "little")
                at += 1 if head >> 1 & 3 == 1 else head >> 3
                if head & 1:
                    break
            at += 4 * checksum
        else:
            raise ValueError("not a Zstandard file")
        if at > size:
            raise ValueError("a Zstandard frame is cut off")
        yield begin, at


def gzip_blocks(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """(begin, end) of each member of a blocked gzip file; of any other, all of it at once."""
    at, size, found = 0, file.size(), []
    while at < size:
        file.seek(at)
        head = file.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
            yield 0, size
            return
        end = at + struct.unpack("<H", head[16:18])[0] + 1
        found.append((at, end))
        at = end
    yield from found


def _overlaps_itself(separator: bytes) -> bool:
    return any(separator.startswith(separator[k:]) for k in range(1, len(separator)))


@dataclass
class Run(InputPartition):
    """Frames of a file from ``begin`` to before ``end``, in packed bytes."""

    path: str
    begin: int
    end: int


def runs(path: str, splittable: bool, size: int = PARTITION_BYTES) -> list[Run]:
    with open_file(path) as file:
        if not splittable:
            return [Run(path, 0, file.size())]
        frames, out, begin = (gzip_blocks if path.endswith(".gz") else zstd_frames)(file), [], 0
        for _, end in frames:
            if end - begin >= size:
                out.append(Run(path, begin, end))
                begin = end
        if begin < file.size() or not out:
            out.append(Run(path, begin, file.size()))
        return out


def _unpacked(file: pa.NativeFile, path: str, begin: int, end: int) -> Iterator[bytes]:
    """What the frames between two places hold, a little at a time."""
    is_gzip = path.endswith(".gz")
    make = (lambda: zlib.decompressobj(16 + zlib.MAX_WBITS)) if is_gzip else (lambda: zstandard.ZstdDecompressor().decompressobj())
    stream, data, begun = make(), b"", False
    while True:
        if not data:
            file.seek(begin)
            data = file.read(min(READ, end - begin))
            begin += len(data)
            if not data:
                if is_gzip and begun and not stream.eof:
                    raise ValueError(f"{path} is cut off")
                break
            begun = True
        if is_gzip and stream.eof:
            stream, data = make(), data.lstrip(b"\0")
            continue
        if out := stream.decompress(data):
            yield out
        done = stream.eof
        data = stream.unused_data if done else b""
        if done and not is_gzip:
            stream = make()


def documents(run: Run, separator: bytes) -> Iterator[bytes]:
    """A run's documents; without a separator all that it holds, even if it is nothing."""
    with open_file(run.path) as file:
        if not separator:
            yield b"".join(_unpacked(file, run.path, run.begin, run.end))
            return
        held, offset, own = bytearray(), 0, None  # held begins at place ``offset`` of what the run holds; ``own``: its length, once known
        inside, seek = run.begin == 0, 0
        parts, more = _unpacked(file, run.path, run.begin, run.end), False
        while True:
            at = held.find(separator, seek)
            if at >= 0:
                if own is not None and offset + at >= own and not inside:
                    return
                if inside and at:
                    yield bytes(held[:at])
                if own is not None and offset + at >= own:
                    return
                inside = True
                del held[: at + len(separator)]
                offset, seek = offset + at + len(separator), 0
                continue
            seek = max(0, len(held) - len(separator) + 1)
            if not inside:
                del held[:seek]
                offset, seek = offset + seek, 0
                if own is not None and offset >= own:
                    return
            chunk = next(parts, None)
            if chunk is None and not more:
                own, more = offset + len(held), True
                parts = _unpacked(file, run.path, run.end, file.size())
                continue
            if chunk is None:
                if inside and held:
                    yield bytes(held)
                return
            held += chunk


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.separator = json.loads(options["paths"]), options.get("separator", "").encode()
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Run]:
        splittable = bool(self.separator) and not _overlaps_itself(self.separator)
        return [r for path in self.paths for r in runs(path, splittable, self.size)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        def batch(found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([partition.path] * len(found)), pa.array([partition.begin] * len(found), pa.int64())], names=["text", "_file", "_start"])

        held, size = [], 0
        for doc in documents(partition, self.separator):
            held.append(doc.decode())
            size += len(doc)
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class FrameSource(DataSource):
    """Options: ``paths`` (a JSON list of files), ``separator``, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)
