"""Count-min sketches of hashed items, made per chunk and merged by block.

A sketch has ``depth`` rows of ``width`` cells whose counters stop at 2: all
that is asked of it is "once or more often".  A chunk's sketch is sparse, so a
row of it travels as the sorted cells that are set, cut into blocks, each
block coded by Elias and Fano's method in about 2 + log2(cells / items) bits
an item.  Each block of each row is merged by itself: a cell set by two
chunks, or twice by one, is a repeated cell.  Every chunk gets back those of
its own cells that are repeated.  An item whose cells are repeated in all rows
is estimated repeated; collisions can only add to a count, so no repeated item
is missed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELLS_AN_ITEM = 8
MAX_BLOCKS = 1 << 16
BLOCK_CELLS = 1 << 22


def ef_encode(values: np.ndarray, universe: int) -> bytes:
    """Sorted distinct integers below ``universe``."""
    n = len(values)
    if not n:
        return b""
    low = max(0, (universe // n).bit_length() - 1)
    v = values.astype(np.uint64)
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, dtype=bool)
    marks[high] = True
    lows = b""
    if low:
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)[None, :]) & np.uint64(1)
        lows = np.packbits(bits.astype(bool).ravel()).tobytes()
    return struct.pack("<IB", n, low) + lows + np.packbits(marks).tobytes()


def ef_decode(code: bytes | None) -> np.ndarray:
    if not code:
        return np.zeros(0, dtype=np.int64)
    n, low = struct.unpack_from("<IB", code)
    size = (n * low + 7) // 8
    raw = np.frombuffer(code, dtype=np.uint8)
    marks = np.nonzero(np.unpackbits(raw[5 + size :]))[0][:n]
    out = (marks - np.arange(n)) << low
    if low:
        bits = np.unpackbits(raw[5 : 5 + size])[: n * low].reshape(n, low)
        out += bits.astype(np.int64) @ (1 << np.arange(low, dtype=np.int64))
    return out


@dataclass(frozen=True)
class Shape:
    """Rows, cells a row and blocks a row of a sketch."""

    depth: int
    width: int
    blocks: int

    @staticmethod
    def for_items(n: int, depth: int = 2) -> Shape:
        """Eight cells an item, in blocks of about four million cells."""
        width = CELLS_AN_ITEM * n + 1024
        return Shape(depth, width, min(MAX_BLOCKS, max(4, width // BLOCK_CELLS)))

    @property
    def block_size(self) -> int:
        return -(-self.width // self.blocks)

    def cells(self, h: np.ndarray, row: int) -> np.ndarray:
        """The cell of each 64-bit hash in a row."""
        h = h * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)[row])
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return (h % np.uint64(self.width)).astype(np.int64)


MESSAGE = "depth int, block int, chunk long, once binary, more binary"
REPLY = "depth int, block int, chunk long, cells binary"


def cut_blocks(cells: np.ndarray, shape: Shape) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted cells by block, as places in the block."""
    size = shape.block_size
    blocks = cells // size
    edges = np.nonzero(np.diff(blocks))[0] + 1
    for part in np.split(cells, edges) if len(cells) else ():
        yield int(part[0] // size), part % size


def messages(chunk: int, h: np.ndarray, shape: Shape) -> Iterator[tuple]:
    """A chunk's sketch in pieces: cells that it sets once, and more often."""
    for row in range(shape.depth):
        cells = np.sort(shape.cells(h, row))
        if not len(cells):
            continue
        fresh = np.ones(len(cells), dtype=bool)
        fresh[1:] = cells[1:] != cells[:-1]
        at = np.nonzero(fresh)[0]
        several = np.diff(np.append(at, len(cells))) > 1
        pieces: dict[int, list[bytes]] = {}
        for k, part in enumerate((cells[at[~several]], cells[at[several]])):
            for block, inside in cut_blocks(part, shape):
                pieces.setdefault(block, [b"", b""])[k] = ef_encode(inside, shape.block_size)
        for block, (once, more) in pieces.items():
            yield row, block, chunk, once, more


def merged(sent: DataFrame, shape: Shape) -> DataFrame:
    """Merge messages by block; for each chunk its own cells that are repeated.

    A task holds a block's two tables, a byte for each cell, and its messages
    as they are coded; they are read, and answered, a batch at a time.
    """
    size = shape.block_size

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        held = []
        for batch in batches:
            held.append(batch)
            for once, more in zip(batch.column("once"), batch.column("more"), strict=True):
                got, several = ef_decode(once.as_py()), ef_decode(more.as_py())
                twice[got[seen[got]]] = True
                seen[got] = True
                twice[several] = seen[several] = True
        for batch in held:
            out = []
            for once, more in zip(batch.column("once"), batch.column("more"), strict=True):
                got = np.sort(np.concatenate([ef_decode(once.as_py()), ef_decode(more.as_py())]))
                out.append(ef_encode(got[twice[got]], size))
            names = ["depth", "block", "chunk"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(out, pa.binary())], names=[*names, "cells"]).filter(pa.array([bool(x) for x in out]))

    return sent.groupBy("depth", "block").applyInArrow(merge, REPLY)


class Repeated:
    """What a chunk was told: which hashes are estimated to occur more than once."""

    def __init__(self, reply: pa.Table, shape: Shape):
        self.shape = shape
        parts: list[list[np.ndarray]] = [[] for _ in range(shape.depth)]
        for depth, block, code in zip(reply.column("depth").to_pylist(), reply.column("block").to_pylist(), reply.column("cells").to_pylist(), strict=True):
            parts[depth].append(ef_decode(code) + block * shape.block_size)
        self.cells = [np.sort(np.concatenate(p)) if p else np.zeros(0, dtype=np.int64) for p in parts]
        #: A bit table of the cells' low bits turns most single items away before the search.
        self.low = max(16, 3 + max(len(c) for c in self.cells).bit_length())
        self.marks = np.zeros(1 << self.low, dtype=bool)
        self.marks[self.cells[0] & ((1 << self.low) - 1)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Places in h of the estimated repeated ones."""
        at = np.nonzero(self.marks[self.shape.cells(h, 0) & ((1 << self.low) - 1)])[0]
        for row, cells in enumerate(self.cells):
            if not len(cells) or not len(at):
                return np.zeros(0, dtype=np.int64)
            mine = self.shape.cells(h[at], row)
            found = np.searchsorted(cells, mine)
            found[found == len(cells)] = 0
            at = at[cells[found] == mine]
        return at


def send(chunks: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], shape: Shape, chunk_bytes: int) -> DataFrame:
    """Messages of all chunks; ``hashes`` gives the items of some rows of one chunk.

    Rows of a chunk lie together; a chunk that two tasks read sends twice, which merges the same.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(messages(now, np.concatenate(held), shape))
            for k in range(0, len(rows), 2048):
                cols = list(zip(*rows[k : k + 2048], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["depth", "block", "chunk", "once", "more"])

        for batch in batches:
            ids = batch.column("chunk").to_numpy()
            edges = [0, *(np.nonzero(np.diff(ids))[0] + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is not None and (ids[a] != now or size > chunk_bytes):
                    yield from out()
                    held, size = [], 0
                now = int(ids[a])
                h = hashes(batch.slice(a, b - a))
                held.append(h)
                size += 8 * len(h)
        if held:
            yield from out()

    return chunks.mapInArrow(work, MESSAGE)
