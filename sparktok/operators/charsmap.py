"""SentencePiece's precompiled character map: a double-array trie from strings to their replacements."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..shipping import ship
from .slices import slices

_CLUSTER = regex.compile(r"\X")


#: Unit of no node: no byte of UTF-8 is its label.
_NONE = 0xFF
#: Bytes of texts whose places walk the trie at once.
WALKED = 1 << 18


def build(entries: dict[str, str]) -> bytes:
    """A map of some strings to others, as bytes that ``Charsmap`` and other readers of the format take."""
    text, trie = bytearray(), {}
    for key, new in sorted(entries.items()):
        if not key or "\0" in key + new:
            raise ValueError("keys are not empty, and neither side holds a zero character")
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = len(text)
        text += new.encode() + b"\0"
    units, bases, taken, queue = [_NONE] * 256, set(), {0}, [(0, trie)]
    for place, children in queue:
        base = 1
        while base in bases or any(base ^ label in taken for label in children):
            base += 1
        bases.add(base)
        offset = place ^ base
        if offset >= 1 << 21:
            raise ValueError("too many entries for offsets of 21 bits")
        units += [_NONE] * ((base | 0xFF) + 1 - len(units))
        units[place] = (units[place] if place else 0) | offset << 10 | (0 in children) << 8
        for label, child in children.items():
            taken.add(base ^ label)
            units[base ^ label] = label or child | 1 << 31
            if label:
                queue.append((base ^ label, child))
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + bytes(text)


class Charsmap:
    """``blob``: little-endian size of the trie in bytes, the trie's units, then zero-ended replacements.

    A grapheme cluster of up to five bytes is replaced as a whole if the trie
    has it; otherwise each of its characters is.
    """

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        if size % 4 or 4 + size > len(blob):
            raise ValueError("character map is cut off")
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.text = blob[4 + size :]
        self.array = np.array(self.units, dtype=np.int64)

    def hits(self, data: np.ndarray) -> np.ndarray:
        """For each byte that begins a character: whether a key of the map begins there. All places walk the trie at once."""
        found = np.zeros(len(data), dtype=bool)
        if not len(self.array):
            return found
        start = np.nonzero(data & 0xC0 != 0x80)[0]
        node, at = np.full(len(start), self._offset(self.units[0]), dtype=np.int64), start
        while len(start):
            node = node ^ data[at]
            inside = node < len(self.array)
            start, at, node = start[inside], at[inside], node[inside]
            unit = self.array[node]
            same = unit & 0x800000FF == data[at]
            start, at, node, unit = start[same], at[same], node[same], unit[same]
            found[start[unit >> 8 & 1 == 1]] = True
            node = node ^ (unit >> 10 << ((unit & 1 << 9) >> 6))
            on = (unit >> 8 & 1 == 0) & (at + 1 < len(data))
            start, at, node = start[on], at[on] + 1, node[on]
        return found

    def many(self, texts: pa.Array) -> pa.Array:
        """A batch of texts, mapped; those in which no key begins anywhere are passed on as they are."""
        if not len(texts):
            return texts.cast(pa.string())
        wide = texts.cast(pa.large_string())
        ends = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + 1, offset=8 * wide.offset)
        data = np.frombuffer(wide.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        # A key may seem to begin at a text's end and go on in the next one: such a text is looked at for nothing.
        seen = np.concatenate([[0], np.cumsum(self.hits(data))])
        changed = seen[ends[1:] - ends[0]] > seen[ends[:-1] - ends[0]]
        if not changed.any():
            return texts.cast(pa.string())
        return pa.array([self(t) if c and t is not None else t for c, t in zip(changed.tolist(), texts.to_pylist(), strict=True)], pa.string())

    def _find(self, key: bytes) -> str | None:
        """Replacement of the shortest prefix of key in the trie."""
        node = self._offset(self.units[0]) if self.units else 0
        for byte in key:
            node ^= byte
            if node >= len(self.units):
                return None
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                return None
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                at = self.units[node] & 0x7FFFFFFF
                return self.text[at : self.text.index(b"\0", at)].decode()
        return None

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def __call__(self, text: str) -> str:
        out = []
        for m in _CLUSTER.finditer(text):
            cluster = m[0]
            data = cluster.encode()
            whole = self._find(data) if len(data) < 6 else None
            if whole is not None:
                out.append(whole)
                continue
            for c in cluster:
                new = self._find(c.encode())
                out.append(c if new is None else new)
        return "".join(out)


def precompiled(df: DataFrame, blob: bytes, text: str = "text", out: str = "text") -> DataFrame:
    """``df`` with its texts mapped; null stays null."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(blob)
    names = [c for c in df.columns if c != out]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out), f"`{out}` string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        charsmap = Charsmap(shared.value)
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(text), WALKED):
                columns = [batch.column(batch.schema.get_field_index(c)) for c in (*names, text)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], charsmap.many(columns[-1])], names=[*names, out])

    return df.mapInArrow(work, kinds)
