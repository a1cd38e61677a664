"""Many literals at once: an Aho-Corasick automaton in numpy arrays, run over whole batches of texts.

Time does not depend on the number of literals.  A batch's bytes lie end to
end, parted by a byte that no UTF-8 text has, and are cut into strips that are
read side by side, one byte of each at a step; a strip begins as many bytes
early as the longest literal has, after which its state is the right one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .slices import slices

#: Between texts: no byte of UTF-8.
BREAK = 0xFF
#: The largest table that is built and broadcast; bytes of a strip; bytes of texts that are read at once.
MOST_BYTES, STRIP, GROUP = 1 << 30, 512, 1 << 20


@dataclass(frozen=True)
class Automaton:
    """By state and class of the next byte the next state; which literal ends in a state; the next shorter state in which one ends."""

    classes: np.ndarray
    table: np.ndarray
    literal: np.ndarray
    shorter: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(literals: list[str]) -> Automaton:
        """ValueError for an empty literal, one given twice, and tables above MOST_BYTES."""
        words = [w.encode() for w in literals]
        if not all(words) or len(set(words)) < len(words):
            raise ValueError("literals are not empty, and each is given once")
        used = sorted({b for w in words for b in w})
        classes = np.zeros(256, dtype=np.int16)
        classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        parents, last, depth, ends = [0], [0], [0], [-1]
        for k, word in enumerate(words):
            at = 0
            for b in word:
                c = int(classes[b])
                then = children[at].get(c)
                if then is None:
                    then = children[at][c] = len(children)
                    children.append({}), parents.append(at), last.append(c), depth.append(depth[at] + 1), ends.append(-1)
                at = then
            ends[at] = k
        size = len(children) * (len(used) + 1) * 4
        if size > MOST_BYTES:
            raise ValueError(f"a table of {size} bytes for these literals is more than {MOST_BYTES}")
        table = np.zeros((len(children), len(used) + 1), dtype=np.int32)
        parents, last, depth, literal = (np.array(x, dtype=np.int32) for x in (parents, last, depth, ends))
        fail, shorter = np.zeros(len(children), dtype=np.int32), np.zeros(len(children), dtype=np.int32)
        own = np.arange(1, len(children))
        table[parents[own], last[own]] = own
        for d in range(1, int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d)
            fail[level] = table[fail[parents[level]], last[level]] if d > 1 else 0
            shorter[level] = np.where(literal[fail[level]] >= 0, fail[level], shorter[fail[level]])
            table[level] = np.where(table[level] > 0, table[level], table[fail[level]])
        return Automaton(classes, table, literal, shorter, np.array([len(w) for w in words], dtype=np.int64))

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places after which literals end in bytes, ascending, and the literals: at one place the longest first."""
        early = int(self.lengths.max(initial=1)) - 1
        strips = -(-len(data) // STRIP)
        padded = np.full(early + strips * STRIP, BREAK, dtype=np.uint8)
        padded[early : early + len(data)] = data
        codes = self.classes[padded]
        begins = np.arange(strips) * STRIP
        width = self.table.shape[1]
        flat = self.table.ravel()
        state = np.zeros(strips, dtype=np.int64)
        ending = (self.literal >= 0) | (self.shorter > 0)
        places, states = [], []
        for k in range(early + STRIP):
            state = flat[state * width + codes[begins + k]].astype(np.int64)
            if k >= early and (hit := ending[state]).any():
                places.append(begins[hit] + (k - early) + 1)
                states.append(state[hit])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, state = np.concatenate(places), np.concatenate(states)
        found = []
        while len(place):
            there = self.literal[state] >= 0
            found.append((place[there], self.literal[state[there]].astype(np.int64)))
            state = self.shorter[state].astype(np.int64)
            place, state = place[state > 0], state[state > 0]
        place, literal = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-self.lengths[literal], place))
        return place[order], literal[order]

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and literal of the matches that don't overlap: always the leftmost, and of those the longest."""
        end, literal = self.ends(data)
        begin = end - self.lengths[literal]
        order = np.lexsort((-end, begin))
        begin, end, literal = begin[order], end[order], literal[order]
        if len(begin):
            first = np.concatenate([[True], begin[1:] != begin[:-1]])
            begin, end, literal = begin[first], end[first], literal[first]
        # By each match the first one that begins at its end or behind it.
        then = np.searchsorted(begin, end).tolist()
        kept, k = [], 0
        while k < len(then):
            kept.append(k)
            k = then[k]
        return begin[kept], literal[kept]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with a BREAK after each, and where each begins; null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(offsets)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    begins = np.arange(len(sizes)) + (offsets[:-1] - offsets[0])
    data = np.full(len(raw) + len(sizes), BREAK, dtype=np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(len(sizes)), sizes)] = raw
    return data, begins


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts of at most GROUP bytes together; one longer text is a group of its own."""
    return (part.column(0) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, GROUP))


def sent(spark: SparkSession, literals: list[str]) -> Broadcast:
    """The automaton of literals, built once and sent to the executors; at most MOST_BYTES."""
    ship(spark)
    return spark.sparkContext.broadcast(Automaton.of(literals))


def literal_counts(df: DataFrame, literals: list[str], text: str = "text") -> DataFrame:
    """(pattern int, docs long): how many texts hold each literal that any holds; overlapping ones all count, null holds none."""
    shared = sent(df.sparkSession, literals)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.lengths), dtype=np.int64)
        for batch in batches:
            for group in _groups(batch.column(0)):
                data, begins = joined(group)
                end, literal = shared.value.ends(data)
                doc = np.searchsorted(begins, end - 1, side="right")
                pairs = np.unique(doc * len(counts) + literal)
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], names=["pattern", "docs"])

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "pattern int, docs long")
    return found.groupBy("pattern").agg(F.sum("docs").alias("docs"))


def literal_spans(df: DataFrame, literals: list[str], text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with an array of (start, end, pattern) of each text's matches, in bytes: leftmost, longest, not overlapping; null text: null."""
    shared = sent(df.sparkSession, literals)
    at = df.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for group in _groups(batch.column(at)):
                data, begins = joined(group)
                begin, literal = shared.value.spans(data)
                doc = np.searchsorted(begins, begin, side="right") - 1
                start = begin - begins[doc]
                fields = [pa.array(x.astype(np.int32)) for x in (start, start + shared.value.lengths[literal], literal)]
                offsets = pa.array(np.searchsorted(doc, np.arange(len(group) + 1)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind, mask=group.is_null()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(columns) if columns else pa.array([], kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(work, df.select("*", F.lit(None).cast("array<struct<start:int,end:int,pattern:int>>").alias(out)).schema)


def parted(texts: pa.Array, automaton: Automaton) -> pa.Array:
    """Each text's parts between and at literals, without empty ones: cut wherever a text or a match begins or ends."""
    data, begins = joined(texts)
    begin, literal = automaton.spans(data)
    # Before a place stands one BREAK for each text before it.
    at = begin - (np.searchsorted(begins, begin, side="right") - 1)
    stops = np.append(begins, len(data)) - np.arange(len(texts) + 1)
    edges = np.sort(np.concatenate([stops, at, at + automaton.lengths[literal]]), kind="stable")
    edges = edges[np.concatenate([[True], edges[1:] > edges[:-1]])]
    raw = pa.py_buffer(data[data != BREAK].tobytes())
    parts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), raw).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, stops).astype(np.int32)), parts, mask=texts.is_null())


def literal_parts(df: DataFrame, literals: list[str], text: str = "text", out: str = "parts") -> DataFrame:
    """``df`` with each text's parts between and at literals, in order, without empty ones: those that ``literal_spans`` finds; null text: null."""
    shared = sent(df.sparkSession, literals)
    names = [c for c in df.columns if c != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(text), GROUP):
                columns = [batch.column(batch.schema.get_field_index(c)) for c in (*names, text)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], parted(columns[-1], shared.value)], names=[*names, out])

    return df.mapInArrow(work, df.select(*names, F.lit(None).cast("array<string>").alias(out)).schema)
