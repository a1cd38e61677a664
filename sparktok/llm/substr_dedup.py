"""Remove repeated passages: words covered by a window that also starts earlier.

Count-min prefilter.  Each chunk of the corpus sends a sparse sketch of the
hashes of its windows; the merged sketches overestimate how often a window
occurs, and each chunk learns which of its windows may be repeated.  Only those
go into the second pass, which groups them exactly by 128-bit hash and finds
the first place of each.  A window that occurs twice is never estimated to
occur once, so none is lost.

Bounds: a chunk (8 MB of text, or one longer text) is the most that a task
holds; a window that every document shares is sent once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, words
from .chunks import CHUNK_BYTES, chunked, total_bytes
from .scratch import Scratch

WINDOW = 20
BYTES_A_WORD = 6
FOUND = "part int, chunk long, entries int, hi binary, lo binary, doc binary, ix binary"
LATER = "chunk long, ix binary"
OUT = "doc_id long, n_words long, n_removed long, kept_text string"
MAX_PARTS = 1 << 16
PART_BYTES = 4 << 20
#: A null doc_id comes before all others.
NULL_ID = np.iinfo(np.int64).min


def planes(a: np.ndarray) -> bytes:
    """Bytes of the same weight together: high bytes of small numbers then compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def from_planes(code: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(code, dtype=np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("row").combine_chunks()


class _Windows:
    """Windows of a chunk's rows (in row order): their places, hashes and order."""

    def __init__(self, ids: pa.Array, texts: pa.Array, n: int):
        self.words = words.words_of(texts)
        self.at = self.words.windows(n)
        h = self.words.hashes(0)
        self.hi = words.runs_hash(h, self.at, n, 0)
        self.ids = ids.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        self.n = n

    def lo(self, at: np.ndarray) -> np.ndarray:
        return words.runs_hash(self.words.hashes(1), self.at[at], self.n, 1)

    def firsts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``at``: those that come first of their kind in the chunk, in order of
        hash; their second hashes; and for each of ``at`` (reordered alike) where its first is."""
        lo = self.lo(at)
        doc = self.words.doc[self.at[at]]
        order = np.lexsort((at, self.ids[doc], lo, self.hi[at]))
        at, lo = at[order], lo[order]
        hi = self.hi[at]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        return at, lo, fresh


def drop_repeats(docs: DataFrame, scratch: Scratch, n: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of each row of ``docs`` (doc_id, text).

    A window is ``n`` consecutive words of one text; a word goes if a window
    over it has the same words as one that starts earlier (smaller doc_id, or
    the same text further left).  Kept words are joined by one space.  Null
    text: no words, empty kept text.  A null doc_id sorts before all others;
    rows with the same doc_id go by their place in the table.  Texts shorter
    than a window keep all words.  An empty table gives no rows.  Other columns
    are left out, so their names don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = scratch.stage(chunked(docs, chunk_bytes=chunk_bytes))
    size = total_bytes(chunks)
    shape = sketch.Shape.for_items(size // BYTES_A_WORD)
    parts = int(min(MAX_PARTS, max(12, size // PART_BYTES)))

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return _Windows(batch.column("doc_id"), batch.column("text"), n).hi

    told = scratch.stage(sketch.merged(sketch.send(chunks, hashes, shape, 8 * chunk_bytes), shape))

    def candidates(rows: pa.Table, reply: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("entries", pa.int32()), *((k, pa.binary()) for k in ("hi", "lo", "doc", "ix"))])
        if not len(reply) or not len(rows):
            return schema.empty_table()
        rows = _in_order(rows)
        w = _Windows(rows.column("doc_id").combine_chunks(), rows.column("text"), n)
        at, lo, fresh = w.firsts(sketch.Repeated(reply, shape)(w.hi))
        at, lo = at[fresh], lo[fresh]
        hi, doc, ix = w.hi[at], w.ids[w.words.doc[w.at[at]]], at.astype(np.uint32)
        cut = np.searchsorted(hi, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
        edges = [0, *cut.tolist(), len(at)]
        out = [(k, len(hi[a:b]), planes(hi[a:b]), planes(lo[a:b]), planes(doc[a:b]), planes(ix[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        cols = list(zip(*out, strict=True)) or [()] * 6
        chunk = rows.column("chunk")[0].as_py()
        return pa.table([cols[0], [chunk] * len(out), *cols[1:]], schema=schema)

    found = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(candidates, FOUND)

    def group(table: pa.Table) -> pa.Table:
        """Exact groups of one range of hashes; for each chunk its windows that another place precedes."""
        chunk = np.repeat(table.column("chunk").to_numpy(), table.column("entries").to_numpy())
        hi, lo, doc, ix = (np.concatenate([from_planes(x, kind) for x in table.column(k).to_pylist()]) for k, kind in (("hi", "u8"), ("lo", "u8"), ("doc", "i8"), ("ix", "u4")))
        order = np.lexsort((ix, chunk, doc, lo, hi))
        later = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        later[1:] = (hi[a] == hi[b]) & (lo[a] == lo[b])
        chunk, ix = chunk[order][later], ix[order][later]
        order = np.argsort(chunk, kind="stable")
        chunk, ix = chunk[order], ix[order]
        edges = np.nonzero(np.diff(chunk))[0] + 1
        cut = np.split(ix, edges) if len(ix) else []
        return pa.table({"chunk": pa.array(chunk[np.concatenate([[0], edges])] if len(ix) else [], pa.int64()), "ix": pa.array([sketch.ef_encode(np.sort(x), 1 << 32) for x in cut], pa.binary())})

    later = scratch.stage(found.groupBy("part").applyInArrow(group, LATER))

    def remove(rows: pa.Table, reply: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        w = _Windows(rows.column("doc_id").combine_chunks(), rows.column("text"), n)
        at, _, fresh = w.firsts(np.arange(len(w.at)))
        kind = np.cumsum(fresh) - 1
        gone = ~fresh
        told = np.concatenate([np.zeros(0, dtype=np.int64), *(sketch.ef_decode(x) for x in reply.column("ix").to_pylist())])
        if len(told):
            where = np.empty(len(at), dtype=np.int64)
            where[at] = kind
            bad = np.zeros(int(kind[-1]) + 1, dtype=bool)
            bad[where[told]] = True
            gone |= bad[kind]
        cover = np.zeros(len(w.words.start) + 1, dtype=np.int32)
        starts = w.at[at[gone]]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + n, -1)
        removed = np.cumsum(cover[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(removed)])
        n_removed = before[w.words.first[1:]] - before[w.words.first[:-1]]
        kept = []
        for i, text in enumerate(rows.column("text").to_pylist()):
            mine = (text or "").encode().split()
            if n_removed[i]:
                keep = ~removed[w.words.first[i] : w.words.first[i + 1]]
                mine = [x for x, k in zip(mine, keep.tolist(), strict=True) if k]
            kept.append(b" ".join(mine))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": w.words.counts().astype(np.int64), "n_removed": n_removed.astype(np.int64), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return chunks.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(remove, OUT)
