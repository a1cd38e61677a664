"""Exact self-join of documents on the Jaccard similarity of their word shingles.

1. Every document's shingle hashes go into a count-min sketch (``sketch``): a
   document of which too many shingles occur nowhere else has no partner.
2. Documents with the same set stand for each other; the sketch is asked again
   about one of each, which leaves documents that have near copies.
3. Sorted neighbourhoods under a few smallest hashes give exact links that
   join up large groups of near copies without looking at all of their pairs.
4. Whatever could still link two components shares a token of the prefixes
   (1 - t of a set, the rarest tokens by a table of hashed counts).  Their
   owners meet in tiles of one token and one band of sizes; where these are
   many, they are parted into blocks and a tile is of two blocks, so that no
   task gets all of a frequent token.  The bit counts of hashed parity bitmaps
   bound the overlap from above, and pairs that pass are intersected exactly
   as sorted arrays: first one pair of any two components, then all that are
   left.

No step emits the pairs of a group: 3 emits a link or two for each document,
and 4 only pairs between different components that the bitmaps let through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch, words
from .chunks import CHUNK_BYTES, ROW_BITS, chunked, rows_of, total_bytes
from .components import components
from .scratch import Scratch

SHINGLE, PERCENT = 4, 85
BYTES_A_WORD = 6
SEEDS = tuple(np.uint64(x) for x in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
RECENT = 24
#: Rows of a token and band in one block, of which a tile has two at most; each row is sent once for each block.
#: No more blocks than MOST_BLOCKS: beyond that they grow.  STRIP rows at a time are compared with all others of a tile.
BLOCK, MOST_BLOCKS, STRIP = 512, 128, 512
#: Hashed counts of tokens, which put the prefixes in order: one table of 4 MB, whatever the corpus.
COUNTERS = 1 << 20
#: Tables of counts that the driver adds up.
TEAMS = 4

TILE = ("token", "band", "i", "j")
FOUND = "rid long, doc_id long, n int, f1 long, f2 long, shingles binary"
NEAR = "rid long, n int, shingles binary, shared binary, bits binary, m0 long, m1 long, m2 long"


def ceil_div(a, b):
    return -(-a // b)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, A-Z lowered; a shorter text is one shingle."""
    w = words.words_of(texts)
    h = w.hashes(0, lower=True)
    at = w.windows(n)
    s = words.runs_hash(h, at, n)
    cut = np.searchsorted(at, w.first)
    for i, k in enumerate(w.counts()):
        if k >= n:
            yield np.unique(s[cut[i] : cut[i + 1]])
        elif k:
            yield words.runs_hash(h, np.array([w.first[i]]), int(k), 1)
        else:
            yield np.zeros(0, dtype=np.uint64)


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: at least four bits for each element, 64 to 16,384 in all.

    So wide, few differing elements meet in a bit, and the bound is nearly the overlap itself.
    """
    width = min(1 << 14, max(64, 1 << (4 * len(s) - 1).bit_length()))
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap as it is with fewer bits."""
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Rule:
    """``100 * intersection >= percent * union`` and what follows from it."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def least_shared(self, n: int) -> int:
        """Elements that a set of n shares at least with any partner."""
        return ceil_div(self.percent * n, 100)

    def probe(self, n: int) -> int:
        """Length of the prefix in which it meets a smaller partner's index prefix."""
        return n - self.least_shared(n) + 1

    def index(self, n: int) -> int:
        """Length of the prefix in which a partner of at least its size meets it."""
        return n - ceil_div(2 * self.percent * n, 100 + self.percent) + 1

    def sizes(self, a, b):
        return (100 * a >= self.percent * b) & (100 * b >= self.percent * a)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _first_pass(chunks: DataFrame, told: DataFrame, shape: sketch.Shape, n: int, rule: Rule) -> DataFrame:
    def work(rows: pa.Table, reply: pa.Table) -> pa.Table:
        rows = rows.sort_by("row").combine_chunks()
        sets = list(shingle_sets(rows.column("text"), n))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        marks = np.zeros(edges[-1] + 1, dtype=np.int64)
        if len(reply) and edges[-1]:
            marks[sketch.Repeated(reply, shape)(np.concatenate(sets)) + 1] = 1
        marks = np.cumsum(marks)
        shared = marks[edges[1:]] - marks[edges[:-1]]
        rid = (rows.column("chunk").to_numpy() << ROW_BITS) | rows.column("row").to_numpy()
        f1, f2, out, seen = [], [], [], set()
        for s, k in zip(sets, shared.tolist(), strict=True):
            if not len(s) or k < rule.least_shared(len(s)):
                f1.append(None), f2.append(None), out.append(None)
                continue
            key = int(_signed(words.mix(s).sum(keepdims=True))[0]), int(_signed(words.mix(s ^ SEEDS[0]).sum(keepdims=True))[0])
            f1.append(key[0]), f2.append(key[1]), out.append(None if key in seen else s.tobytes())
            seen.add(key)
        return pa.table({"rid": rid, "doc_id": rows.column("doc_id"), "n": sizes.astype(np.int32), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "shingles": pa.array(out, pa.binary())})

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(work, FOUND)


def _near(sets: DataFrame, told: DataFrame, shape: sketch.Shape, rule: Rule) -> DataFrame:
    """Sets of which enough may occur elsewhere; ``shared`` has these tokens, in the order of their hashes."""
    names = ["rid", "n", "shingles", "shared", "bits", "m0", "m1", "m2"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 3]

    def work(rows: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        repeated = sketch.Repeated(reply, shape) if len(reply) else None
        for rid, code in zip(rows.column("rid").to_pylist(), rows.column("shingles").to_pylist(), strict=True) if repeated else ():
            s = np.frombuffer(code, dtype=np.uint64)
            shared = s[repeated(s)]
            if len(shared) < rule.least_shared(len(s)):
                continue
            least = [int(_signed(words.mix(shared ^ x).min(keepdims=True))[0]) for x in SEEDS]
            out.append((rid, len(s), code, shared.tobytes(), bitmap(s), *least))
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return sets.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(work, NEAR)


def _counts(near: DataFrame, counters: int) -> np.ndarray:
    """How many sets have tokens of each hash, added up by tasks, by a few teams and by the driver."""

    def given(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("shared").to_pylist()), dtype=np.uint64)
            np.add.at(total, _counter(every, counters), 1)
        yield given(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_py(), dtype="<u4")
        yield given(total)

    total = np.zeros(counters, dtype=np.int64)
    for row in near.select("shared").mapInArrow(count, "counts binary").repartition(TEAMS).mapInArrow(add, "counts binary").collect():
        total += np.frombuffer(row["counts"], dtype="<u4")
    return np.minimum(total, 0xFFFFFFFF).astype(np.uint32)


def _counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (tokens >> np.uint64(16)).astype(np.int64) & (counters - 1)


def _prefixes(near: DataFrame, rule: Rule, counters: int) -> DataFrame:
    """(token, rid, n, is_index) of each token of a set's prefix: the rarest by hashed counts, then the smallest.

    Tokens that occur in no other set come before all others, whatever their count.
    """
    shared = near.sparkSession.sparkContext.broadcast(_counts(near, counters))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes, index = [np.zeros(0, dtype=np.uint64)], [], [np.zeros(0, dtype=bool)]
            for n, code in zip(batch.column("n").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                s = np.frombuffer(code, dtype=np.uint64)
                alone = n - len(s)
                k = max(0, rule.probe(n) - alone)
                s = s[np.argsort(shared.value[_counter(s, counters)], kind="stable")[:k]]
                tokens.append(s)
                sizes.append(len(s))
                index.append(np.arange(len(s)) < rule.index(n) - alone)
            rid, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("rid", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), pa.array(rid, pa.int64()), pa.array(n, pa.int32()), pa.array(np.concatenate(index))], names=["token", "rid", "n", "is_index"])

    return near.select("rid", "n", "shared").mapInArrow(work, "token long, rid long, n int, is_index boolean")


def _neighbours(near: DataFrame, key: str, rule: Rule) -> DataFrame:
    """Exact links between documents close to each other in the order of (key, size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for m, rid, code in zip(batch.column(key).to_pylist(), batch.column("rid").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if m != now:
                    now, recent = m, []
                s, joined, tried = np.frombuffer(code, dtype=np.uint64), set(), {}
                for root, other in reversed(recent):
                    if root in joined or tried.get(root, 0) >= 3 or not rule.sizes(len(s), len(other)):
                        continue
                    tried[root] = tried.get(root, 0) + 1
                    if rule.linked(overlap(s, other), len(s), len(other)):
                        joined.add(root)
                root = min(joined, default=rid)
                out += [(rid, x) for x in joined]
                recent = [(root if r in joined else r, x) for r, x in recent[-RECENT:]] + [(root, s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    order = near.select(key, "rid", "n", "shingles").repartitionByRange(key, "n", "rid").sortWithinPartitions(key, "n", "rid")
    return order.mapInArrow(work, "src long, dst long")


def _tiles(entries: DataFrame, rule: Rule, best_only: bool) -> DataFrame:
    """Pairs of different components that meet in a tile and pass the bitmaps' bound.

    A tile is of one token, one band and two blocks (i, j) of its rows, or one.
    ``entries`` is a written table, so that the repartition here is a shuffle of its own.
    ``best_only``: of the pairs of two components in a tile, the one with the highest bound.
    """

    def tile(n, comp, rid, is_index, here, block, bits) -> Iterator[tuple[int, int]]:
        width = min(map(len, bits))
        one_block = block[0] == block.min() == block.max()
        packed = np.stack([np.frombuffer(x, dtype=np.uint8) if len(x) == width else folded(np.frombuffer(x, dtype=np.uint8), width) for x in bits]).view(np.uint64)
        for a in range(0, len(n), STRIP):
            left = a + np.nonzero((is_index & here)[a : a + STRIP])[0]
            if not len(left):
                continue
            bigger = (n[None, :] > n[left, None]) | ((n[None, :] == n[left, None]) & (rid[None, :] > rid[left, None]))
            met = (comp[left, None] != comp[None, :]) & (one_block | (block[left, None] != block[None, :]))
            i, j = np.nonzero(bigger & met & rule.sizes(n[left, None], n[None, :]))
            i = left[i]
            differ = np.zeros(len(i), dtype=np.int64)
            for k in range(packed.shape[1]):
                differ += np.bitwise_count(packed[i, k] ^ packed[j, k])
            most = (n[i] + n[j] - differ) // 2
            ok = np.nonzero((100 + rule.percent) * most >= rule.percent * (n[i] + n[j]))[0]
            if best_only:
                slack = (n[i] + n[j])[ok] / np.maximum(most[ok], 1)
                lo, hi = np.minimum(comp[i], comp[j])[ok], np.maximum(comp[i], comp[j])[ok]
                order = np.lexsort((rid[j][ok], rid[i][ok], slack, hi, lo))
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
                ok = ok[order[fresh]]
            yield from zip(np.minimum(rid[i], rid[j])[ok].tolist(), np.maximum(rid[i], rid[j])[ok].tolist(), strict=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table]:
            changes = np.zeros(len(table) - 1, dtype=bool)
            for c in TILE:
                key = table.column(c).to_numpy()
                changes |= key[1:] != key[:-1]
            edges = [0, *(np.nonzero(changes)[0] + 1).tolist(), len(table)]
            out: set[tuple[int, int]] = set()
            n, comp, rid, block = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "comp", "rid", "block"))
            is_index, here, bits = table.column("is_index").to_numpy(), table.column("here").to_numpy(), table.column("bits").to_pylist()
            stop = len(edges) - 1 if last else len(edges) - 2
            for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True):
                if b - a > 1:
                    out.update(tile(n[a:b], comp[a:b], rid[a:b], is_index[a:b], here[a:b], block[a:b], bits[a:b]))
            return list(out), table.slice(edges[stop]) if stop >= 0 else table

        def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > 20_000:
                out, rest = done(pa.Table.from_batches(held).combine_chunks(), False)
                held = rest.combine_chunks().to_batches()
                yield pairs(out)
        if held:
            yield pairs(done(pa.Table.from_batches(held).combine_chunks(), True)[0])

    # By ranges, which hold about as many rows each: by hash, several large tiles would meet in one task.
    order = entries.repartitionByRange(*TILE).sortWithinPartitions(*TILE, "rid")
    return order.mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, near: DataFrame, rule: Rule) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(rule.linked(overlap(s, t), len(s), len(t)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = near.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = near.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def join(docs: DataFrame, scratch: Scratch, n: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rid, doc_id, n_shingles, root, component_id`` of each row of ``docs`` (doc_id, text).

    ``rid`` numbers rows; ``component_id`` is the smallest doc_id of the row's
    component (null only if all are null) and ``root`` the rid of the first row by
    (doc_id, rid), null first.
    A text of fewer than ``n`` words is one shingle; null, empty and blank
    texts have none and link with nothing.  Equal sets of equal texts link,
    however often a row is repeated.  An empty table gives no rows; other
    columns are left out, so their names don't matter.  Shingles are compared
    as 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _joined(scratch.stage(chunked(docs, chunk_bytes=chunk_bytes)), scratch, n, percent, chunk_bytes)


def keep_first(docs: DataFrame, scratch: Scratch, n: int = SHINGLE, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Of each component of ``docs`` the first row by (doc_id, place), all columns as they are."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    doc_id, text = (f"c{names.index(k)}" for k in ("doc_id", "text"))
    staged = scratch.stage(chunked(plain.withColumn(text, F.col(text).cast("string")), text=text, chunk_bytes=chunk_bytes))
    chunks = staged.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), "chunk", "row")
    kept = _joined(chunks, scratch, n, percent, chunk_bytes).where("rid = root").select("rid")
    return rows_of(staged, kept, scratch, among=True).select(*plain.columns).toDF(*names)


def _joined(chunks: DataFrame, scratch: Scratch, n: int, percent: int, chunk_bytes: int) -> DataFrame:
    """The join over a written table of chunks."""
    rule = Rule(percent)
    shape = sketch.Shape.for_items(total_bytes(chunks) // BYTES_A_WORD)

    def of_texts(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_sets(batch.column("text"), n)])

    told = scratch.stage(sketch.merged(sketch.send(chunks, of_texts, shape, 8 * chunk_bytes), shape))
    found = scratch.stage(_first_pass(chunks, told, shape, n, rule))
    scratch.drop(told)

    kinds = scratch.stage(found.where("f1 is not null").groupBy("f1", "f2").agg(F.min("rid").alias("rep")))
    owners = found.where("shingles is not null").join(kinds.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "n", "shingles")
    sets = scratch.stage(chunked(owners, text="shingles", chunk_bytes=chunk_bytes))
    shape = sketch.Shape.for_items(total_bytes(sets, "shingles") // 8)

    def of_sets(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.uint64)

    told = scratch.stage(sketch.merged(sketch.send(sets, of_sets, shape, 8 * chunk_bytes), shape))
    near = scratch.stage(_near(sets, told, shape, rule))
    scratch.drop(sets)

    links = [scratch.stage(_neighbours(near, f"m{k}", rule)) for k in range(len(SEEDS))]
    first = components(links[0].union(links[1]).union(links[2]), scratch)

    # A band is a hair wider than any partner can be larger, so partners are at most one band apart.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.000001 / percent))).cast("int")
    entries = scratch.stage(_prefixes(near, rule, COUNTERS).withColumn("own", band))
    label = scratch.stage(near.select("rid").join(first.toDF("rid", "root"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("comp")))
    # First one pair of any two components that meet, which joins most that belong together; then all that are left.
    for best_only in (True, False):
        labelled = entries.join(label, "rid")
        banded = labelled.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("here", F.expr("band = own"))
        several = banded.groupBy("token", "band").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or(F.expr("here and is_index")).alias("any")).where("lo < hi and any")
        several = scratch.stage(several.select("token", "band", F.least(F.ceil(F.col("k") / BLOCK), F.lit(MOST_BLOCKS)).cast("int").alias("blocks")))
        mixed = banded.join(several, ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int"))
        mixed = mixed.withColumn("tile", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")))
        # Written first: Spark would take the join's partitions for those that _tiles asks for, and then split or localize them.
        mixed = scratch.stage(mixed.join(near.select("rid", "bits"), "rid").select("token", "band", "tile.i", "tile.j", "block", "rid", "n", "is_index", "here", "comp", "bits"))
        pairs = scratch.stage(_tiles(mixed, rule, best_only).distinct())
        more = _verified(pairs, near, rule)
        more = more.join(label.toDF("a", "src"), "a").join(label.toDF("b", "dst"), "b").select("src", "dst")
        joined = components(more, scratch).toDF("comp", "root")
        scratch.drop(mixed)
        label = scratch.stage(label.join(joined, "comp", "left").select("rid", F.coalesce("root", "comp").alias("comp")))

    rows = found.select("rid", "doc_id", F.col("n").alias("n_shingles"), "f1", "f2").join(kinds, ["f1", "f2"], "left")
    rows = rows.join(label.toDF("rep", "comp"), "rep", "left").withColumn("root", F.coalesce("comp", "rep", "rid"))
    rows = scratch.stage(rows.select("rid", "doc_id", "n_shingles", "root"))
    # Written, so that the join is one of two tables, in which Spark splits the rows of a large component.
    least = scratch.stage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "rid"))["rid"].alias("first_rid")))
    return rows.join(least, "root").select("rid", "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("first_rid").alias("root"), "component_id")
