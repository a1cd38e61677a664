"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive words: words under its ones are hashed,
those under zeros may differ.  Seeds of the test items and of the documents
are joined on their hashes; at each hit the two texts are laid side by side
and the overlap around it is compared word by word, so a passage is found
though some of its words were replaced.

Items, seeds, hits and overlaps are tables.  A bitmap of the items' seeds, of
bounded size, goes to all tasks and keeps the seeds of clean text from being
sent; what it lets through is joined exactly.  A seed or an item that very
many documents share makes a skewed partition of a plain join, which Spark
splits (``spark.sql.adaptive.skewJoin``); nothing is gathered by seed or item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .chunks import CHUNK_BYTES, chunked, rid, rows_of
from .scratch import Scratch

#: Items of fewer words count only word for word and as a whole.
EXACT_BELOW = 6
#: An overlap counts from so many words in common (or all of a shorter item's), in parts of 100 of its length.
LEAST_WORDS, PERCENT = 13, 80
#: Fixed masks, each with the least and most words of the items that it is for; a one is a word that must agree.
MASKS = (
    *(("1" * n, n, n) for n in range(1, EXACT_BELOW)),
    ("1111", EXACT_BELOW, LEAST_WORDS - 1),
    ("11011", EXACT_BELOW, LEAST_WORDS - 1),
    ("111111", EXACT_BELOW, None),
    ("11011011", EXACT_BELOW, None),
    ("1101000110011", EXACT_BELOW, None),
    ("1010110100101", EXACT_BELOW, None),
    ("11010101001", EXACT_BELOW, None),
)
#: Bits of the bitmap for each seed, so many that clean text hardly ever passes; its least and greatest size
#: as powers of two: 64 MB at most, beyond which more is let through to the join.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 16, 29
PROBES = tuple(words.mix(np.arange(1, 7, dtype=np.uint64)) | np.uint64(1))
#: Bitmaps that the driver puts together.
TEAMS = 4
#: Rows of Arrow batches in which documents are read.
SLICE_CHARACTERS = 1 << 20


def _separators() -> np.ndarray:
    """Bytes that part words: ASCII other than letters and digits."""
    out = np.ones(256, dtype=bool)
    out[128:] = False
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = False
    return out


SEPARATORS = _separators()


def tokens(texts: list[str | None]) -> words.Words:
    """Words of lower-cased texts: runs of letters and digits, and of whatever is not ASCII."""
    return words.split(*words.texts_buffer(pa.array([(t or "").lower() for t in texts], pa.string())), space=SEPARATORS)


def seed(h: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the words under a mask's ones, where it begins at ``at``."""
    out = np.full(len(at), which + 1, dtype=np.uint64)
    for k, bit in enumerate(MASKS[which][0]):
        if bit == "1":
            out *= words.MULTIPLIERS[0]
            out += h[at + k]
    return words.mix(out)


def item_seeds(w: words.Words, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: which it is, places of the words at which its seeds begin, and the seeds."""
    size = w.counts()
    for which, (mask, least, most) in enumerate(MASKS):
        at = w.windows(len(mask))
        n = size[w.doc[at]]
        at = at[(n >= least) & (n <= (most or n))]
        if len(at):
            yield which, at, seed(h, at, which)


@dataclass
class Bitmap:
    """A Bloom filter of seeds: each sets one bit for each probe."""

    bits: np.ndarray
    power: int

    @staticmethod
    def power_for(seeds: int) -> int:
        return min(MOST_BITS, max(LEAST_BITS, (BITS_A_SEED * seeds).bit_length()))

    @staticmethod
    def empty(power: int) -> Bitmap:
        return Bitmap(np.zeros(1 << (power - 3), dtype=np.uint8), power)

    def _places(self, s: np.ndarray, probe: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        i = (s * probe) >> np.uint64(64 - self.power)
        return (i >> np.uint64(3)).astype(np.int64), np.uint8(1) << (i & np.uint64(7)).astype(np.uint8)

    def add(self, s: np.ndarray) -> None:
        for probe in PROBES:
            np.bitwise_or.at(self.bits, *self._places(s, probe))

    def holds(self, s: np.ndarray) -> np.ndarray:
        """Places in ``s`` of seeds that may be among those added."""
        at = np.arange(len(s))
        for probe in PROBES:
            byte, bit = self._places(s[at], probe)
            at = at[(self.bits[byte] & bit) != 0]
        return at


def best_run(same: np.ndarray, percent: int) -> tuple[int, int, int]:
    """The stretch of a word-by-word comparison with most agreement of at least ``percent``: (agreeing, from, to).

    Stretches begin and end where words agree.  A stretch is good if the sum
    of 100 - percent for each agreement and -percent for each other is not
    negative; of good ones the longest is taken, the first if tied.
    """
    weight = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    lows = np.minimum.accumulate(weight)
    highs = np.maximum.accumulate(weight[::-1])[::-1]
    best, i, j, n = (0, 0), 0, 0, len(weight)
    # Two fingers: the widest pair of places with weight[j] >= weight[i].
    while i < n and j < n:
        if highs[j] >= lows[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    a, b = best
    while a < b and not same[a]:
        a += 1
    while b > a and not same[b - 1]:
        b -= 1
    return int(same[a:b].sum()), a, b


def overlap(same: np.ndarray, size: int, least: int = LEAST_WORDS, percent: int = PERCENT) -> tuple[int, int, int] | None:
    """The overlap that counts in a comparison with an item of ``size`` words, as ``best_run`` gives it; None if there is none."""
    if size < EXACT_BELOW:
        return (size, 0, size) if len(same) == size and same.all() else None
    agree, a, b = best_run(same, percent)
    need = min(least, size)
    return (agree, a, b) if b - a >= need and agree * 100 >= percent * need else None


def slices(texts: list[str | None], characters: int = SLICE_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters: a task's arrays are of one range."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


ITEM = "item long, item_id long, n int, h binary"
SEED = "seed long, which int, item long, n int, place int"
HIT = "rid long, h binary, seeds array<long>, places array<int>"


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with word hashes end to end; ``item`` numbers rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tokens(batch.column("text").to_pylist())
            h = w.hashes()
            code = [h[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(w.counts(), pa.int32()), pa.array(code, pa.binary())], names=["item", "item_id", "n", "h"])

    plain = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.where("text is not null").mapInArrow(work, ITEM).where("n > 0")


def _seeds(items: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]).astype(np.int64)
            h = np.frombuffer(b"".join(batch.column("h").to_pylist()), dtype=np.uint64)
            w = words.Words(np.zeros(0, np.uint8), h, h, np.repeat(np.arange(len(first) - 1), np.diff(first)), first)
            item, n = batch.column("item").to_numpy(), batch.column("n").to_numpy()
            for which, at, s in item_seeds(w, h):
                cols = (s.view(np.int64), np.full(len(s), which, dtype=np.int32), item[w.doc[at]], n[w.doc[at]], (at - first[w.doc[at]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["seed", "which", "item", "n", "place"])

    return items.mapInArrow(work, SEED)


def _bitmap(seeds: DataFrame, count: int) -> Bitmap:
    """The tasks' bitmaps put together, by a few tasks first."""
    power = Bitmap.power_for(count)

    def given(bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bitmap.empty(power)
        for batch in batches:
            own.add(batch.column("seed").to_numpy().view(np.uint64))
        yield given(own.bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap.empty(power).bits
        for batch in batches:
            for x in batch.column("bits"):
                bits |= np.frombuffer(x.as_py(), dtype=np.uint8)
        yield given(bits)

    out = Bitmap.empty(power)
    for row in seeds.select("seed").mapInArrow(make, "bits binary").repartition(TEAMS).mapInArrow(merge, "bits binary").collect():
        out.bits |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _hits(docs: DataFrame, bitmap: Bitmap, masks: list[int]) -> DataFrame:
    """Of documents (rid, text) those with seeds that the bitmap lets through: these seeds, and the hashes of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("rid").to_pylist()
            for a, b in slices(texts):
                w = tokens(texts[a:b])
                h = w.hashes()
                at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
                for which in masks:
                    begin = w.windows(len(MASKS[which][0]))
                    s = seed(h, begin, which)
                    k = shared.value.holds(s)
                    at.append(begin[k])
                    found.append(s[k])
                at, found = np.concatenate(at), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order].view(np.int64)
                cuts = np.searchsorted(at, w.first)
                out = [(ids[a + i], h[w.first[i] : w.first[i + 1]].tobytes(), found[x:y], (at[x:y] - w.first[i]).astype(np.int32)) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                if out:
                    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["rid", "h", "seeds", "places"])

    return docs.mapInArrow(work, HIT)


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (rid, item_id, n, lo, mine, its) whose stretches overlap as the rule asks; ``first_word`` is the document's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, item_id, n, lo, mine, its in zip(*(batch.column(c).to_pylist() for c in ("rid", "item_id", "n", "lo", "mine", "its")), strict=True):
                found = overlap(np.frombuffer(mine, dtype=np.uint64) == np.frombuffer(its, dtype=np.uint64), n)
                if found:
                    out.append((row, item_id, found[0], found[2] - found[1], lo + found[1]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rid", "item_id", "agree", "length", "first_word"])

    return pairs.mapInArrow(work, "rid long, item_id long, agree int, length int, first_word int")


def overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified overlaps of documents (rid, text) with items: ``rid, item_id, agree, length, first_word``.

    One row for each alignment of a document and an item that counts.  Items
    with null text or without a word match nothing; items need no id.
    """
    items = scratch.stage(_items(benchmark))
    seeds = scratch.stage(_seeds(items))
    about = seeds.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("which")).alias("masks")).first()
    hits = scratch.stage(_hits(docs, _bitmap(seeds, about["n"]), about["masks"]))
    flat = hits.select("rid", F.octet_length("h").alias("bytes"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("rid", "bytes", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    met = flat.join(seeds.select("seed", "item", "n", "place"), "seed").select("rid", "item", "n", (F.col("at") - F.col("place")).alias("diagonal"), "bytes").distinct()
    lo, hi = F.greatest(F.col("diagonal"), F.lit(0)), F.least(F.col("diagonal") + F.col("n"), (F.col("bytes") / 8).cast("int"))
    # Only where so many words lie side by side can the overlap count.
    pairs = met.select("rid", "item", "n", "diagonal", lo.alias("lo"), hi.alias("hi")).where(F.col("hi") - F.col("lo") >= F.least(F.col("n"), F.lit(LEAST_WORDS)))
    pairs = scratch.stage(pairs.join(hits.select("rid", "h"), "rid").select("rid", "item", "n", "lo", "hi", "diagonal", F.expr("substring(h, lo * 8 + 1, (hi - lo) * 8)").alias("mine")))
    both = pairs.join(items.select("item", "item_id", F.col("h").alias("theirs")), "item").select("rid", "item_id", "n", "lo", "mine", F.expr("substring(theirs, (lo - diagonal) * 8 + 1, (hi - lo) * 8)").alias("its"))
    return _verified(both)


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, agree, length, first_word`` of each row of ``docs`` (doc_id, text).

    ``item_id``, ``agree``, ``length`` and ``first_word`` (place of its first
    word in the document) are of the overlap with most agreeing words, of tied
    ones that with the smallest item_id, then the shortest, then the first
    (null, 0, 0, null if there is none); ``n_items`` counts different ids.
    Items without id or text are left out; overlaps of fewer than 13 words
    count only as the whole of an item, those of items of fewer than six words
    only word for word.  Null text counts as empty.  Rows are read one by one:
    repeated rows and null ids get a row each, an empty table none; without
    items nothing is contaminated.  Other columns are left out, so their names
    don't matter.
    """
    staged = scratch.stage(chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))).select("doc_id", "text", rid().alias("rid"))
    found = overlaps(staged.select("rid", "text"), benchmark.where("item_id is not null"), scratch)
    best = F.max(F.struct("agree", (-F.col("item_id")).alias("i"), (-F.col("length")).alias("l"), (-F.col("first_word")).alias("w"))).alias("best")
    each = scratch.stage(found.groupBy("rid", "item_id").agg(best).groupBy("rid").agg(F.count("*").cast("int").alias("n_items"), F.max("best").alias("best")))
    out = staged.select("rid", "doc_id").join(each, "rid", "left")
    plain = {"n_items": "n_items", "agree": "best.agree", "length": "-best.l"}
    counts = {k: F.coalesce(F.expr(v), F.lit(0)).cast("int").alias(k) for k, v in plain.items()}
    return out.select("doc_id", F.expr("n_items is not null").alias("contaminated"), counts["n_items"], F.expr("-best.i").cast("long").alias("item_id"), counts["agree"], counts["length"], F.expr("-best.w").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of ``docs`` without a verified overlap, all columns as they are.

    Items need no id here; null texts, repeated rows, ties and empty tables
    are as in ``find``: a row stays or goes by its own text, and without items
    all stay.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = f"c{names.index('text')}"
    staged = scratch.stage(chunked(plain, text=text, chunk_bytes=CHUNK_BYTES))
    found = overlaps(staged.select(rid().alias("rid"), F.col(text).cast("string").alias("text")), benchmark, scratch)
    return rows_of(staged, found.select("rid").distinct(), scratch, among=False).select(*plain.columns).toDF(*names)
