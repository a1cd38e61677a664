"""Best-fit packing of documents' tokens into sequences, by bin completion.

Pieces of one length are interchangeable, so the packing problem of any corpus
is a histogram of at most ``capacity`` lengths.  The driver solves that and
sends back patterns with multiplicities; every piece then finds its sequence
from its rank among the pieces of its length.

The solver takes the largest remaining length, finds the undominated filling
of the room beside it that wastes least, and applies it as often as the counts
allow; what little is left is searched by branch and bound over all undominated
fillings.  It begins anew for some lengths above which pieces are packed among
themselves, which is the branch that the fullest filling rules out.  All of it
is pruned by the waste that a better answer can afford.  Best-fit decreasing is
the first incumbent, of the whole and of that last part.
"""

from __future__ import annotations

import itertools
import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.encoder import ENTRY_BYTES, code
from .scratch import Scratch

CAPACITY = 2048
END_ID = 0
#: Items left to the exact search, nodes that it may visit, and fillings that it takes at a node.
TAIL_ITEMS, NODES, FILLINGS = 120, 20_000, 4000
#: Lengths at which the solver begins anew, at most: coarse steps, then finer ones around the best.
DIVES = 24
#: Bytes of units that a worker remembers, twice: those of now and those of before; characters of the longest.
MEMO_BYTES, LONGEST = 96 << 20, 256
#: Steps of work in one solution and at least in one exact search (some 2 microseconds each), and the steps that a test of
#: domination and a fullest filling count as.  So the driver's time is bounded whatever the lengths are.
WORK, TAIL_WORK, DOMINATION, FULLEST = 8_000_000, 20_000, 5, 250

Pattern = tuple[int, tuple[int, ...]]

# ---------------------------------------------------------------- tokens

#: White space as the tokenizer's pattern reads it (fixed values: Unicode's White_Space).
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that have been such since early Unicode.
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u04ff"
_WORD = re.compile(rf" ?[{_LETTERS}]+")


def _units(letters: str, ws: str) -> re.Pattern:
    return re.compile(rf" ?[0-9{letters}]++(?=[\x00-\x7f]|$)|[{ws}]+(?![^{ws}])| ?[^{ws}]+|[{ws}]+")


#: Runs that no token crosses: a word with the space before it, up to ASCII that is no letter or
#: digit; whatever else is without white space; white space. Small classes are matched faster, so ASCII has its own.
_UNIT, _ASCII_UNIT = _units(_LETTERS, _WS), _units("A-Za-z", r"\t-\r ")


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: itself if it shows, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class Units(dict):
    """Ids by unit, as bytes, made when a unit is asked for; two generations of ``most`` bytes, and no unit of over LONGEST characters, are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.size = make, most, 0
        self.old: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.make(unit)
        if len(unit) <= LONGEST:
            if self.size > self.most:
                self.old, self.size = dict(self), 0
                self.clear()
            self[unit] = found
            self.size += ENTRY_BYTES + len(unit) + len(found)
        return found


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, remembered by unit.

    A byte-level tokenizer whose pattern keeps a space with the word after it
    never joins what ``_UNIT`` parts.  A new unit of letters is a single word to
    the tokenizer and goes to its model at once; others go through all of it.
    Texts that contain an added token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, byte_characters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Units(self._unit, MEMO_BYTES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _unit(self, unit: str) -> bytes:
        word = unit[1:] if unit[0] == " " else unit
        if word.isascii() and word.isalpha():
            found = self.model.tokenize(word if word is unit else self.characters[0x20] + word)
        elif _WORD.fullmatch(unit):
            found = self.model.tokenize(unit.encode().decode("latin-1").translate(self.characters))
        else:
            return code(self.tokenizer.encode(unit, add_special_tokens=False).ids)
        return code([x.id for x in found])

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return self._ids(text)
        units = (_ASCII_UNIT if text.isascii() else _UNIT).findall(text)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, units)), dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """A worker's encoder, kept over its tasks; called by name, for a function sent to workers brings its own copy of a dict."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, place long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and one end id, cut from the right into pieces of ``capacity``; the first may be shorter.

    ``ids`` are little-endian unsigned 32-bit; ``part`` is the task that made
    the piece and ``place`` its place among that task's pieces of its length.
    Null text counts as empty: one piece of the end id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        part, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.array(end_id, dtype="<u4"))
                first = len(ids) % capacity or capacity
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    out.append((doc_id, piece, start, stop - start, ids[start:stop].tobytes(), part, used[stop - start]))
                    used[stop - start] += 1
            for k in range(0, len(out), 512):
                cols = zip(*out[k : k + 512], strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


# ---------------------------------------------------------------- solver


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: (how often, lengths) of its bins."""
    groups: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, items: tuple[int, ...]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append([times, items])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                times, items = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, items = capacity, ()
                times = max(1, left // (capacity // length))
            each = min(room // length, left)
            filled = min(times, left // each)
            if filled < times:
                put(room, times - filled, items)
            put(room - each * length, filled, items + (length,) * each)
            left -= each * filled
    return [(times, items) for group in groups.values() for times, items in group]


def bins(patterns: list[Pattern]) -> int:
    return sum(times for times, _ in patterns)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound over all thresholds."""
    n = np.zeros(capacity + 1, dtype=object)
    for length, times in counts.items():
        n[length] = times
    number, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    best = -(-int(volume[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        big = int(number[-1] - number[capacity - k])
        half = int(number[capacity - k] - number[capacity // 2])
        room = half * capacity - int(volume[capacity - k] - volume[capacity // 2])
        small = int(volume[capacity // 2] - (volume[k - 1] if k else 0))
        best = max(best, big + half + max(0, -(-(small - room) // capacity)))
    return best


@dataclass
class Work:
    """Steps that searches may still take: one for a set that is grown, more for a test of domination.

    They are counted and not timed, so that reruns agree.
    """

    left: int

    def part(self, most: int) -> Work:
        """A share of what is left, taken out of it."""
        most = min(most, self.left)
        self.left -= most
        return Work(most)


def fillings(items: list[int], room: int, least: int, work: Work | None = None) -> list[tuple[int, ...]]:
    """Undominated sets of ``items`` (sorted, largest first) within ``room`` of at least ``least``; fullest first.

    They are of the first FILLINGS sets that are found, those with large
    items, or of those found before ``work`` is used up.

    A set is dominated if some of it could be replaced by one larger item left
    out that still fits.
    """
    work = work or Work(WORK)
    out: set[tuple[int, ...]] = set()
    rest = list(itertools.accumulate(reversed(items)))[::-1] + [0]

    def grow(k: int, chosen: tuple[int, ...], total: int) -> None:
        work.left -= 1
        if work.left < 0 or len(out) > FILLINGS or total + min(rest[k], room - total) < least:
            return
        while k < len(items) and items[k] > room - total:
            k += 1
        if k == len(items):
            if total >= least:
                out.add(chosen)
            return
        grow(k + 1, (*chosen, items[k]), total + items[k])
        skip = k
        while skip < len(items) and items[skip] == items[k]:
            skip += 1
        grow(skip, chosen, total)

    grow(0, (), 0)

    def dominated(chosen: tuple[int, ...]) -> bool:
        work.left -= DOMINATION
        spare, left = room - sum(chosen), list(items)
        for x in chosen:
            left.remove(x)
        left = sorted(set(left))
        sums = {0: 0}
        for x in chosen:
            for s, size in list(sums.items()):
                sums[s + x] = max(sums.get(s + x, 0), size + 1)
        for s, size in sums.items():
            k = bisect_left(left, s if size > 1 else s + 1)
            if k < len(left) and left[k] <= s + spare:
                return True
        return False

    return sorted((f for f in out if not dominated(f)), key=lambda f: (-sum(f), len(f), f))


@dataclass
class Completion:
    """Branch and bound over bins for a list of lengths."""

    items: list[int]
    capacity: int
    nodes: int = NODES
    work: Work = field(default_factory=lambda: Work(WORK))
    best: list[tuple[int, ...]] = field(default_factory=list)

    def solve(self) -> list[tuple[int, ...]]:
        counts: dict[int, int] = {}
        for x in self.items:
            counts[x] = counts.get(x, 0) + 1
        self.best = [items for times, items in best_fit(counts, self.capacity) for _ in range(times)]
        self.bound = lower_bound(counts, self.capacity) if counts else 0
        self.volume = sum(self.items)
        self._search(sorted(self.items, reverse=True), (), 0)
        return self.best

    def _search(self, left: list[int], done: tuple, waste: int) -> None:
        if not left:
            if len(done) < len(self.best):
                self.best = list(done)
            return
        if len(self.best) <= self.bound or self.nodes <= 0 or self.work.left <= 0:
            return
        self.nodes -= 1
        spare = (len(self.best) - 1) * self.capacity - self.volume - waste
        if spare < 0 or len(done) + -(-sum(left) // self.capacity) >= len(self.best):
            return
        largest, others = left[0], left[1:]
        room = self.capacity - largest
        for f in fillings(others, room, max(0, room - spare), self.work):
            rest = list(others)
            for x in f:
                rest.remove(x)
            self._search(rest, (*done, (largest, *f)), waste + room - sum(f))
            if len(self.best) <= self.bound or self.nodes <= 0 or self.work.left <= 0:
                return


def fullest(n: np.ndarray, room: int) -> tuple[int, ...]:
    """A filling of ``room`` that no other exceeds, with as large items as that allows; n: pieces left of each length.

    One, two or three items that leave no room are looked for first; else all
    sums that any items give are followed, one bit each.
    """
    there = np.nonzero(n[: room + 1])[0]
    if not len(there):
        return ()
    if there[-1] == room:
        return (room,)

    def pair(space: int, most: int, used: int) -> tuple[int, ...]:
        """Two lengths of at most ``most`` that add up to ``space``, beside a piece of ``used``."""
        a = there[(there <= min(most, space - 1)) & (2 * there >= space)]
        need = np.where(2 * a == space, 2, 1)
        ok = (n[space - a] >= need + (space - a == used)) & (n[a] >= need + (a == used))
        return (int(a[ok][-1]), int(space - a[ok][-1])) if ok.any() else ()

    if found := pair(room, room, 0):
        return found
    for x in there[::-1][:64].tolist():
        if room - x > 1 and (found := pair(room - x, x, x)):
            return (x, *found)
    sums, layers = 1, []
    inside = (1 << (room + 1)) - 1
    lengths = there.tolist()
    for x in lengths:
        layers.append(sums)
        for _ in range(min(int(n[x]), room // x)):
            more = sums | (sums << x) & inside
            if more == sums:
                break
            sums = more
    goal, out = sums.bit_length() - 1, []
    for x, before in zip(reversed(lengths), reversed(layers), strict=True):
        k = min(int(n[x]), goal // x)
        while k and not before >> (goal - k * x) & 1:
            k -= 1
        out += [x] * k
        goal -= k * x
    return tuple(out)


def complete(counts: dict[int, int], capacity: int, spare: int, tail_items: int, nodes: int, work: Work) -> list[Pattern] | None:
    """Bins of a histogram by completion of the largest length, each filling as often as it can be; None once more than ``spare`` is wasted or ``work`` is used up."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for x, k in counts.items():
        n[x] = k
    out: list[Pattern] = []
    while int(n.sum()) > tail_items:
        largest = int(np.nonzero(n)[0][-1])
        n[largest] -= 1
        work.left -= FULLEST
        if work.left <= 0:
            return None
        chosen = (largest, *fullest(n, capacity - largest))
        n[largest] += 1
        uses = {x: chosen.count(x) for x in chosen}
        times = min(int(n[x]) // k for x, k in uses.items())
        for x, k in uses.items():
            n[x] -= times * k
        out.append((times, chosen))
        spare -= times * (capacity - sum(chosen))
        if spare < 0:
            return None
    tail = [x for x in np.nonzero(n)[0].tolist() for _ in range(int(n[x]))]
    return out + [(1, items) for items in Completion(tail, capacity, nodes, work.part(max(TAIL_WORK, work.left // 20))).solve()]


def solve(counts: dict[int, int], capacity: int = CAPACITY, tail_items: int = TAIL_ITEMS, nodes: int = NODES, dives: int = DIVES) -> list[Pattern]:
    """Bins of a histogram of lengths as (how often, lengths); never more than best-fit decreasing takes."""
    counts = {x: k for x, k in counts.items() if k}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths are from 1 to {capacity}")
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    volume = sum(x * k for x, k in counts.items())
    lengths, tried, work = sorted(counts), set(), Work(WORK)

    def dive(top: int) -> int:
        """Pack lengths above ``top`` among themselves and all others among themselves; how many bins that takes."""
        nonlocal best
        tried.add(top)
        bins_now, spare = [], (bins(best) - 1) * capacity - volume
        for part in ({x: k for x, k in counts.items() if x > top}, {x: k for x, k in counts.items() if x <= top}):
            found = complete(part, capacity, spare, tail_items, nodes, work)
            if found is None:
                return bins(best) + 1
            spare -= sum(times * (capacity - sum(items)) for times, items in found)
            bins_now += found
        if bins(bins_now) < bins(best):
            best = bins_now
        return bins(bins_now)

    step, centre = len(lengths), len(lengths) - 1
    while bins(best) > bound and len(tried) < dives and work.left > 0:
        step = max(1, step // 4)
        near = [k for k in range(centre - 4 * step, centre + 4 * step + 1, step) if 0 <= k < len(lengths) and lengths[k] not in tried]
        scores = {}
        for k in near:
            if bins(best) > bound and len(tried) < dives and work.left > 0:
                scores[k] = dive(lengths[k])
        if scores and min(scores.values()) <= bins(best):
            centre = min(scores, key=lambda k: (scores[k], -k))
        if step == 1:
            break
    return best


@dataclass
class Plan:
    """Where the r-th piece of a length goes: runs of ranks, by length."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(patterns: list[Pattern]) -> Plan:
        rank: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for times, items in patterns:
            at = 0
            for x in items:
                runs.setdefault(x, []).append((rank.get(x, 0), base, at))
                rank[x] = rank.get(x, 0) + times
                at += x
            base += times
        return Plan({x: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for x, rows in runs.items()})

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and rank."""
        sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        edges = np.nonzero(np.diff(length[order]))[0] + 1
        for at in np.split(order, edges) if len(order) else ():
            first, base, place = self.runs[int(length[at[0]])]
            k = np.searchsorted(first, rank[at], side="right") - 1
            sequence[at], offset[at] = base[k] + rank[at] - first[k], place[k]
        return sequence, offset


#: Tables of first ranks up to this size are sent to all tasks; larger ones are joined by a shuffle.
SENT_BYTES = 32 << 20


def ranked(staged: DataFrame, capacity: int) -> DataFrame:
    """Add ``rank``, a piece's place among all of its length: the tasks' counts, summed up in the order of tasks.

    A task's first ranks are one array by length.  All of them take
    8 * capacity bytes a task; whether that is sent or shuffled goes by it.
    """
    each = staged.groupBy("part", "length").agg(F.count("*").alias("k"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = each.select("part", "length", F.coalesce(F.sum("k").over(before), F.lit(0)).cast("long").alias("first"))

    def by_length(table: pa.Table) -> pa.Table:
        firsts = np.zeros(capacity + 1, dtype=np.int64)
        firsts[table.column("length").to_numpy()] = table.column("first").to_numpy()
        return pa.table({"part": table.column("part").slice(0, 1), "firsts": pa.array([firsts], pa.list_(pa.int64()))})

    firsts = first.groupBy("part").applyInArrow(by_length, "part int, firsts array<long>")
    if staged.select("part").distinct().count() * 8 * capacity <= SENT_BYTES:
        firsts = F.broadcast(firsts)
    return staged.join(firsts, "part").withColumn("rank", F.get("firsts", F.col("length")) + F.col("place")).drop("firsts")


def assign(staged: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length``, ``part``, ``place`` and any others).

    The driver gets one count for each length, at most ``capacity`` of them.
    """
    counts = {r["length"]: r["k"] for r in staged.groupBy("length").agg(F.count("*").alias("k")).collect()}
    plan = Plan.of(solve(counts, capacity))
    shared = staged.sparkSession.sparkContext.broadcast(plan)
    ready = ranked(staged, capacity)
    fields = [f for f in ready.schema.fields if f.name != "rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.places(batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy())
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ready.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, scratch: Scratch, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids and places: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    A row of ``docs`` (doc_id, text) gives at least one piece: its ids and the
    end id; null text counts as empty.  Rows are packed one by one, so repeated
    rows, null or repeated doc_ids each get their own pieces.  An empty table
    gives no rows; other columns are left out, so their names don't matter.
    """
    return assign(scratch.stage(pieces(docs, tokenizer_path, capacity, end_id)), capacity).drop("part", "place")


def digests(docs: DataFrame, scratch: Scratch, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The same with ``ids_crc32`` (long) instead of the ids; only numbers are written and shuffled."""
    staged = scratch.stage(pieces(docs, tokenizer_path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return assign(staged, capacity).drop("part", "place")
