"""The trie of conversation prefixes, as balanced parentheses shard by shard.

A node is a sequence of first turns; its key is a polynomial hash of 128 bits
that a pass over the sorted turns carries along.  Turns that one conversation
alone has are a run and stand in the trie as one leaf.  The paths of all
leaves, sorted, are cut into shards of bounded size.  A shard writes its trie
as parentheses in preorder and answers for its nodes from them: ``findclose``
over a tree of blocks' least excess gives a node's subtree, a rank of ``()``
pairs its leaves, a running sum its savings.

Only nodes on a shard's first or last path, its spines, may go on in another
shard.  For these it passes on what hangs between them, and spines are merged
by the same encoding, round by round, until one shard holds what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Turns of the first conversation of a hundred that another begins with: crc32 of its id modulo this.
HEADS, GROUP = 6, 100
#: Path elements of a shard, and parentheses of a block.
SHARD_NODES, BLOCK = 1 << 17, 64
#: Ids of a node that are joined before they are put in order with others; depths of a run that a row spells out.
PIECE, STRETCH = 1 << 14, 1 << 12
#: Odd factors of the two halves of a key.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEY = ["depth", "a1", "a2"]


# ---------------------------------------------------------------- balanced parentheses


class Parens:
    """Balanced parentheses with a range min-max tree over blocks of excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = max(1, -(-len(bits) // block))
        self.width = 1 << (blocks - 1).bit_length()
        padded = np.full(self.width * block, len(bits) + 1, dtype=np.int64)
        padded[: len(bits)] = self.excess
        self.padded = padded.reshape(self.width, block)
        least, most = [self.padded.min(axis=1)], [self.padded.max(axis=1)]
        while len(least[-1]) > 1:
            least.append(least[-1].reshape(-1, 2).min(axis=1))
            most.append(most[-1].reshape(-1, 2).max(axis=1))
        self.least, self.most = least, most
        self.pairs = np.concatenate([[0], np.cumsum(bits[:-1] & ~bits[1:])]) if len(bits) else np.zeros(1, dtype=np.int64)

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place after it where the excess is one less than at it."""
        goal = self.excess[at] - 1
        out = np.full(len(at), -1, dtype=np.int64)
        mine = at // self.block
        for lo in range(0, len(at), 1 << 14):  # inside its own block
            part = slice(lo, lo + (1 << 14))
            hit = (self.padded[mine[part]] <= goal[part, None]) & (np.arange(self.block) > (at[part] % self.block)[:, None])
            out[part] = np.where(hit.any(axis=1), mine[part] * self.block + hit.argmax(axis=1), -1)
        left = np.flatnonzero(out < 0)
        # Up the tree until a block to the right of the path falls to the goal, then down to the leftmost that does.
        node, level = mine[left].copy(), np.zeros(len(left), dtype=np.int64)
        todo = np.ones(len(left), dtype=bool)
        for k, low in enumerate(self.least):
            right = np.minimum(node + 1, len(low) - 1)
            found = todo & (node % 2 == 0) & (node + 1 < len(low)) & (low[right] <= goal[left])
            node = np.where(found, node + 1, node)
            level = np.where(found, k, level)
            todo &= ~found
            node = np.where(todo, node // 2, node)
        for k in range(len(self.least) - 1, 0, -1):
            down = level == k
            first = self.least[k - 1][np.minimum(2 * node, len(self.least[k - 1]) - 1)] <= goal[left]
            node = np.where(down, 2 * node + ~first, node)
            level = np.where(down, k - 1, level)
        for lo in range(0, len(left), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            hit = self.padded[node[part]] <= goal[left[part], None]
            out[left[part]] = node[part] * self.block + hit.argmax(axis=1)
        return out

    def leaf_pairs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Pairs ``()`` that begin from ``first`` to before ``last``."""
        return self.pairs[last] - self.pairs[first]


@dataclass
class Paths:
    """Sorted paths from the root; each element is a node with what it brings along from earlier rounds."""

    offsets: np.ndarray
    a1: np.ndarray
    a2: np.ndarray
    n: np.ndarray
    conv: np.ndarray
    weight: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    children: np.ndarray
    #: By path: its run's conversation and last depth; a depth of -1: none.
    tail_conv: np.ndarray
    tail_to: np.ndarray


ELEMENT = "struct<depth:long,a1:long,a2:long,n:long,conv:long,weight:long,leaves:long,saved:long,children:long>"
FIELDS = ("a1", "a2", "n", "conv", "weight", "leaves", "saved", "children")
SHARD = f"kind int, depth long, a1 long, a2 long, conv long, parent long, n long, children long, leaves long, saved long, to long, path array<{ELEMENT}>"
_ELEMENT = pa.struct([(x, pa.int64()) for x in ("depth", *FIELDS)])
_NUMBERS = ("depth", "a1", "a2", "conv", "parent", "n", "children", "leaves", "saved", "to")
_SCHEMA = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in _NUMBERS), ("path", pa.list_(_ELEMENT))])
NODE, RUN, SPINE = 0, 1, 2


def _rows(kind: int, count: int, path=None, **columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(count, kind, dtype=np.int32))]
    arrays += [pa.array(columns[x]) if x in columns else pa.nulls(count, pa.int64()) for x in _NUMBERS]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(count, pa.list_(_ELEMENT)) if path is None else path], schema=_SCHEMA)


def encode(p: Paths, first_round: bool, last_round: bool) -> Iterator[pa.RecordBatch]:
    """One shard: its closed nodes, its runs, and unless it is the last its first and last path."""
    off, size = p.offsets, np.diff(p.offsets)
    m, row = len(size), np.repeat(np.arange(len(size)), size)
    place = np.arange(off[-1]) - off[row]
    before = np.where((row > 0) & (place < size[np.maximum(row - 1, 0)]), off[np.maximum(row - 1, 0)] + place, -1)
    new = (before < 0) | (p.a1[before] != p.a1) | (p.a2[before] != p.a2)
    opened = np.bincount(row[new], minlength=m)
    closed = np.concatenate([[0], size[:-1]]) - (size - opened)
    closed[0] = 0
    tail = (p.tail_to >= 0).astype(np.int64)
    steps = np.stack([closed, opened, tail, tail], axis=1).ravel()
    bits = np.concatenate([np.repeat(np.tile([False, True, True, False], m), steps), np.zeros(size[-1], dtype=bool)])
    parens = Parens(bits)
    opens = parens.opens()
    closes = parens.findclose(opens)

    is_tail = np.repeat(np.tile([False, True], m), np.stack([opened, tail], axis=1).ravel())
    inner, runs = np.flatnonzero(~is_tail), np.flatnonzero(is_tail)
    node = np.full(off[-1], -1, dtype=np.int64)
    node[new] = inner
    order = np.lexsort((row, place))  # an element that is not new is the node of the same depth in the path before
    at = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), -1))
    node[order] = node[order][at]
    last = node[off[1:] - 1]
    parent = np.full(len(opens), -1, dtype=np.int64)
    inside = new & (place > 0)
    parent[node[inside]] = node[np.flatnonzero(inside) - 1]
    parent[runs] = last[p.tail_to >= 0]

    def brought(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(opens), dtype=np.int64)
        np.add.at(out, node, values)
        return out

    weight = np.zeros(len(opens), dtype=np.int64)
    weight[inner] = p.weight[new]
    end = np.arange(len(opens)) + (closes - opens + 1) // 2

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[np.arange(len(opens))]

    saved = below(weight + brought(p.saved))
    leaves = below(brought(p.leaves)) + (parens.leaf_pairs(opens, closes) if first_round else 0)
    children = np.bincount(parent[parent >= 0], minlength=len(opens)) + brought(p.children)

    spine = np.zeros(len(opens), dtype=bool)
    ends = [node[off[0] : off[1]], node[off[-2] : off[-1]]]
    if not last_round:
        spine[ends[0]] = spine[ends[1]] = True
    source = np.full(len(opens), -1, dtype=np.int64)
    source[inner] = np.flatnonzero(new)
    done = np.flatnonzero(~is_tail & ~spine)
    e = source[done]
    above = np.where(parent[done] >= 0, p.conv[source[np.maximum(parent[done], 0)]], -1)
    yield _rows(NODE, len(done), depth=place[e], a1=p.a1[e], a2=p.a2[e], conv=p.conv[e], parent=pa.array(above, mask=parent[done] < 0), n=p.n[e], children=children[done], leaves=leaves[done], saved=saved[done])
    with_run = p.tail_to >= 0
    if with_run.any():
        yield _rows(RUN, len(runs), depth=size[with_run], conv=p.tail_conv[with_run], parent=p.conv[source[last[with_run]]], to=p.tail_to[with_run])
    if last_round:
        return
    joint = np.flatnonzero(spine & (parent >= 0))
    between = {"leaves": leaves.copy(), "saved": saved - weight, "children": children}
    np.subtract.at(between["leaves"], parent[joint], leaves[joint])
    np.subtract.at(between["saved"], parent[joint], saved[joint])
    np.subtract.at(between["children"], parent[joint], 1)
    paths = [ends[0]] if m == 1 else ends
    nodes = np.concatenate(paths)
    once = np.ones(len(nodes), dtype=np.int64)
    once[len(ends[0]) :] = ~np.isin(nodes[len(ends[0]) :], ends[0])
    at = source[nodes]
    values = [place[at], p.a1[at], p.a2[at], p.n[at], p.conv[at], p.weight[at], *(between[x][nodes] * once for x in ("leaves", "saved", "children"))]
    elements = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields=list(_ELEMENT))
    yield _rows(SPINE, len(paths), path=pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, paths)]), pa.int32()), elements, type=pa.list_(_ELEMENT)))


def _encoded(first_round: bool, last_round: bool, most: int = SHARD_NODES):
    """A task's sorted rows (path, conv, to), cut into shards of about ``most`` elements; a last round is one shard."""

    def joined(held: list[pa.RecordBatch]) -> Paths:
        table = pa.Table.from_batches(held).combine_chunks()
        path = table.column("path").combine_chunks()
        path = path.chunk(0) if isinstance(path, pa.ChunkedArray) else path
        sizes = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = path.flatten()
        columns = {x: flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in FIELDS}
        return Paths(np.concatenate([[0], np.cumsum(sizes)]), **columns, tail_conv=table.column("conv").to_numpy().astype(np.int64), tail_to=table.column("to").to_numpy().astype(np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            count += len(batch.column("path").flatten())
            if count >= most and not last_round:
                yield from encode(joined(held), first_round, last_round)
                held, count = [], 0
        if held:
            yield from encode(joined(held), first_round, last_round)

    return work


# ---------------------------------------------------------------- keys of prefixes


MASK = (1 << 64) - 1
_SEQUENCE = "conv long, depth long, a1 long, a2 long, chars long, part int, own long, kind int, h int"
_TYPES = {"conv": pa.int64(), "depth": pa.int64(), "a1": pa.int64(), "a2": pa.int64(), "chars": pa.int64(), "part": pa.int32(), "own": pa.int64(), "kind": pa.int32(), "h": pa.int32()}
#: Kinds of rows: a conversation's root, a turn of its group's first one, one of its own; how a task ends.
ROOT, HEAD, OWN, LAST = 0, 1, 2, 9


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _sequence(rows: list[tuple]) -> pa.RecordBatch:
    columns = dict(zip(_TYPES, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([_signed(v) if x in ("a1", "a2") else pa.array(v, _TYPES[x]) for x, v in columns.items()], names=list(_TYPES))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth and key of each kept turn of a task's sorted rows (conv, kind, t1, t2, chars, h).

    A conversation that began in an earlier task is numbered and hashed from
    where this task begins, with nothing dropped and ``part`` set (else -1);
    a row of kind LAST says how the task ends.
    """
    here, conv, part = TaskContext.get().partitionId(), None, -1
    depth = own = a1 = a2 = h = 0
    for batch in batches:
        rows = []
        for c, kind, t1, t2, chars, h in zip(*(batch.column(x).to_pylist() for x in ("conv", "kind", "t1", "t2", "chars", "h")), strict=True):
            if c != conv:
                part = here if conv is None and kind != ROOT else -1
                conv, own, a1, a2, depth = c, 0, 0, 0, 0 if part >= 0 else -1
            own += kind == OWN
            if kind == OWN and own <= h and part < 0:
                continue
            depth, a1, a2 = depth + 1, (a1 * FACTORS[0] + t1) & MASK, (a2 * FACTORS[1] + t2) & MASK
            rows.append((c, depth, a1, a2, chars, part, own if kind == OWN else 0, kind, h))
        if rows:
            yield _sequence(rows)
    if conv is not None:
        yield _sequence([(conv, depth, a1, a2, int(part >= 0), here, own, LAST, h)])


@dataclass
class Joint:
    """What a task has to know of a conversation that began in earlier ones."""

    heads: int
    dropped: int
    depth: int
    before: tuple[int, int]
    at_heads: tuple[int, int]
    at_dropped: tuple[int, int]

    def place(self, depth: int, a1: int, a2: int) -> tuple[int, int, int]:
        """Depth and key in the whole conversation, by those counted from where the task begins."""
        if depth <= self.heads:
            keys = [(b * pow(f, depth, MASK + 1) + a) & MASK for b, f, a in zip(self.before, FACTORS, (a1, a2), strict=True)]
            return self.depth + depth, *keys
        gone, since = self.heads + self.dropped, depth - self.heads - self.dropped
        keys = []
        for b, f, a, q, d in zip(self.before, FACTORS, (a1, a2), self.at_heads, self.at_dropped, strict=True):
            step = pow(f, since, MASK + 1)
            keys.append((b * pow(f, depth - self.dropped, MASK + 1) + (q - d) * step + a) & MASK)
        return self.depth + depth - gone + self.heads, *keys


def _joints(edges: list) -> dict[int, Joint]:
    """By task: rows of kind LAST of all tasks and the first rows of those that begin inside a conversation, in order."""
    parts: dict[int, list] = {}
    for r in edges:
        parts.setdefault(r["part"], []).append(r)
    found, state = {}, None
    for part in sorted(parts):
        last = next(r for r in parts[part] if r["kind"] == LAST)
        first = sorted((r for r in parts[part] if r["kind"] != LAST), key=lambda r: r["depth"])
        joint = None
        if first:
            conv, own, depth, keys = state
            heads = [r for r in first if r["kind"] != OWN]
            mine = [r for r in first if r["kind"] == OWN]
            dropped = min(max(first[0]["h"] - own, 0), len(mine))
            at = [(r["a1"] & MASK, r["a2"] & MASK) for r in [*heads, *mine]]
            at_heads = at[len(heads) - 1] if heads else (0, 0)
            joint = found[part] = Joint(len(heads), dropped, depth, keys, at_heads, at[len(heads) + dropped - 1] if dropped else at_heads)
        if last["chars"] and joint is not None:
            depth = max(last["depth"], joint.heads + joint.dropped)
            keys = (last["a1"] & MASK, last["a2"] & MASK) if depth > joint.heads + joint.dropped or not joint.dropped else joint.at_heads
            whole = joint.place(depth, *keys) if depth > joint.heads + joint.dropped or not joint.dropped else joint.place(joint.heads, *joint.at_heads)
            state = (last["conv"], state[1] + last["own"], whole[0], whole[1:])
        else:
            state = (last["conv"], last["own"], last["depth"], (last["a1"] & MASK, last["a2"] & MASK))
    return found


def _rejoined(joints: dict[int, Joint]):
    """Rows of tasks that begin inside a conversation, with their depth and key in the whole of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, depth, a1, a2, chars, part in zip(*(batch.column(x).to_pylist() for x in ("conv", "depth", "a1", "a2", "chars", "part")), strict=True):
                joint = joints[part]
                if not joint.heads < depth <= joint.heads + joint.dropped:
                    rows.append((conv, *joint.place(depth, a1 & MASK, a2 & MASK), chars))
            if rows:
                conv, depth, a1, a2, chars = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), _signed(a1), _signed(a2), pa.array(chars, pa.int64())], names=["conv", "depth", "a1", "a2", "chars"])

    return work


def keyed(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, a1, a2, chars) of each rebuilt turn, and of each conversation's root at depth 0.

    One sort of all turns, by id and order; no task needs a whole conversation.
    The driver gets a few rows for each task.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    half = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "t1"), (17, "t2"))]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    rows = scratch.stage(rows.where("conv is not null").select("conv", "turn", "role", *half, "chars"))

    order = ["turn", "role", "t1", "t2"]
    convs = rows.select("conv").distinct().withColumn("h", (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int"))
    firsts = rows.where(F.col("conv") % GROUP == 0).withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).where(F.col("at") < HEADS)
    firsts = firsts.select(F.col("conv").alias("base"), "at", "t1", "t2", "chars")
    heads = convs.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(firsts, "base").where("at <= h")
    none = F.lit("")
    whole = (
        convs.select("conv", F.lit(ROOT).alias("kind"), F.lit(0).cast("long").alias("turn"), none.alias("role"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("chars"), "h")
        .union(heads.select("conv", F.lit(HEAD), F.col("at").cast("long"), none, "t1", "t2", "chars", "h"))
        .union(rows.select("conv", F.lit(OWN), "turn", "role", "t1", "t2", "chars", (F.crc32(F.col("conv").cast("string")) % HEADS).cast("int")))
    )
    found = scratch.stage(whole.orderBy("conv", "kind", *order).drop("turn", "role").mapInArrow(_numbered, _SEQUENCE))
    edges = found.where(f"kind = {LAST} or part >= 0 and (kind <> {OWN} or own < {HEADS})").collect()
    joints = _joints(edges)
    columns = ["conv", "depth", "a1", "a2", "chars"]
    out = found.where(f"kind <> {LAST} and part < 0").select(*columns)
    return scratch.stage(out.union(found.where(f"kind <> {LAST} and part >= 0").select(*columns, "part").mapInArrow(_rejoined(joints), "conv long, depth long, a1 long, a2 long, chars long"))) if joints else out


# ---------------------------------------------------------------- ends


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal nodes in a task's sorted rows (depth, a1, a2, conv) as joined ids, each of at most PIECE."""
    key, ids = None, []

    def piece() -> tuple:
        return (*key, ids[0], ",".join(map(str, ids)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[*KEY, "first", "ids"])

    for batch in batches:
        rows = []
        for *k, conv in zip(*(batch.column(x).to_pylist() for x in (*KEY, "conv")), strict=True):
            if k != key or len(ids) == PIECE:
                if ids:
                    rows.append(piece())
                key, ids = k, []
            ids.append(conv)
        if rows:
            yield batch_of(rows)
    if ids:
        yield batch_of([piece()])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, one piece held at a time."""
    key, digest = None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[*KEY, "sha"])

    for batch in batches:
        rows = []
        for *k, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
            if k != key:
                if key is not None:
                    rows.append((*key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if rows:
            yield batch_of(rows)
    if key is not None:
        yield batch_of([(*key, digest.hexdigest())])


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, a1, a2, sha): the digest of the ids that end at each node, in ascending order."""
    kinds = "depth long, a1 long, a2 long"
    pieces = ends.orderBy(*KEY, "conv").mapInArrow(_pieces, f"{kinds}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digested, f"{kinds}, sha string")


# ---------------------------------------------------------------- nodes


def _closed(leaves: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, runs) of sorted paths: a first round over all leaves, then rounds over spines until one shard holds them."""
    found = scratch.stage(leaves.orderBy("path", "conv").mapInArrow(_encoded(True, False, most), SHARD))
    nodes, runs = found.where(f"kind = {NODE}"), found.where(f"kind = {RUN}")
    while True:
        spines = found.where(f"kind = {SPINE}").select("path", F.lit(0).cast("long").alias("conv"), F.lit(-1).cast("long").alias("to"))
        total, longest = spines.agg(F.sum(F.size("path")), F.max(F.size("path"))).first()
        if not total:
            return nodes, runs
        bound = max(most, 16 * longest)
        last = total <= bound
        dealt = spines.repartition(1).sortWithinPartitions("path") if last else spines.repartitionByRange(-(-total // bound), "path").sortWithinPartitions("path")
        found = scratch.stage(dealt.mapInArrow(_encoded(False, last, bound), SHARD))
        nodes = nodes.union(found.where(f"kind = {NODE}"))


def nodes(conversations: DataFrame, scratch: Scratch, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    ``conversations``: conv_id, turn, role, text; rows without a conv_id take
    no part, a null turn comes first, null role and text are empty.  Turns of
    one number are ordered by role, then by a digest of role and text;
    repeated rows are turns of their own.  Other columns are left out, so
    their names don't matter.  An empty table gives no rows.  Prefixes are
    told apart by 120 bits.  A task holds a shard of ``shard_nodes`` path
    elements, or one path, of the turns that two conversations or more share,
    if that is longer.
    """
    turns = keyed(conversations, scratch)
    deep = turns.where("depth > 0")
    shared = scratch.stage(deep.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("first"), F.max("chars").alias("long")).where("n > 1"))
    zero = F.lit(0).cast("long")

    def element(depth: Column, a1: Column, a2: Column, n: Column, conv: Column, weight: Column) -> Column:
        return F.struct(depth.alias("depth"), a1.alias("a1"), a2.alias("a2"), n.alias("n"), conv.alias("conv"), weight.alias("weight"), *(zero.alias(x) for x in ("leaves", "saved", "children")))

    step = F.when(F.col("n").isNotNull(), element(F.col("depth"), F.col("a1"), F.col("a2"), F.col("n"), F.col("first"), (F.col("n") - 1) * F.col("long")))
    steps = deep.join(shared, KEY, "left").select("conv", "depth", step.alias("step"))
    roots = turns.where("depth = 0").select("conv", "depth", F.lit(None).cast(steps.schema["step"].dataType).alias("step"))
    # Of a conversation's turns only those that it shares come together; its own run is a number.
    whole = scratch.stage(steps.union(roots).groupBy("conv").agg(F.max("depth").alias("to"), F.sort_array(F.collect_list("step")).alias("path")))
    count, least = whole.agg(F.count("*"), F.min("conv")).first()
    if not count:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return scratch.spark.createDataFrame([], empty)
    root = element(zero, zero, zero, F.lit(count).cast("long"), F.lit(least).cast("long"), zero)
    whole = whole.select("conv", "to", F.concat(F.array(root), F.col("path")).alias("path"))
    tip = F.element_at("path", -1)
    alone = whole.where(F.col("to") < F.size("path")).select("conv", "path", *(tip[x].alias(x) for x in (*KEY, "n")), tip["conv"].alias("first"))
    # A node where all its members end is a leaf, too; its least member stands for it.
    all_end = alone.groupBy(*KEY, "n").agg(F.count("*").alias("k")).where("k = n").select(*KEY)
    leaves = whole.where(F.col("to") >= F.size("path")).select("path", "conv", "to").union(alone.where("conv = first").join(all_end, KEY, "left_semi").select("path", "conv", F.lit(-1).cast("long").alias("to")))
    closed, runs = _closed(leaves, scratch, shard_nodes)
    ended = closed.join(_ends(alone.select(*KEY, "conv")), KEY, "left")
    nothing = F.sha2(F.lit(""), 256)
    found = ended.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"))

    parts = runs.select("conv", "parent", "depth", "to", F.explode(F.sequence("depth", "to", F.lit(STRETCH).cast("long"))).alias("at"))
    each = parts.select("conv", "parent", "depth", "to", F.explode(F.sequence("at", F.least(F.col("at") + STRETCH - 1, F.col("to")))).alias("at"))
    one = F.lit(1).cast("long")
    own = each.select(F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"), (F.col("at") < F.col("to")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("at") == F.col("to"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return found.union(own)
