"""Hard negatives by inner product, from sort-tile-recursive R-trees of bounded size.

Rows are sorted by label and first coordinates over all tasks, and each run of
``TREE_ROWS`` becomes one tree, packed by sort-tile-recursion over the label
and all coordinates.  A node's minimum bounding box gives, coordinate by
coordinate, an interval of each anchor's inner product with what it holds.

Anchors meet trees in blocks: a task has some anchors and a share of the
trees, one at a time.  A best-first queue takes the node with the largest
bound of any anchor that may still want it; an anchor wants a node unless its
box lies outside the anchor's window of scores or labels, or strictly below
the worst of its best k so far.  Leaves that are left are scored exactly.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SCALE, EVERY, MOVED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from 30 to 90 hundredths of the positive's, ends included.
LEAST, MOST = 30, 90
#: Rows of a tree and of a leaf, children of a node, anchors of a block, shares of the trees for a block.
TREE_ROWS, LEAF, FANOUT, BLOCK, SHARES = 2048, 64, 8, 1024, 16
#: Scores are exact in doubles below the first bound, in longs below the second, beyond it in numbers of any size.
EXACT, LARGEST = 1 << 53, 1 << 59
NOTHING = -(1 << 63) + 1
UNFIT = "inner products of these vectors don't fit into a long"
#: Trees of one Arrow batch.
BATCH = 16


# ---------------------------------------------------------------- trees


def str_order(points: np.ndarray, capacity: int) -> np.ndarray:
    """Sort-tile-recursive order: by the first coordinate cut into slabs, each by the next, down to pages of ``capacity``."""
    dims = points.shape[1]

    def tiles(rows: np.ndarray, dim: int) -> list[np.ndarray]:
        pages = -(-len(rows) // capacity)
        if pages <= 1 or dim == dims:
            return [rows]
        rows = rows[np.argsort(points[rows, dim], kind="stable")]
        slabs = int(np.ceil(pages ** (1 / (dims - dim)) - 1e-9))
        size = capacity * -(-pages // slabs)
        return [x for k in range(0, len(rows), size) for x in tiles(rows[k : k + size], dim + 1)]

    return np.concatenate(tiles(np.arange(len(points)), 0))


@dataclass
class Tree:
    """Rows in packed order, and by level, leaves first, the boxes of nodes; a node's children lie side by side."""

    ids: np.ndarray
    rids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    labels_low: list[np.ndarray]
    labels_high: list[np.ndarray]

    @staticmethod
    def packed(ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
        order = str_order(np.column_stack([labels, vectors]), leaf)
        ids, rids, labels, vectors = ids[order], rids[order], labels[order], vectors[order]
        low, high, least, most, step = [], [], [], [], leaf
        below = (vectors, vectors, labels, labels)
        while True:
            starts = np.arange(0, len(below[0]), step)
            below = tuple(f.reduceat(x, starts, axis=0) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), below, strict=True))
            for level, x in zip((low, high, least, most), below, strict=True):
                level.append(x)
            if len(starts) == 1:
                return Tree(ids, rids, labels, vectors, low, high, least, most)
            step = fanout

    def dump(self) -> bytes:
        # Of two's complement, so the least number of a type is no sign that the greatest fits.
        kind = np.result_type(np.int8, *(np.min_scalar_type(-1 - max(x, -1 - x)) for x in (int(self.vectors.min(initial=0)), int(self.vectors.max(initial=0)))))
        out = io.BytesIO()
        lists = {f"{x}{k}": v for x in ("low", "high", "labels_low", "labels_high") for k, v in enumerate(getattr(self, x))}
        lists = {x: v.astype(kind) if x.startswith(("low", "high")) else v for x, v in lists.items()}
        np.savez(out, ids=self.ids, rids=self.rids, labels=self.labels, vectors=self.vectors.astype(kind), **lists)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as f:
            levels = sum(x.startswith("labels_low") for x in f.files)
            lists = [[f[f"{x}{k}"] for k in range(levels)] for x in ("low", "high", "labels_low", "labels_high")]
            return Tree(f["ids"], f["rids"], f["labels"], f["vectors"], *lists)


@dataclass
class Search:
    """Anchors and what they look for: by query its anchor, window, and whether the label must be the anchor's; the best k so far."""

    vectors: np.ndarray
    labels: np.ndarray
    rids: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int

    def __post_init__(self) -> None:
        self.scores = np.full((len(self.anchor), self.k), NOTHING, dtype=np.int64)
        self.found = np.zeros((len(self.anchor), self.k), dtype=np.int64)
        self.leaves = 0

    def over(self, tree: Tree) -> None:
        """Take what the tree has to offer."""
        width = max(self.vectors.shape[1], tree.vectors.shape[1])
        biggest = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
        bound = width * biggest(self.vectors) * biggest(tree.vectors)
        kind = np.float64 if bound < EXACT else np.int64 if bound < LARGEST else object
        if max(biggest(self.vectors), biggest(tree.vectors)) > 1 << 63:
            raise OverflowError(UNFIT)

        def wide(x: np.ndarray) -> np.ndarray:
            return np.pad(x.astype(kind), ((0, 0), (0, width - x.shape[1])))

        anchors = wide(self.vectors)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        heap: list[tuple] = []

        def offer(level: int, nodes: np.ndarray) -> None:
            """Queue those nodes that some query may want, with their intervals."""
            low, high = wide(tree.low[level][nodes]), wide(tree.high[level][nodes])
            least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
            for j, node in enumerate(nodes.tolist()):
                open_, key = self._open(tree, level, node, least[:, j], most[:, j])
                if len(open_):
                    heapq.heappush(heap, (-key.max(), level, node, least[:, j].copy(), most[:, j].copy()))

        offer(len(tree.low) - 1, np.arange(1))
        while heap:
            _, level, node, least, most = heapq.heappop(heap)
            open_, _ = self._open(tree, level, node, least, most)
            if not len(open_):
                continue
            if level:
                offer(level - 1, np.arange(node * FANOUT, min((node + 1) * FANOUT, len(tree.low[level - 1]))))
            else:
                self._score(tree, slice(node * LEAF, (node + 1) * LEAF), open_, anchors, wide)

    def _open(self, tree: Tree, level: int, node: int, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries that may want something of a node, and their bounds."""
        a, b = tree.labels_low[level][node], tree.labels_high[level][node]
        mine = self.labels
        fit = (mine >= a) & (mine <= b) if self.same else ~((mine == a) & (mine == b))
        key = np.minimum(most[self.anchor], self.high)
        wanted = fit[self.anchor] & (most[self.anchor] >= self.low) & (least[self.anchor] <= self.high) & (key >= self.scores[:, -1])
        q = np.flatnonzero(wanted)
        return q, key[q]

    def _score(self, tree: Tree, rows: slice, queries: np.ndarray, anchors: np.ndarray, wide) -> None:
        self.leaves += 1
        of = np.unique(self.anchor[queries])
        scores = np.zeros((len(anchors), len(tree.ids[rows])), dtype=np.int64)
        products = anchors[of] @ wide(tree.vectors[rows]).T
        if products.dtype == object and (abs(products) >= -NOTHING).any():
            raise OverflowError(UNFIT)
        scores[of] = products.astype(np.int64)
        a = self.anchor[queries]
        s, label = scores[a], tree.labels[rows][None, :] == self.labels[a][:, None]
        hit = (s >= np.maximum(self.low, self.scores[:, -1])[queries, None]) & (s <= self.high[queries, None]) & (label == self.same) & (tree.rids[rows][None, :] != self.rids[a][:, None])
        i, j = np.nonzero(hit)
        if not len(i):
            return
        mine = np.unique(queries[i])
        q = np.concatenate([np.repeat(mine, self.k), queries[i]])
        score = np.concatenate([self.scores[mine].ravel(), s[i, j]])
        found = np.concatenate([self.found[mine].ravel(), tree.ids[rows][j]])
        order = np.lexsort((found, -score, q))
        q, score, found = q[order], score[order], found[order]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        best = place < self.k
        self.scores[q[best], place[best]], self.found[q[best], place[best]] = score[best], found[best]


# ---------------------------------------------------------------- tasks


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column) -> np.ndarray:
    """Lists of longs as rows of one width; what is missing at the end counts as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = _sizes(column)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sorted rows (vec_id, rid, label, v) as trees."""
    held, count, trees = [], 0, 0

    def tree(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(x).to_numpy().astype(np.int64) for x in ("vec_id", "rid", "label")]
        number = (TaskContext.get().partitionId() << 32) + trees
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([Tree.packed(*columns, _matrix(table.column("v"))).dump()], pa.binary())], names=["tree", "data"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= TREE_ROWS:
            table = pa.Table.from_batches(held)
            yield tree(table[:TREE_ROWS])
            held, count, trees = table[TREE_ROWS:].to_batches(), count - TREE_ROWS, trees + 1
    if count:
        yield tree(pa.Table.from_batches(held))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's anchors (vec_id, rid, label, v, positive_ids, positive_scores), BLOCK at most to a row."""
    held, count, blocks = [], 0, 0

    def block(table: pa.Table) -> pa.RecordBatch:
        out = io.BytesIO()
        lists = {x: _matrix(table.column(x)) for x in ("v", "positive_ids", "positive_scores")}
        sizes = _sizes(table.column("positive_ids").combine_chunks())
        np.savez(out, **lists, positives=sizes, **{x: table.column(x).to_numpy().astype(np.int64) for x in ("vec_id", "rid", "label")})
        number = (TaskContext.get().partitionId() << 32) + blocks
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([out.getvalue()], pa.binary())], names=["block", "data"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= BLOCK:
            table = pa.Table.from_batches(held)
            yield block(table[:BLOCK])
            held, count, blocks = table[BLOCK:].to_batches(), count - BLOCK, blocks + 1
    if count:
        yield block(pa.Table.from_batches(held))


FOUND = "anchor long, anchor_id long, positive int, positive_id long, positive_score long, found long, score long"


def windows(scores: np.ndarray, least: int = LEAST, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Least and most score s with least * p <= 100 * s <= most * p, for each score p of a positive."""
    # Hundreds apart from the rest, for a product with the whole score may not fit.
    whole, rest = np.divmod(scores, 100)
    return least * whole - (-least * rest) // 100, most * whole + (most * rest) // 100


def _met(same: bool, k: int):
    """A task's rows (block, share, tree, data) in order: each block, with tree null, stands before its trees."""

    def start(data: bytes) -> tuple[Search, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as f:
            a = {x: f[x] for x in f.files}
        n = len(a["rid"])
        if same:
            q, rank, low, high = np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, NOTHING), np.full(n, -NOTHING)
        else:
            q, rank = np.nonzero(np.arange(a["positive_ids"].shape[1])[None, :] < a["positives"][:, None])
            low, high = windows(a["positive_scores"][q, rank])
        return Search(a["v"], a["label"], a["rid"], q, low, high, same, k), a | {"q": q, "rank": rank}

    def rows(search: Search, a: dict[str, np.ndarray]) -> pa.RecordBatch:
        i, j = np.nonzero(search.scores > NOTHING)
        q, rank = a["q"][i], a["rank"][i]
        known = (np.zeros(len(i), dtype=np.int64),) * 2 if same else (a["positive_ids"][q, rank], a["positive_scores"][q, rank])
        arrays = [a["rid"][q], a["vec_id"][q], rank.astype(np.int32), *known, search.found[i, j], search.scores[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "found", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = a = None
        for batch in batches:
            for tree, data in zip(batch.column("tree").to_pylist(), batch.column("data"), strict=True):
                if tree is None:
                    if search is not None:
                        yield rows(search, a)
                    search, a = start(data.as_py())
                else:
                    search.over(Tree.load(data.as_py()))
        if search is not None:
            yield rows(search, a)

    return work


def _search(anchors: DataFrame, trees: DataFrame, n_anchors: int, scratch: Scratch, same: bool, k: int) -> DataFrame:
    """The best k of each query in each share of the trees; anchors in blocks against all trees, one tree at a time."""
    blocks = scratch.stage(anchors.repartition(max(1, -(-n_anchors // BLOCK))).mapInArrow(_blocks, "block long, data binary"))
    numbers = blocks.select("block")
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    # Blocks times shares, and each tree once for each block: anchors are a stated set of queries.
    to_all = trees.select(F.pmod(F.xxhash64("tree"), F.lit(SHARES)).cast("int").alias("share"), "tree", "data")
    pairs = numbers.select("block", shares)
    met = blocks.select("block", shares, F.lit(None).cast("long").alias("tree"), "data").unionByName(pairs.join(to_all, "share").select("block", "share", "tree", "data"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = scratch.spark.conf.get(key)
    scratch.spark.conf.set(key, str(BATCH))
    try:
        return scratch.stage(met.repartition("block", "share").sortWithinPartitions("block", "share", F.col("tree").asc_nulls_first()).mapInArrow(_met(same, k), FOUND))
    finally:
        scratch.spark.conf.set(key, before)


def mine(embeddings: DataFrame, scratch: Scratch) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive of ``embeddings``.

    ``embeddings``: vec_id, embedding, label.  Rows with a null in any of
    these, or a null or non-finite component, take no part.  Vectors of
    several lengths count as filled up with zeros.  Rows with one vec_id are
    rows of their own, each an anchor if the id is divisible by 100; ties of
    score go by vec_id, beyond which results are alike.  Without positives, or
    negatives in the window, there are no rows; an empty table gives none.
    Other columns are left out, so their names don't matter.  Components
    and inner products that don't fit into a long are an error.
    """
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % MOVED == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fit)
    rows = scratch.stage(rows.select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"), F.monotonically_increasing_id().alias("rid")))
    trees = scratch.stage(rows.orderBy("label", F.get("v", F.lit(0)), F.get("v", F.lit(1)), "vec_id").select("vec_id", "rid", "label", "v").mapInArrow(_planted, "tree long, data binary"))

    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    n = anchors.count()
    none = F.lit(None).cast("array<long>")
    found = _search(anchors.select("vec_id", "rid", "label", "v", none.alias("positive_ids"), none.alias("positive_scores")), trees, n, scratch, True, POSITIVES)
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "found"))
    found = found.withColumn("at", best).where(F.col("at") <= POSITIVES)
    positives = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "found", "score"))).alias("p"))
    known = anchors.join(positives, anchors["rid"] == positives["anchor"]).select("vec_id", "rid", "label", "v", F.col("p.found").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    found = _search(scratch.stage(known), trees, n, scratch, False, NEGATIVES)
    best = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "found"))
    out = found.withColumn("rank", best).where(F.col("rank") <= NEGATIVES)
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
