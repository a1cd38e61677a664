"""Sources mixed to target weights by entropy balancing, in DataFrame operations alone.

Every source has a target in words.  Among all rates of its documents that
reach the target and are at most ``most``, those with the least relative
entropy to one copy of each are exponentially tilted by size,
``rate = min(most, exp(lambda * size))``.  A source's ``lambda`` solves the
convex dual, whose gradient is words taken less target: Newton steps inside a
bracket, each one join and one aggregate over (source, size) cells, for all
sources at once.  Rates become whole copies cell by cell, from long to short
documents; what a source then misses is made up by cells of about that size.

Sums of reals are of decimals, whose order does not matter, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words asked for in all, as a part of those there are, and the most copies of a document.
SHARE, MOST = 1.5, 2
TOLERANCE, NEWTON_STEPS = 1e-7, 80
#: Rounds in which what is missed is made up; each leaves less than before.
REPAIRS = 12
#: Sub-groups of a cell's rows for numbering, so that a cell with a third of all rows is no single task.
BUCKETS = 1024


def _number(value: Column) -> Column:
    """A sum of reals that does not depend on their order."""
    return F.sum(value.cast("decimal(28,12)")).cast("double")


def _key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit("")))


def _sources(cells: DataFrame, scratch: Scratch, weights: tuple[int, ...]) -> DataFrame:
    """(key, words, longest, shortest, weight) of each source; weights repeat in the order of keys.

    Places come from sorted partitions and the number of rows in each, of which the driver gets one number a partition.
    """
    by_key = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("size").alias("longest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"))
    placed = scratch.stage(by_key.orderBy("key").withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, so_far = {}, 0
    for r in placed.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():
        before[r["part"]], so_far = so_far, so_far + r["count"]
    offsets = F.create_map(*[F.lit(x) for k, v in (before or {0: 0}).items() for x in (k, v)])
    place = offsets[part.cast("int")] + row
    return placed.select("key", "words", "longest", "shortest", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double").alias("weight"))


def _targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """With ``target``: ``share`` of all words by weight, none above ``most`` times a source's words, the excess dealt again by weight.

    Each round sends two sums to the driver: what full sources take and the weight of the others.
    """
    cap, weight = F.col("words").cast("double") * F.lit(float(most)), F.col("weight")
    total, all_weight = sources.agg(F.sum(F.col("words").cast("double")), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    level = share * total / all_weight
    while True:
        full = F.lit(level) * weight >= cap
        taken, open_weight = sources.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, weight))).first()
        then = (share * total - (taken or 0.0)) / open_weight if open_weight else level
        if then <= level:
            break
        level = then
    return sources.withColumn("target", F.least(F.lit(level) * weight, cap))


def rate(most: int = MOST) -> Column:
    """Copies of a document by its size and its source's ``lam``; a source whose target is all it can give has the most of each."""
    tilted = F.exp(F.least(F.col("lam") * F.col("size") / F.col("longest"), F.lit(math.log(most))))
    return F.when(F.col("target") >= F.col("words") * F.lit(float(most)), F.lit(float(most))).otherwise(F.least(tilted, F.lit(float(most))))


def _tilts(cells: DataFrame, sources: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``sources`` with ``lam``, so that tilted rates give each its target.

    ``lam`` is by size as a part of the source's longest.  It lies between the
    value at which the shortest document alone would lower all words enough and
    that at which it has the most copies; a Newton step of the logarithm of the
    words that leaves this bracket, which each step narrows, is a bisection.
    """
    ratio = F.col("longest") / F.col("shortest")
    low = F.least(F.log(F.col("target") / F.col("words")), F.lit(0.0)) * ratio
    state = sources.where("words > 0").withColumns({"lo": low, "hi": F.lit(math.log(most)) * ratio, "lam": F.lit(0.0), "miss": F.lit(1.0)})
    state = scratch.stage(state)
    x = F.col("size") / F.col("longest")
    steep = F.when(F.col("lam") * x < F.lit(math.log(most)), F.col("n") * F.col("size") * x * rate(most)).otherwise(0.0)
    kept = ["key", "words", "longest", "shortest", "weight", "target", "lo", "hi", "lam"]
    for _ in range(NEWTON_STEPS):
        sums = cells.join(state.drop("miss"), "key").groupBy(*kept).agg(_number(F.col("n") * F.col("size") * rate(most)).alias("got"), _number(steep).alias("slope"))
        above = F.col("got") > F.col("target")
        sums = sums.withColumns({"lo": F.when(above, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(above, F.col("lam")).otherwise(F.col("hi")), "miss": F.abs(F.col("got") / F.col("target") - 1)})
        newton = F.col("lam") - F.log(F.greatest(F.col("got"), F.lit(1e-9)) / F.col("target")) * F.greatest(F.col("got"), F.lit(1e-9)) / F.when(F.col("slope") > 0, F.col("slope"))
        step = F.when(newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        then = scratch.stage(sums.select(*kept[:-1], F.when(F.col("miss") <= TOLERANCE, F.col("lam")).otherwise(step).alias("lam"), "miss"))
        scratch.drop(state)
        state = then
        if not (state.agg(F.max("miss")).first()[0] or 0) > TOLERANCE:
            break
    return state


def _repaired(cells: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``copies`` of cells changed until no cell's size brings its source nearer to the target.

    Each round changes one cell of a source, that whose size is nearest to
    what is missed or too much, by as many copies as go into it.
    """
    for _ in range(REPAIRS):
        off = cells.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off")).withColumn("miss", F.abs("off"))
        room = F.when(F.col("off") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.col("miss")) & (room > 0)
        count = F.least(room, F.greatest(F.lit(1), F.floor(F.col("miss") / F.col("size"))).cast("long"))
        change = F.when(F.col("off") > 0, count).otherwise(-count)
        best = F.min(F.struct(F.abs(F.col("miss") - F.col("size")), F.col("size"), change.alias("change"))).alias("best")
        picks = scratch.stage(cells.join(off, "key").where(fits).groupBy("key").agg(best).select("key", F.col("best.size").alias("size"), F.col("best.change").alias("change")))
        if picks.isEmpty():
            return cells
        then = scratch.stage(cells.join(picks, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).select(*cells.columns))
        scratch.drop(cells)
        cells = then
    return cells


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken`` of each row of ``docs`` (doc_id, text, source).

    Size: words of the text (null: none).  ``taken`` is ``copies`` times size,
    at most ``most`` times.  A source's taken words differ from its target by
    less than its shortest document that can still change, or as much as
    ``REPAIRS`` rounds leave.  A null source is one like any other, the last
    in order; null and repeated doc_ids are rows of their own.  Documents
    without words have taken 0; a source of none, or a table of none, has
    target 0; an empty table gives no rows.  Rows of one source and size are
    told apart by a hash of doc_id and text; those equal in it by doc_id,
    beyond which they are alike.  Other columns are left out, so their names
    don't matter.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        _key(source).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.crc32(F.coalesce(text, F.lit("")))), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    rows = scratch.stage(rows)
    cells = scratch.stage(rows.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = scratch.stage(_targets(_sources(cells, scratch, weights), share, most))
    tilts = _tilts(cells, sources, scratch, most)

    order = Window.partitionBy("key").orderBy(F.desc("size"))
    rated = cells.join(sources.select("key", "words", "longest", "target"), "key").join(tilts.select("key", "lam"), "key", "left").withColumn("rate", F.coalesce(rate(most), F.lit(1.0)))
    # A source's distinct sizes are few beside its words (their sum is at most these), so this window holds no rows of documents.
    so_far = rated.withColumn("so_far", F.sum(F.col("n") * F.col("rate")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = so_far.withColumn("copies", (F.floor(F.col("so_far") + 0.5) - F.floor(F.lag("so_far", 1, 0.0).over(order) + 0.5)).cast("long"))
    whole = whole.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * most)).cast("long"))
    cells = _repaired(scratch.stage(whole.select("key", "size", "n", "words", "target", "rate", "copies")), scratch, most)

    # Of a cell's n rows, copies % n have one copy more than the others: the first ones by bucket and doc_id.
    buckets = rows.groupBy("key", "size", "bucket").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    places = buckets.select("*", F.coalesce(before, F.lit(0)).alias("before")).join(cells, ["key", "size"]).drop("k")
    inside = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("doc_id"))
    out = rows.withColumn("inside", inside).join(places, ["key", "size", "bucket"])
    base = F.floor(F.col("copies") / F.col("n")).cast("long")
    more = F.when(F.col("before") + F.col("inside") <= F.col("copies") - base * F.col("n"), 1).otherwise(0)
    out = out.withColumn("copies", (base + more).cast("long"))
    return out.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", F.col("copies").cast(T.IntegerType()).alias("copies"), (F.col("copies") * F.col("size")).alias("taken"))
