"""Counting of pretokens and of pairs of symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schemes import DEFAULT, pretokens
from ..shipping import ship
from .scan import split_added
from .slices import lengths, slices


def pretoken_counts(df: DataFrame, text: str = "text", scheme: str = DEFAULT, weight: str | None = None) -> DataFrame:
    """(pretoken, cnt): how often each piece occurs; ``weight`` counts a document so many times."""
    size = F.lit(1) if weight is None else F.col(weight)
    flat = df.select(F.explode(pretokens(F.col(text), scheme)).alias("pretoken"), size.cast("long").alias("_w"))
    return flat.groupBy("pretoken").agg(F.sum("_w").alias("cnt"))


def pretoken_rows(df: DataFrame, key: str, text: str = "text", scheme: str = DEFAULT) -> DataFrame:
    """(key, pos, pretoken): the pieces of each document in order."""
    return df.select(key, F.posexplode(pretokens(F.col(text), scheme)).alias("pos", "pretoken"))


#: Pieces of one batch that ``pretoken_spans`` sends back.
SPANS = 1 << 16


def pretoken_spans(df: DataFrame, key: str, text: str = "text", scheme: str = DEFAULT, added: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, byte_start, byte_end, pretoken, added): the pieces of each document in order, with their places in its UTF-8.

    Literals of ``added`` are pieces of their own, the longest that begins
    furthest left; what lies between them is split by the scheme.  Pieces tile
    the text.  The splits are Spark's; their lengths are summed in numpy over a
    batch at a time.  Null and empty texts have no piece; null keys stay.
    """
    ship(df.sparkSession)
    if added:
        own = F.array(*map(F.lit, sorted(set(added))))
        pieces = F.flatten(F.transform(split_added(F.col(text), list(added)), lambda part: F.when(F.array_contains(own, part), F.array(F.struct(part.alias("p"), F.lit(True).alias("a")))).otherwise(F.transform(pretokens(part, scheme), lambda p: F.struct(p.alias("p"), F.lit(False).alias("a"))))))
    else:
        pieces = F.transform(pretokens(F.col(text), scheme), lambda p: F.struct(p.alias("p"), F.lit(False).alias("a")))
    names = [key, "pos", "byte_start", "byte_end", "pretoken", "added"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lists = batch.column(1)
            flat, rows = lists.flatten(), np.repeat(np.arange(len(lists)), lengths(lists))
            row = pa.array(rows)
            words = flat.field(0)
            ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
            first = np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) if len(rows) else rows
            starts = np.concatenate([[0], ends[:-1]])[: len(rows)].astype(np.int64)
            base = starts[begin]
            columns = [batch.column(0).take(row), pa.array((np.arange(len(rows)) - begin).astype(np.int32)), pa.array(starts - base), pa.array(ends - base), words, flat.field(1)]
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            for k in range(0, len(rows), SPANS):
                yield whole.slice(k, SPANS)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pieces.alias("_pieces")).mapInArrow(work, f"`{key}` {kind}, pos int, byte_start long, byte_end long, pretoken string, added boolean")


def pair_counts(words: DataFrame, symbols: str = "symbols", count: str = "cnt") -> DataFrame:
    """(left, right, cnt): how often two symbols stand side by side, each word counted ``count`` times; overlaps count."""
    n = F.size(symbols)
    pairs = F.when(n > 1, F.zip_with(F.slice(symbols, F.lit(1), n - 1), F.slice(symbols, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("left"), b.alias("right"))))
    flat = words.select(F.explode(pairs).alias("p"), F.col(count).alias("_n")).select("p.left", "p.right", "_n")
    return flat.groupBy("left", "right").agg(F.sum("_n").alias("cnt"))
