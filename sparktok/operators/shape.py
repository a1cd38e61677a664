"""Shapes of encoded batches: truncated, wrapped, padded, packed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import key_block


def _array(ids) -> Column:
    return F.array(*(F.lit(int(i)) for i in ids)).cast("array<int>")


def truncate(ids: Column, most: int, left: bool = False) -> Column:
    """At most so many ids: the first, or with ``left`` the last."""
    if most < 0:
        raise ValueError("a length can't be negative")
    if most == 0:
        return _array(())
    return F.slice(ids, F.greatest(F.size(ids) - most, F.lit(0)) + 1, F.lit(most)) if left else F.slice(ids, 1, most)


def wrap(ids: Column, prefix=(), suffix=(), max_tokens: int | None = None, truncate_left: bool = False) -> Column:
    """Prefix, ids, suffix; ``max_tokens`` counts the ids alone."""
    inner = ids if max_tokens is None else truncate(ids, max_tokens, truncate_left)
    return F.concat(_array(prefix), inner, _array(suffix))


@dataclass(frozen=True)
class Padding:
    """How rows become a rectangle."""

    pad_id: int
    max_length: int | None = None
    pad_to_max_length: bool = False
    truncate: bool = False
    pad_left: bool = False
    truncate_left: bool = False
    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()

    @property
    def room(self) -> int | None:
        """Ids that a row may have beside prefix and suffix."""
        if self.max_length is None:
            if self.truncate or self.pad_to_max_length:
                raise ValueError("max_length is missing")
            return None
        room = self.max_length - len(self.prefix) - len(self.suffix)
        if room < 0:
            raise ValueError("prefix and suffix are longer than max_length")
        return room


def pad(df: DataFrame, rule: Padding, ids: str = "ids") -> DataFrame:
    """``df`` with rows of one width in ``ids``, and ``length`` and ``mask``.

    Width: ``max_length`` with ``pad_to_max_length``; nothing runs then, and a
    longer row is an error when it is met.  Else the longest row, which one
    aggregate finds at once; if that is longer than ``max_length``, it is an
    error here.
    """
    room = rule.room
    inner = truncate(F.col(ids), room, rule.truncate_left) if rule.truncate else F.col(ids)
    wrapped = df.withColumn(ids, F.concat(_array(rule.prefix), inner, _array(rule.suffix))).withColumn("length", F.size(ids).cast("long"))
    if rule.pad_to_max_length:
        width = rule.max_length
        if not rule.truncate:
            message = F.concat(F.lit("a row has "), F.col("length").cast("string"), F.lit(f" tokens, max_length is {width}"))
            wrapped = wrapped.withColumn("length", F.when(F.col("length") > width, F.raise_error(message).cast("long")).otherwise(F.col("length")))
    else:
        width = wrapped.agg(F.max("length")).first()[0] or 0
        if rule.max_length is not None and width > rule.max_length:
            raise ValueError(f"a row has {width} tokens, max_length is {rule.max_length}")
    missing = (F.lit(width) - F.col("length")).cast("int")
    empty = F.array_repeat(F.lit(rule.pad_id).cast("int"), missing)
    ones, zeros = F.array_repeat(F.lit(1), F.col("length").cast("int")), F.array_repeat(F.lit(0), missing)
    pieces = (empty, F.col(ids)) if rule.pad_left else (F.col(ids), empty)
    marks = (zeros, ones) if rule.pad_left else (ones, zeros)
    return wrapped.withColumn("mask", F.concat(*marks)).withColumn(ids, F.concat(*pieces))


def packed_offsets(df: DataFrame, key: str, ids: str = "ids", ranges: int | None = None) -> DataFrame:
    """``key, length, offset``: where each row begins in one buffer of all rows in the order of ``key``.

    Null keys come first, in any order among them; null ids have length 0.
    Sums of ranges of keys come first, so no task sorts or sums the whole table.
    """
    rows = df.select(key, F.coalesce(F.size(F.coalesce(ids, F.array().cast(df.schema[ids].dataType))), F.lit(0)).cast("long").alias("length"))
    placed = rows.withColumn("_block", key_block(rows, key, ranges))
    sums = placed.groupBy("_block").agg(F.sum("length").alias("_sum"))
    before = sums.select("_block", F.expr("coalesce(sum(_sum) over (order by _block rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    inside = F.expr(f"coalesce(sum(length) over (partition by _block order by `{key}` rows between unbounded preceding and 1 preceding), 0)")
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_block").select(key, "length", (F.col("_before") + F.col("_inside")).alias("offset"))


class Packed:
    """Rows of ids in one flat buffer on the driver, each found in constant time."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets = values, offsets

    @staticmethod
    def of(df: DataFrame, ids: str = "ids") -> Packed:
        """Rows of a DataFrame in its own order."""
        column = df.select(ids).toArrow().column(0).combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
        lengths = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
        return Packed(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def token_count(self) -> int:
        return int(self.offsets[-1])

    def __getitem__(self, i: int) -> np.ndarray:
        i += len(self) if i < 0 else 0
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self.values[self.offsets[i] : self.offsets[i + 1]]

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def to_list(self) -> list[list[int]]:
        return [row.tolist() for row in self]
