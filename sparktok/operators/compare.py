"""Where two tables of ids differ, without a join of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of one fingerprint.
RANGE_KEYS = 1 << 12


def fingerprints(df: DataFrame, key: str = "n", ids: str = "ids", keys: int = RANGE_KEYS) -> DataFrame:
    """(range, rows, low, high): 128 bits of all rows whose whole-number key lies in a range; keys are unique.

    A row's bits come from its key, its ids in order and whether they are null,
    so ranges with equal bits hold equal rows but for a chance of 2^-128.
    Partial aggregates: a task sends one row for each range that it holds.
    """
    whole = F.col(key), F.col(ids).isNull(), F.size(F.coalesce(ids, F.array().cast(df.schema[ids].dataType))), F.col(ids)
    rows = df.select(F.floor(F.col(key) / F.lit(keys)).cast("long").alias("range"), F.xxhash64(*whole).alias("_low"), F.xxhash64(F.lit(1), *whole).alias("_high"))
    return rows.groupBy("range").agg(F.count("*").alias("rows"), F.bit_xor("_low").alias("low"), F.bit_xor("_high").alias("high"))


def mismatches(left: DataFrame, right: DataFrame, key: str = "n", ids: str = "ids") -> DataFrame:
    """Rows of two tables that differ, matched by ``key``; a row that only one has differs too, though its ids be null."""
    a = left.select(key, F.col(ids).alias("left_ids"), F.lit(True).alias("_left"))
    b = right.select(key, F.col(ids).alias("right_ids"), F.lit(True).alias("_right"))
    differ = ~F.col("left_ids").eqNullSafe(F.col("right_ids")) | F.col("_left").isNull() | F.col("_right").isNull()
    return a.join(b, key, "full_outer").where(differ).drop("_left", "_right")


def first_difference(left: DataFrame, right: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "n", ids: str = "ids", keys: int = RANGE_KEYS) -> DataFrame:
    """(key, left_ids, right_ids) of the smallest key at which two tables differ, or no row.

    ``make`` turns a table into one of ids: it is run over all rows for the
    fingerprints, and once more over the first range that differs, alone.  Runs
    a job when it is called, which brings the number of that range.
    """
    a, b = (fingerprints(make(df), key, ids, keys) for df in (left, right))
    differ = a.alias("a").join(b.alias("b"), "range", "full_outer").where(~F.struct("a.rows", "a.low", "a.high").eqNullSafe(F.struct("b.rows", "b.low", "b.high")))
    first = differ.agg(F.min("range")).first()[0]
    inside = F.lit(False) if first is None else F.col(key).between(first * keys, (first + 1) * keys - 1)
    return mismatches(make(left.where(inside)), make(right.where(inside)), key, ids).orderBy(key).limit(1)
