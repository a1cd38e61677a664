"""Added tokens, forbidden substrings and byte limits over texts, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schemes import interleave
from . import literals


def present(text: Column, patterns: list[str]) -> Column:
    """Indices of the patterns that a text holds, ascending; overlapping ones all count."""
    flags = F.array(*(F.when(F.contains(text, F.lit(p)), F.lit(i)) for i, p in enumerate(patterns))) if patterns else F.array()
    return F.filter(flags.cast("array<int>"), lambda x: x.isNotNull())


#: From so many patterns on, one automaton looks for all of them.
MANY = 32


def forbidden(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """One row (pattern int, found boolean) for each pattern: whether any text holds it. One pass, partial aggregates."""
    if len(patterns) >= MANY and all(patterns) and len(set(patterns)) == len(patterns):
        found = literals.literal_counts(df, patterns, text).withColumn("found", F.lit(True))
        every = df.sparkSession.range(len(patterns)).select(F.col("id").cast("int").alias("pattern"))
        return every.join(found, "pattern", "left").select("pattern", F.coalesce("found", F.lit(False)).alias("found"))
    if not patterns:
        return df.sparkSession.createDataFrame([], "pattern int, found boolean")
    flags = df.agg(*(F.coalesce(F.bool_or(F.contains(F.col(text), F.lit(p))), F.lit(False)).alias(f"p{i}") for i, p in enumerate(patterns)))
    return flags.select(F.posexplode(F.array(*(F.col(f"p{i}") for i in range(len(patterns))))).alias("pattern", "found"))


class ForbiddenText(ValueError):
    """A batch holds forbidden substrings; ``indices`` says which."""

    def __init__(self, indices: list[int]):
        super().__init__(f"forbidden substrings found: {indices}")
        self.indices = indices


def refuse(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """``df`` itself; raises if any text holds a forbidden substring."""
    found = [r["pattern"] for r in forbidden(df, patterns, text).where("found").collect()]
    if found:
        raise ForbiddenText(sorted(found))
    return df


def _java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&~#\-])", r"\\\1", text)


def split_added(text: Column, contents: list[str]) -> Column:
    """A text's parts between and at literals, in order: the longest literal that begins furthest left."""
    pattern = "|".join(_java_quote(c) for c in sorted(set(contents), key=lambda c: (-len(c), c)))
    return interleave(text, pattern)


def split_docs(text: Column, separator: str) -> Column:
    """Documents of a text parted by a literal; empty ones are left out, no separator leaves the text whole."""
    if not separator:
        return F.array(text)
    return F.array_remove(F.split(text, _java_quote(separator), -1), "")


def parse_size(text: str) -> int | None:
    """Bytes of "100MB" and the like, decimal units; None for "none" and "unlimited"."""
    word = text.strip().lower()
    if word in ("none", "unlimited"):
        return None
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)b?", word)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1000 ** " kmgt".index(m[2] or " "))


#: Rows that one range of keys should hold, and the most ranges (a power of two).
RANGE_ROWS, MOST_RANGES = 200_000, 1 << 14


def key_code(key: str, kind: T.DataType) -> Column:
    """A number that grows with the key, though different keys may share it; null for a null key.

    TypeError for kinds of keys that have no order here.
    """
    column = F.col(f"`{key}`")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        first = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0")
        return F.when(column.isNotNull(), F.conv(first, 16, 10).cast("double"))
    raise TypeError(f"keys of type {kind.simpleString()} can't be put in order")


def key_block(rows: DataFrame, key: str, ranges: int | None = None) -> Column:
    """Number of the range of keys that a row is in, in the order of keys; null keys come first, by themselves.

    Ranges hold about as many rows each, by quantiles that one aggregate
    finds, so a key far from all others makes no large range; equal keys are
    in one.  A binary search over the limits gives a row's range.
    """
    code = key_code(key, rows.schema[key].dataType)
    if ranges is None:
        ranges = min(MOST_RANGES, max(16, rows.count() // RANGE_ROWS))
    steps = max(1, (ranges - 1).bit_length())
    ranges = 1 << steps
    wanted = F.lit([k / ranges for k in range(1, ranges)])
    limits = rows.agg(F.percentile_approx(code, wanted, F.lit(10 * ranges)).alias("q")).first()["q"] or []
    if not limits:
        return F.when(code.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table = F.lit(limits)

    def step(at: Column, size: Column) -> Column:
        next_at = at + size
        return F.when(F.get(table, next_at - 1) <= code, next_at).otherwise(at)

    found = F.aggregate(F.lit([1 << k for k in reversed(range(steps))]), F.lit(0), step)
    return F.when(code.isNull(), F.lit(-1)).otherwise(found)


def limit_bytes(df: DataFrame, most: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first documents in the order of ``key`` that fit in ``most`` bytes; the next is cut to what is left (binary).

    Null keys come first, in any order among them; a null text has no bytes
    and stays null; empty documents stay as long as all before them fit.
    Bytes are summed by ranges of keys first, so only the range of the border
    is summed row by row.
    """
    rows = df.withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    if most is None:
        return rows.withColumn(text, F.col(text).cast("binary")).drop("_bytes")
    rows = rows.withColumn("_block", key_block(rows, key))
    sums = rows.groupBy("_block").agg(F.sum("_bytes").alias("_sum"))
    before = sums.select("_block", F.expr("coalesce(sum(_sum) over (order by _block rows between unbounded preceding and 1 preceding), 0)").alias("_before")).where(F.col("_before") <= most)
    rows = rows.join(F.broadcast(before), "_block")
    rows = rows.withColumn("_at", F.col("_before") + F.expr(f"coalesce(sum(_bytes) over (partition by _block order by `{key}` rows between unbounded preceding and 1 preceding), 0)"))
    rows = rows.where((F.col("_at") < most) | (F.col("_at") == most) & (F.col("_bytes") == 0))
    cut = F.substring(F.col(text).cast("binary"), F.lit(1), F.least(F.col("_bytes"), F.lit(most) - F.col("_at")).cast("int"))
    return rows.withColumn(text, cut).select(*df.columns)
