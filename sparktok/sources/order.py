"""Gapless numbers for documents of files, in the order of the paths given, of files, and of places in a file.

Spark packs splits of files into tasks by size, so the order of tasks is not
that of files.  Rows of one split stay together and in order, so their number
is what the splits before theirs hold, plus their place in their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits whose counts the driver adds up and sends to all tasks (some 100 bytes each); more are added up and joined by Spark.
MOST_SPLITS = 100_000
FILE, START, ROW = "_file", "_start", "_row"


def _bare(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def roots(spark: SparkSession, paths: tuple[str, ...]) -> list[tuple[int, str]]:
    """(place in the list, path) of each path given, globs resolved."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for place, path in enumerate(paths):
        there = jvm.org.apache.hadoop.fs.Path(path)
        found += [(place, s.getPath().toUri().getRawPath().rstrip("/")) for s in there.getFileSystem(conf).globStatus(there) or []]
    return found


def placed(scan: DataFrame) -> DataFrame:
    """A file scan with the file and the beginning of the split that a row is from."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(START))


def numbered(docs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """(doc_id, text) of ``docs`` (text, _file, _start, and _row if a row's place in its split is known), doc_id gapless from 0.

    Splits are counted first, which for text is a pass of its own over the
    files, and for Parquet reads no column.  A path that is given twice gives
    its documents twice, at both places.  Nothing must be filtered or parted
    after this.
    """
    spark = docs.sparkSession
    known = ROW in docs.columns
    docs = docs if known else docs.withColumn(ROW, F.monotonically_increasing_id())
    splits = docs.groupBy(FILE, START).agg(F.count("*").alias("_n"), (F.lit(0) if known else F.min(ROW)).cast("long").alias("_first"))
    if len(paths) == 1:
        splits = splits.withColumn("_place", F.lit(0))
    else:
        parts = F.split(_bare(F.col(FILE)), "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        given = spark.createDataFrame(roots(spark, paths), "_place int, _root string")
        splits = splits.withColumn("_root", F.explode(above)).join(F.broadcast(given), "_root").drop("_root")
    head = splits.limit(MOST_SPLITS + 1).collect()
    if len(head) <= MOST_SPLITS:
        rows, before = [], 0
        for r in sorted(head, key=lambda r: (r["_place"], r[FILE], r[START])):
            rows.append((r[FILE], r[START], r["_first"], before))
            before += r["_n"]
        offsets = F.broadcast(spark.createDataFrame(rows, f"{FILE} string, {START} long, _first long, _before long"))
    else:
        offsets = splits.withColumn("_before", F.expr(f"coalesce(sum(_n) over (order by _place, {FILE}, {START} rows between unbounded preceding and 1 preceding), 0)"))
    return docs.join(offsets, [FILE, START]).select((F.col("_before") + F.col(ROW) - F.col("_first")).alias("doc_id"), "text")
