"""Cut a corpus into chunks of bounded bytes and keep the cut as data.

``chunked`` numbers chunks inside the task that reads them and writes the
number beside each row, so later steps find the same chunks however Spark
deals the table out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK_BYTES = 8 << 20
PARTITION_SHIFT = 24
ROW_BITS = 16


def chunked(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Add ``chunk`` (long) and ``row`` (int, place in the chunk).

    A chunk ends with the row that brings it to ``chunk_bytes``, or to 65,536
    rows; one row is never cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << PARTITION_SHIFT
        chunk, size, rows = 0, 0, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            numbers, places = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int32)
            for i, n in enumerate(lengths.tolist()):
                numbers[i], places[i] = base + chunk, rows
                size, rows = size + n, rows + 1
                if size >= chunk_bytes or rows >= 1 << ROW_BITS:
                    chunk, size, rows = chunk + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(places)], names=[*batch.schema.names, "chunk", "row"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(cut, f"{fields}, chunk long, row int")


def total_bytes(chunks: DataFrame, text: str = "text") -> int:
    return chunks.agg(F.sum(F.octet_length(text))).first()[0] or 0


def rid() -> Column:
    """A row's number, from its chunk and its place in it."""
    return F.shiftleft("chunk", ROW_BITS).bitwiseOR(F.col("row").cast("long"))


def rows_of(staged: DataFrame, numbers: DataFrame, scratch: Scratch, among: bool) -> DataFrame:
    """Rows of a written table of chunks whose numbers are in ``numbers`` (rid), or with ``among`` False are not.

    A chunk's rows are marked by one bit each, four to a hexadecimal digit.
    That is so little that Spark can send it to all tasks; if it is too much
    for that, the join shuffles.
    """

    def marks(table: pa.Table) -> pa.Table:
        found = table.column("rid").to_numpy()
        bits = np.zeros(1 << ROW_BITS, dtype=bool)
        bits[found & ((1 << ROW_BITS) - 1)] = True
        nibbles = np.packbits(bits[: (int(np.nonzero(bits)[0][-1]) | 7) + 1]).tobytes().hex()
        return pa.table({"chunk": pa.array([int(found[0] >> ROW_BITS)], pa.int64()), "marks": [nibbles]})

    marked = numbers.select("rid", F.shiftright("rid", ROW_BITS).alias("chunk")).groupBy("chunk").applyInArrow(marks, "chunk long, marks string")
    bit = F.expr("(cast(conv(substring(marks, row div 4 + 1, 1), 16, 10) as int) >> (3 - row % 4)) & 1 = 1")
    if among:
        return staged.join(scratch.stage(marked), "chunk").where(bit)
    return staged.join(scratch.stage(marked), "chunk", "left").where(~F.coalesce(bit, F.lit(False)))
