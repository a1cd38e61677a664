"""Packed ids as a table on disk: flat buffers with offsets, found by row in constant time.

Each task streams its rows into three files: ids (32 bits each), offsets (64
bits, one more than rows) and keys (64 bits).  File names are an attempt's own.
The driver's commit writes a manifest of the parts in order by a rename, and
only what the manifest names is part of the table; what failed or repeated
attempts left is deleted.  Integers are little-endian.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.slices import slices
from ..shipping import ship
from .frames import open_file, split_path

NAME = "sparktok_packed"
MANIFEST = "manifest.json"
KINDS = (".ids", ".off", ".key")
#: Rows of a partition and ids of a batch when a table is read.
PARTITION_ROWS, BATCH_IDS = 1 << 18, 1 << 20


class Written(NamedTuple):
    """A part: its files' stem, how much it holds, and where it goes among the others."""

    stem: str
    rows: int
    tokens: int
    first: tuple[int, int]


@dataclass
class Committed(WriterCommitMessage):
    part: Written | None


class PackedWriter(DataSourceArrowWriter):
    """Takes batches (key long, tie long, ids array<int>), sorted by key and tie within a task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        store, root = split_path(path)
        if not overwrite and store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds packed ids already")
        store.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, root = split_path(self.path)
        stem, rows, tokens, first = f"part-{uuid.uuid4().hex}", 0, 0, None
        files = [store.open_output_stream(f"{root}/{stem}{kind}") for kind in KINDS]
        ids, offsets, keys = files
        try:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in (part for whole in iterator for part in slices(whole, 2)):
                key, tie, values = batch.columns
                first = first or (key[0].as_py(), tie[0].as_py())
                ends = tokens + np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype("<i8"))
                ids.write(values.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes())
                offsets.write(ends.tobytes())
                keys.write(key.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                rows, tokens = rows + batch.num_rows, int(ends[-1])
        except BaseException:
            self._delete([stem], files)
            raise
        if not rows:
            self._delete([stem], files)
            return Committed(None)
        for file in files:
            file.close()
        return Committed(Written(stem, rows, tokens, first))

    def _delete(self, stems: list[str], files: list | None = None) -> None:
        store, root = split_path(self.path)
        for file in files or []:
            file.close()
        for stem in stems:
            for kind in KINDS:
                if store.get_file_info(f"{root}/{stem}{kind}").type != fs.FileType.NotFound:
                    store.delete_file(f"{root}/{stem}{kind}")

    def commit(self, messages: list[Committed | None]) -> None:
        store, root = split_path(self.path)
        parts = sorted((m.part for m in messages if m and m.part), key=lambda p: (p.first, p.stem))
        with store.open_output_stream(f"{root}/{MANIFEST}.new") as out:
            out.write(json.dumps([p._asdict() for p in parts]).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
        own = {p.stem for p in parts}
        there = {info.base_name.split(".")[0] for info in store.get_file_info(fs.FileSelector(root)) if info.base_name.startswith("part-")}
        self._delete(sorted(there - own))

    def abort(self, messages: list[Committed | None]) -> None:
        self._delete([m.part.stem for m in messages if m and m.part])


def manifest(path: str) -> list[Written]:
    with open_file(f"{path}/{MANIFEST}") as file:
        return [Written(p["stem"], p["rows"], p["tokens"], tuple(p["first"])) for p in json.loads(file.read())]


def _numbers(file: pa.NativeFile, begin: int, count: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(file.read_at(count * size, begin * size), dtype=kind)


@dataclass
class Rows(InputPartition):
    """Rows ``begin`` to before ``end`` of a part, whose first row is ``place`` in the table."""

    stem: str
    begin: int
    end: int
    place: int


class PackedReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        out, place = [], 0
        for part in manifest(self.path):
            out += [Rows(part.stem, k, min(k + self.rows, part.rows), place) for k in range(0, part.rows, self.rows)]
            place += part.rows
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # A table without partitions is read once nevertheless.
            return
        ids, offsets, keys = (open_file(f"{self.path}/{partition.stem}{kind}") for kind in KINDS)
        with ids, offsets, keys:
            begin, end = partition.begin, partition.end
            ends = _numbers(offsets, begin, end - begin + 1, "<i8")
            key = _numbers(keys, begin, end - begin, "<i8")
            at = 0
            while at < len(key):
                # A batch has one row at least, however long.
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_IDS, "right")) - 1)
                flat = pa.array(_numbers(ids, int(ends[at]), int(ends[to] - ends[at]), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), flat)
                places = pa.array(np.arange(at, to, dtype=np.int64) + begin + partition.place)
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to]), places, lists], names=["key", "place", "ids"])
                at = to


class PackedSource(DataSource):
    """Options: ``path``, a folder; ``partition_rows``, rows of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key long, place long, ids array<int>"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], int(self.options.get("partition_rows", PARTITION_ROWS)))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite)


def write_packed(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", overwrite: bool = False, ranges: int | None = None) -> None:
    """Write rows in the order of a whole-number key into a folder; null ids are rows of none, a null key is an error.

    Rows are ranged by key and, among equal keys, by a hash of their ids, so a
    key that very many rows share goes over many tasks.
    """
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(PackedSource)
    known = F.coalesce(F.col(key).cast("long"), F.raise_error(F.lit(f"a row's {key} is null")).cast("long"))
    rows = df.select(known.alias("key"), F.xxhash64(ids).alias("tie"), F.col(ids).cast("array<int>").alias("ids"))
    ranged = rows.repartitionByRange(ranges, "key", "tie") if ranges else rows.repartitionByRange("key", "tie")
    ranged.sortWithinPartitions("key", "tie").write.format(NAME).mode("overwrite" if overwrite else "append").save(path)


def read_packed(spark: SparkSession, path: str, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """(key, place, ids): all rows with their gapless places in the order of keys."""
    ship(spark)
    spark.dataSource.register(PackedSource)
    return spark.read.format(NAME).option("partition_rows", partition_rows).load(path)


class PackedFile:
    """Rows of a written table by their place, read one by one; only the manifest is held."""

    def __init__(self, path: str):
        self.path, self.parts = path, manifest(path)
        self.starts = np.cumsum([0, *(p.rows for p in self.parts)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    @property
    def token_count(self) -> int:
        return sum(p.tokens for p in self.parts)

    def __getitem__(self, i: int) -> np.ndarray:
        i += len(self) if i < 0 else 0
        if not 0 <= i < len(self):
            raise IndexError(i)
        part = int(np.searchsorted(self.starts, i, "right")) - 1
        stem, row = self.parts[part].stem, i - int(self.starts[part])
        with open_file(f"{self.path}/{stem}.off") as offsets, open_file(f"{self.path}/{stem}.ids") as ids:
            begin, end = _numbers(offsets, row, 2, "<i8").tolist()
            return _numbers(ids, begin, end - begin, "<i4")
