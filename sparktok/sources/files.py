"""Documents from files: text, JSON lines, Parquet, plain or compressed, as (doc_id, text)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import split_docs
from ..shipping import ship
from . import frames, order

COMPRESSIONS = {".zst": "zst", ".zstd": "zst", ".gz": "gz"}
FORMATS = {".jsonl": "jsonl", ".parquet": "parquet"}
DEFAULT_FIELD = "text"


def detect_format(path: str | os.PathLike) -> tuple[str, str | None]:
    """(format, compression) by a path's endings; whatever isn't known is text."""
    name = os.fspath(path)
    stem, ending = os.path.splitext(name)
    compression = COMPRESSIONS.get(ending)
    if compression:
        ending = os.path.splitext(stem)[1]
    return FORMATS.get(ending, "text"), compression


def _paths(paths) -> tuple[str, ...]:
    return (os.fspath(paths),) if isinstance(paths, (str, os.PathLike)) else tuple(os.fspath(p) for p in paths)


@dataclass(frozen=True)
class TextSource:
    """Whole files, or with ``separator`` the documents that it parts; empty documents are left out then.

    A file of no bytes is no document either: Spark's readers pass over it.
    """

    paths: tuple[str, ...]
    separator: str | None = None

    def __init__(self, paths, separator: str | None = None):
        object.__setattr__(self, "paths", _paths(paths))
        object.__setattr__(self, "separator", separator)

    def read(self, spark: SparkSession, ordered: bool = True) -> DataFrame:
        """(doc_id, text); ``ordered``: doc_id gapless in the order of paths and files, for which splits are counted first, else only unique."""
        if any(detect_format(p)[1] for p in self.paths):
            docs = _unpacked(spark, self.paths, self.separator or "")
        else:
            reader = spark.read.option("lineSep", self.separator) if self.separator else spark.read
            docs = order.placed(reader.text(list(dict.fromkeys(self.paths)), wholetext=not self.separator).withColumnRenamed("value", "text"))
            docs = docs.where("text <> ''") if self.separator else docs
        return _numbered(docs, self.paths, ordered)


@dataclass(frozen=True)
class JsonlSource:
    """A string field of each line; blank lines are left out.

    ``on_error``: what a line without the field, or that is no JSON, does:
    fail (the whole read), skip (the line), null (a null text).
    """

    paths: tuple[str, ...]
    field: str = DEFAULT_FIELD
    on_error: str = "fail"

    def __init__(self, paths, field: str = DEFAULT_FIELD, on_error: str = "fail"):
        if on_error not in ("fail", "skip", "null"):
            raise ValueError(f"on_error is fail, skip or null, not {on_error!r}")
        object.__setattr__(self, "paths", _paths(paths))
        object.__setattr__(self, "field", field)
        object.__setattr__(self, "on_error", on_error)

    def read(self, spark: SparkSession, ordered: bool = True) -> DataFrame:
        """As that of ``TextSource``."""
        if any(detect_format(p)[1] for p in self.paths):
            lines = _unpacked(spark, self.paths, "\n").withColumnRenamed("text", "value")
        else:
            lines = order.placed(spark.read.text(list(dict.fromkeys(self.paths))))
        lines = lines.where(F.trim("value") != "").where("value <> '\\r'")
        return _numbered(json_field(lines, "value", self.field, self.on_error), self.paths, ordered)


def json_field(lines: DataFrame, column: str, field: str, on_error: str = "fail") -> DataFrame:
    """(text): a string field of a column of JSON objects, and where it is from if ``lines`` say so."""
    value = F.try_variant_get(F.try_parse_json(F.col(column)), "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    if on_error == "fail":
        text = F.coalesce(text, F.raise_error(F.concat(F.lit(f"no string field {field!r} in: "), F.substring(F.col(column), 1, 80))))
    out = lines.select(text.alias("text"), *(c for c in lines.columns if c in (order.FILE, order.START)))
    return out.where("text is not null") if on_error == "skip" else out


@dataclass(frozen=True)
class ParquetSource:
    """A string or binary column; null counts as an empty document."""

    paths: tuple[str, ...]
    column: str = DEFAULT_FIELD

    def __init__(self, paths, column: str = DEFAULT_FIELD):
        object.__setattr__(self, "paths", _paths(paths))
        object.__setattr__(self, "column", column)

    def read(self, spark: SparkSession, ordered: bool = True) -> DataFrame:
        """As that of ``TextSource``; files' counts come from their footers."""
        table = spark.read.parquet(*dict.fromkeys(self.paths))
        if not ordered:
            return _numbered(text_column(table, self.column), self.paths, False)
        where = [F.col("_metadata.file_path").alias(order.FILE), F.lit(0).cast("long").alias(order.START), F.col("_metadata.row_index").alias(order.ROW)]
        return order.numbered(text_column(table, self.column, where), self.paths)


def text_column(df: DataFrame, column: str, more: list[Column] | None = None) -> DataFrame:
    """(text) of a top-level string or binary column, and ``more`` columns; errors name what there is."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if column not in fields:
        raise ValueError(f"no column {column!r}; there are: {', '.join(fields)}")
    kind = fields[column]
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        raise ValueError(f"column {column!r} has the unsupported type {kind.simpleString()}")
    empty = F.lit("") if isinstance(kind, T.StringType) else F.lit("").cast("binary")
    return df.select(F.coalesce(F.col(f"`{column}`"), empty).alias("text"), *(more or []))


@dataclass(frozen=True)
class BytesSource:
    """Buffers in memory, with ``separator`` parted into documents."""

    data: tuple = field(default=())
    separator: str | None = None

    def __init__(self, data, separator: str | None = None):
        data = (data,) if isinstance(data, (str, bytes)) else tuple(data)
        if len({isinstance(d, str) for d in data}) > 1:
            raise TypeError("texts and bytes can't be mixed in one batch")
        object.__setattr__(self, "data", data)
        object.__setattr__(self, "separator", separator)

    def read(self, spark: SparkSession, ordered: bool = True) -> DataFrame:
        """(doc_id, text), numbered in the order of buffers."""
        if self.data and isinstance(self.data[0], bytes) and not self.separator:
            return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(self.data)], "doc_id long, text binary")
        texts = [d if isinstance(d, str) else d.decode() for d in self.data]
        if self.separator:
            texts = [part for t in texts for part in t.split(self.separator) if part]
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


Source = TextSource | JsonlSource | ParquetSource | BytesSource


def resolve(source) -> Source:
    """A source as it is; a path or paths by the endings of their names, which must be of one format."""
    if isinstance(source, Source):
        return source
    paths = _paths(source)
    if not paths:
        raise ValueError("no paths")
    formats = sorted({detect_format(p)[0] for p in paths})
    if len(formats) > 1:
        raise ValueError(f"files of one format can be read together, not {' and '.join(formats)}")
    return {"text": TextSource, "jsonl": JsonlSource, "parquet": ParquetSource}[formats[0]](paths)


def _files(spark: SparkSession, paths: tuple[str, ...]) -> list[str]:
    """The files that paths name, those of folders too, in order of their names; hidden ones are left out."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in dict.fromkeys(paths):
        there = jvm.org.apache.hadoop.fs.Path(path)
        system = there.getFileSystem(conf)
        tops = list(system.globStatus(there) or [])
        if not tops:
            raise FileNotFoundError(path)
        files = [f for s in tops for f in (system.listStatus(s.getPath()) if s.isDirectory() else [s]) if not f.isDirectory()]
        found += [f.getPath().toUri().toString() for f in files if not f.getPath().getName().startswith(("_", "."))]
    return found


def _unpacked(spark: SparkSession, paths: tuple[str, ...], separator: str) -> DataFrame:
    """(text, _file, _start) of compressed files, a partition for each run of frames; files beside them that aren't compressed are read as text."""
    ship(spark)
    spark.dataSource.register(frames.FrameSource)
    found = _files(spark, paths)
    packed = [p for p in found if detect_format(p)[1]]
    docs = spark.read.format(frames.NAME).option("paths", json.dumps(packed)).option("separator", separator).load()
    plain = [p for p in found if not detect_format(p)[1]]
    if plain:
        reader = spark.read.option("lineSep", separator) if separator else spark.read
        rest = order.placed(reader.text(plain, wholetext=not separator).withColumnRenamed("value", "text"))
        docs = docs.union(rest.where("text <> ''") if separator else rest)
    return docs


def _numbered(docs: DataFrame, paths: tuple[str, ...], ordered: bool) -> DataFrame:
    """With ``doc_id``."""
    return order.numbered(docs, paths) if ordered else docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")


#: A table of fewer bytes for each core is small enough to be dealt out anew.
SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt over all cores if its files are fewer than these and small.

    A file of one row group is one task, whatever work its rows make.  Larger
    tables, and those of many files, are left as they are and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df
