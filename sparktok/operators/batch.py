"""Whole calls over batches and files: read or take in, check, encode, shape."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemes import DEFAULT
from ..plans.model import TokenizerModel
from ..sources.files import Source, TextSource, resolve
from .counts import pretoken_counts
from .encode import encode
from .scan import refuse
from .shape import Packed, Padding, pad, wrap
from .train import DEFAULT_SEPARATOR


def texts(spark: SparkSession, batch) -> DataFrame:
    """(doc_id, text) of a list of texts or of bytes, or of an Arrow array or column; ``doc_id`` is the place in it.

    TypeError if kinds are mixed or no texts.  Null is allowed in Arrow only.
    """
    if isinstance(batch, (pa.Array, pa.ChunkedArray)):
        column = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
        kind = column.type
        if pa.types.is_dictionary(kind):
            column, kind = column.dictionary_decode(), kind.value_type
        is_text = pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_string_view(kind)
        if not is_text and not (pa.types.is_binary(kind) or pa.types.is_large_binary(kind) or pa.types.is_binary_view(kind)):
            raise TypeError(f"a batch is of texts or bytes, not of {kind}")
        column = column.cast(pa.string() if is_text else pa.binary())
    else:
        items = list(batch) if not isinstance(batch, (str, bytes)) else None
        if items is None:
            raise TypeError("a batch is a list of texts, not one text")
        kinds = {bytes if isinstance(x, (bytes, bytearray, memoryview)) else type(x) for x in items}
        if not kinds <= {str} and not kinds <= {bytes}:
            raise TypeError(f"a batch is of texts alone or of bytes alone, not of {', '.join(sorted(k.__name__ for k in kinds))}")
        column = pa.array([bytes(x) for x in items], pa.binary()) if kinds == {bytes} else pa.array(items, pa.string())
    return spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(column)), pa.int64()), "text": column}))


def encode_batch(spark: SparkSession, batch, model: TokenizerModel, **options) -> DataFrame:
    """(doc_id, ids) of a batch in memory, in its order; ``options`` are those of ``encode``."""
    return encode(texts(spark, batch), model, **options).select("doc_id", "ids")


def encode_files(spark: SparkSession, source: Source | str | list, model: TokenizerModel, packed: bool = False) -> DataFrame | Packed:
    """(doc_id, ids) of the documents of a source, or of files by their names' endings.

    ``packed``: all ids in one buffer on the driver, documents in the order of files.
    """
    ids = encode(resolve(source).read(spark), model).select("doc_id", "ids")
    return Packed.of(ids.orderBy("doc_id")) if packed else ids


def pretoken_counts_files(spark: SparkSession, source: Source | str | list, scheme: str = DEFAULT, separator: str = DEFAULT_SEPARATOR) -> DataFrame:
    """(pretoken, cnt) over the documents of a source; text files named by path are parted by ``separator``."""
    if not isinstance(source, Source):
        found = resolve(source)
        source = TextSource(found.paths, separator) if isinstance(found, TextSource) else found
    return pretoken_counts(source.read(spark, ordered=False), scheme=scheme)


@dataclass(frozen=True)
class Wrapping:
    """Prefix, at most ``max_tokens`` ids, suffix; ``forbid`` are substrings that no text may hold."""

    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()
    max_tokens: int | None = None
    truncate_left: bool = False
    forbid: tuple[str, ...] = ()


def encode_wrapped(df: DataFrame, model: TokenizerModel, rule: Wrapping, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with wrapped ids; raises ``ForbiddenText`` before anything is encoded if a text holds what is forbidden."""
    if rule.forbid:
        refuse(df, list(rule.forbid), text)
    ids = encode(df, model, text, out)
    return ids.withColumn(out, wrap(F.col(out), rule.prefix, rule.suffix, rule.max_tokens, rule.truncate_left))


def encode_padded(df: DataFrame, model: TokenizerModel, rule: Padding, forbid: tuple[str, ...] = (), text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ids padded to one width, and ``length`` and ``mask``; forbidden substrings as in ``encode_wrapped``."""
    if forbid:
        refuse(df, list(forbid), text)
    return pad(encode(df, model, text, out), rule, out)

