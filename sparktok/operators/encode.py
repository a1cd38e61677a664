"""Encode and decode columns.

Words repeat, so each worker remembers what it has merged; the encoder of a
model is built once in a worker and found again by the model's digest.  A
batch's ids go from the words' bytes to an Arrow array and back without
becoming Python numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import TokenizerModel
from ..shipping import ship
from .encoder import Decoder, Encoder, encoder
from .slices import slices

_MADE: dict[tuple[str, str], Encoder | Decoder] = {}


def _cached(model: TokenizerModel, make: Callable = encoder) -> Encoder | Decoder:
    key = make.__name__, model.digest
    found = _MADE.get(key)
    if found is None:
        if len(_MADE) >= 8:
            _MADE.clear()
        found = _MADE[key] = make(model)
    return found


def _schema(df: DataFrame, out: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out), f"`{out}` {kind}"])


def _with(df: DataFrame, column: str, out: str, kind: str, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """``df`` with a column made from another in Arrow batches; ``make`` gives what turns a batch's array into the new one."""
    ship(df.sparkSession)
    names = [f.name for f in df.schema.fields if f.name != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index(column)):
                values = one(batch.column(batch.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in names), values], names=[*names, out])

    return df.mapInArrow(work, _schema(df, out, kind))


def _text(value: str | bytes, strict: bool) -> str:
    """Bytes that aren't UTF-8 pass through a byte-level model; a piece model refuses them."""
    return value if isinstance(value, str) else bytes(value).decode("utf-8", "strict" if strict else "surrogateescape")


def _packer(model: TokenizerModel, normalized: bool, added: bool) -> Callable[[list], list[bytes | None]]:
    """What gives many texts' ids as bytes."""
    own, strict = _cached(model), model.kind == "piece"
    option = normalized if strict else added
    return lambda values: own.packed_all([None if v is None else _text(v, strict) for v in values], option)


def lists(codes: list[bytes | None]) -> pa.Array:
    """Arrays of ids from their bytes."""
    stops = np.cumsum([0, *(0 if c is None else len(c) // 4 for c in codes)])
    values = pa.Array.from_buffers(pa.int32(), int(stops[-1]), [None, pa.py_buffer(b"".join(c for c in codes if c is not None))])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), values, mask=pa.array([c is None for c in codes], pa.bool_()))


def encode(df: DataFrame, model: TokenizerModel, text: str = "text", out: str = "ids", normalized: bool = False, added: bool = True) -> DataFrame:
    """``df`` with an array of ids for each text (string or binary); null stays null, empty is [].

    ``normalized``: the texts have been normalized already (piece models).
    ``added`` False: added tokens aren't looked for (byte models); a piece that
    is the content of one is still that token.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        many = _packer(shared.value, normalized, added)
        return lambda values: lists(many(values.to_pylist()))

    return _with(df, text, out, "array<int>", make)


def count_tokens(df: DataFrame, model: TokenizerModel, text: str = "text", out: str = "tokens", normalized: bool = False, added: bool = True) -> DataFrame:
    """``df`` with the number of each text's ids; they are not sent back. Null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        many = _packer(shared.value, normalized, added)
        return lambda values: pa.array([None if c is None else len(c) // 4 for c in many(values.to_pylist())], pa.int64())

    return _with(df, text, out, "long", make)


def encode_distinct(df: DataFrame, model: TokenizerModel, word: str = "pretoken", out: str = "ids") -> DataFrame:
    """Ids of each distinct word of a table of words: the table that counts and joins need."""
    return encode(df.select(word).distinct(), model, word, out, added=False)


def decode_text(df: DataFrame, model: TokenizerModel, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of each array of whole numbers; bytes that aren't UTF-8 are replaced, null stays null."""
    kind = df.schema[ids].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType)):
        raise TypeError(f"ids are an array of whole numbers, not {kind.simpleString()}")
    shared = df.sparkSession.sparkContext.broadcast(model)
    return _with(df, ids, out, "string", lambda: _cached(shared.value, Decoder))


#: Ids, and bytes of tokens, of a vocabulary that goes to the tasks as one array.
MOST_IDS, MOST_TOKEN_BYTES = 1 << 20, 16 << 20
#: In that array, an id that is none.
_HOLE = "-"


def decode_join(df: DataFrame, vocab: DataFrame, key: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The same without Python for byte-level models: ids looked up in the vocabulary table, bytes put together again.

    ``key`` tells rows apart.  An id without a row in ``vocab`` is an error.  A
    vocabulary of up to MOST_IDS and MOST_TOKEN_BYTES is read once, when this is
    called, and is an array by id in the plan, so nothing is shuffled; a larger
    one is joined with all ids.
    """
    known = vocab.where("id IS NOT NULL AND bytes IS NOT NULL")
    most, size, least, number, different = known.agg(F.max("id"), F.sum(F.octet_length("bytes")), F.min("id"), F.count("*"), F.count_distinct("id")).first()
    if number and least >= 0 and most < MOST_IDS and size <= MOST_TOKEN_BYTES and number == different:
        tokens = [_HOLE] * (most + 1)
        for row in known.select("id", F.hex("bytes").alias("hex")).collect():
            tokens[row["id"]] = row["hex"]
        return df.withColumn(out, _looked_up(F.col(ids), tokens))
    return _joined(df, vocab, key, ids, out)


def _looked_up(ids: Column, tokens: list[str]) -> Column:
    """Texts of ids by an array of hexadecimal tokens."""
    table = F.split(F.lit(",".join(tokens)), ",")

    def token(i: Column) -> Column:
        # A place beyond the array is null, and one that doesn't fit a place is beyond it.
        found = F.get(table, F.when(i.between(0, len(tokens) - 1), i).cast("int"))
        return F.when(found != _HOLE, found).otherwise(F.raise_error(F.concat(F.lit("id outside the vocabulary: "), F.coalesce(i.cast("string"), F.lit("null")))))

    return F.unhex(F.coalesce(F.array_join(F.transform(ids, token), ""), F.lit(""))).cast("string")


def _joined(df: DataFrame, vocab: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """``decode_join`` for a vocabulary of any size, by a join of all ids."""
    flat = df.select(key, F.posexplode(ids).alias("_at", "id")).join(vocab.select("id", F.hex("bytes").alias("_hex")), "id", "left")
    flat = flat.withColumn("_hex", F.coalesce("_hex", F.raise_error(F.concat(F.lit("id outside the vocabulary: "), F.col("id").cast("string")))))
    whole = flat.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_hex"))), lambda x: x["_hex"]), "").alias("_all"))
    return df.join(whole, key, "left").withColumn(out, F.unhex(F.coalesce("_all", F.lit(""))).cast("string")).drop("_all")


def register(spark: SparkSession, model: TokenizerModel, prefix: str = "bpe") -> None:
    """SQL functions ``<prefix>_encode(text)`` and ``<prefix>_decode(ids)``."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return lists(_packer(shared.value, False, True)(texts.to_pylist()))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        return _cached(shared.value, Decoder)(ids)

    spark.udf.register(f"{prefix}_encode", encoded)
    spark.udf.register(f"{prefix}_decode", decoded)


def token_totals(df: DataFrame, ids: str = "ids", *by: str) -> DataFrame:
    """Documents and tokens, in all or by some columns; ``ids`` is a column of arrays, or of their lengths."""
    size = F.size(ids) if isinstance(df.schema[ids].dataType, T.ArrayType) else F.col(ids)
    return df.groupBy(*by).agg(F.count("*").alias("docs"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"))


def byte_length(text: str | Column) -> Column:
    return F.octet_length(text)
