"""The same operators over streams: encoding has no state, so a stream is encoded as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemes import DEFAULT, pretokens
from ..operators.encode import encode
from ..plans.model import TokenizerModel


def read_texts(spark: SparkSession, folder: str, separator: str | None = None) -> DataFrame:
    """A stream of the documents in files that come into a folder."""
    reader = spark.readStream.format("text")
    reader = reader.option("lineSep", separator) if separator else reader.option("wholetext", True)
    return reader.load(folder).where("value <> ''").withColumnRenamed("value", "text")


def encode_stream(docs: DataFrame, model: TokenizerModel, text: str = "text") -> DataFrame:
    return encode(docs, model, text)


def running_counts(docs: DataFrame, text: str = "text", scheme: str = DEFAULT) -> DataFrame:
    """Counts of pretokens so far, for output mode complete or update."""
    return docs.select(F.explode(pretokens(F.col(text), scheme)).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("cnt"))


def windowed_tokens(events: DataFrame, time: str, text: str, window: str = "1 hour", late: str = "10 minutes", scheme: str = DEFAULT) -> DataFrame:
    """Pretokens in each window of event time; later events than ``late`` are not waited for."""
    sized = events.withWatermark(time, late).select(F.window(time, window).alias("w"), F.size(pretokens(F.col(text), scheme)).alias("n"))
    return sized.groupBy("w").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).select(F.col("w.start").alias("start"), "docs", "tokens")
