"""``python -m sparktok.cli bench|validate TOKENIZER FILES...``"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.compare import first_difference
from .operators.encode import count_tokens, encode
from .operators.scan import limit_bytes, parse_size, split_docs
from .operators.shape import Packed
from .plans.loaders import load
from .plans.model import TokenizerModel
from .sources.files import TextSource


def rates(nbytes: int, tokens: int, seconds: float) -> str:
    """One line of throughput."""
    return f"{nbytes / 1e6 / seconds:.1f} MB/s, {tokens / 1e6 / seconds:.2f} Mtok/s ({nbytes} bytes, {tokens} tokens, {seconds:.2f} s)"


def bench(spark: SparkSession, model: TokenizerModel, docs: DataFrame, packed: bool = False) -> str:
    """Encode all documents and report the rate; ``packed``: into one buffer on the driver, else they are only counted."""
    began = time.perf_counter()
    if packed:
        buffer = Packed.of(encode(docs, model).orderBy("doc_id"))
        took = time.perf_counter() - began
        nbytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        return rates(nbytes, buffer.token_count, took)
    total = count_tokens(docs.withColumn("nbytes", F.octet_length("text").cast("long")), model).agg(F.coalesce(F.sum("nbytes"), F.lit(0)).alias("b"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    return rates(total["b"], total["t"], time.perf_counter() - began)


def validate(spark: SparkSession, model: TokenizerModel, paths: list[str], separator: str) -> DataFrame:
    """The first document that comes out differently when files are split by the reader and when texts are split first."""
    by_reader = TextSource(paths, separator).read(spark).withColumnRenamed("doc_id", "n")
    whole = TextSource(paths).read(spark)
    parts = whole.select(F.col("doc_id").alias("_file"), split_docs(F.col("text"), separator).alias("_parts"))
    # One row a file: few enough to be summed in order.
    first = parts.select("_file", F.size("_parts").alias("_k")).select("_file", F.expr("coalesce(sum(_k) over (order by _file rows between unbounded preceding and 1 preceding), 0)").alias("_first"))
    numbered = parts.join(first, "_file").select(F.col("_first"), F.posexplode("_parts").alias("_pos", "text")).select((F.col("_first") + F.col("_pos")).alias("n"), "text")
    return first_difference(by_reader, numbered, lambda docs: encode(docs, model))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparktok")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("bench", "validate"):
        p = commands.add_parser(name)
        p.add_argument("tokenizer")
        p.add_argument("files", nargs="+")
        p.add_argument("--doc-separator", default="<|endoftext|>")
        if name == "bench":
            p.add_argument("--limit-bytes", default="none")
            p.add_argument("--packed", action="store_true")
            p.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=True)
    o = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    model = load(o.tokenizer)
    if o.command == "bench":
        docs = TextSource(o.files, o.doc_separator).read(spark)
        limit = parse_size(o.limit_bytes)
        docs = limit_bytes(docs, limit) if limit is not None else docs
        print(bench(spark, model, docs if o.parallel else docs.coalesce(1), o.packed))
        return 0
    first = validate(spark, model, o.files, o.doc_separator).collect()
    print(f"first mismatch: {first[0]}" if first else "all documents match")
    return int(bool(first))


if __name__ == "__main__":
    sys.exit(main())
