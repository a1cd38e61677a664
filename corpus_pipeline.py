"""From raw documents to packed sequences: five stages, each a written table read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktok.llm import decontam, langid, ngram_join, packing, secrets
from sparktok.llm.queries import table, tokenizer_path
from sparktok.llm.scratch import Scratch
from sparktok.shipping import ship

#: Near copies: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship(spark)
    return langid.keep(docs, langid.fit(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    with Scratch(spark) as scratch:
        return scratch.keep(ngram_join.keep_first(docs, scratch, SHINGLE, PERCENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    with Scratch(spark) as scratch:
        return scratch.keep(decontam.clean(docs, table(spark, sf_dir, "benchmark"), scratch))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind; n_chars counts the new text."""
    ship(spark)
    return secrets.redact_all(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset."""
    with Scratch(spark) as scratch:
        return scratch.keep(packing.pack(docs, scratch, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: DuckDB has neither the trained model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    Null and letterless texts go in the first stage; of repeated rows one is
    left after the second.  Without a labelled row no language is known and
    nothing is left; without benchmark items the third stage keeps all.  An
    empty table gives no rows.  Each stage's tables go when the next is written.
    """
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as store:
        for k, (_, stage) in enumerate(STAGES):
            last = k == len(STAGES) - 1
            out = (store.keep if last else store.stage)(stage(spark, docs, sf_dir))
            store.drop(docs)
            docs = out
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
