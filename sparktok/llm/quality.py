"""Quality rules as one Spark projection: a threshold table compiled into column expressions.

No user function runs: words, windows and lines are arrays inside a row, and
higher-order functions count over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words, as a Java class.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that the stop-word rule knows (fixed values).
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "with", "you",
    "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pas", "que", "un", "une",
    "con", "del", "el", "las", "los", "no", "para", "por", "se", "y",
)

#: Rule, numerator, denominator, least and most value of their ratio (None: no bound).
THRESHOLDS: tuple[tuple[str, str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols_to_words", "n_symbols", "n_words", None, 0.3),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.6),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.5),
)
LEAST_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that the array holds twice or more.

    A window is a number whose high bits are of its hash and whose low bits are
    its place; sorting brings equal windows together, and neighbours count as
    equal only if their words are.
    """

    def same(a: Column, b: Column, bits: Column, mask: Column) -> Column:
        def word(x: Column, k: int) -> Column:
            return F.get(w, (x.bitwiseAND(mask) + F.lit(k)).cast("int"))

        equal = F.lit(True)
        for k in range(3):
            equal = equal & (word(a, k) == word(b, k))
        return F.coalesce((_shift("shiftrightunsigned", a, bits) == _shift("shiftrightunsigned", b, bits)) & equal, F.lit(False))

    def count(bits: Column) -> Column:
        mask = _shift("shiftleft", F.lit(1).cast("bigint"), bits) - F.lit(1)
        keys = F.transform(
            F.slice(w, F.lit(1), F.size(w) - F.lit(2)),
            lambda x, i: _shift("shiftleft", F.xxhash64(x, F.get(w, i + F.lit(1)), F.get(w, i + F.lit(2))), bits).bitwiseOR(i.cast("bigint")),
        )

        def places(p: Column) -> Column:
            return F.sort_array(
                F.transform(
                    F.filter(p, lambda x, i: same(x, F.get(p, i - F.lit(1)), bits, mask) | same(x, F.get(p, i + F.lit(1)), bits, mask)),
                    lambda x: x.bitwiseAND(mask),
                )
            )

        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last"))
        return F.aggregate(
            let(F.sort_array(keys), places),
            start,
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("bigint"), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(F.length(F.bin(F.size(w))), count))


def measures(text: Column) -> Column:
    """All counts of a text as a struct of longs."""

    def of(w: Column, lines: Column) -> Column:
        n = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
            "n_lines": F.size(lines),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in n.items()))

    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return let(words(text), lambda w: let(full, lambda lines: of(w, lines)))


def verdicts(thresholds=THRESHOLDS) -> dict[str, Column]:
    """A boolean column for each rule of the table: true if a text passes; 0/0 counts as 0."""
    out = {}
    for name, top, below, least, most in thresholds:
        ratio = F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if least is not None:
            ok = ok & (ratio >= F.lit(least))
        if most is not None:
            ok = ok & (ratio <= F.lit(most))
        out[name] = ok
    return out


def score(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of each row of ``docs`` (doc_id, text).

    Null text counts as empty: no words, so it fails.  ``n_dup_lines`` are
    lines with a word that equal an earlier one; ``n_repeat_words`` are words
    in 3-word windows found twice or more.  Stop words are those of English,
    German, French and Spanish, in lower case as they stand; a text in another
    language fails by that rule, so its table of thresholds is to be another.
    Windows are told apart by 64 bits less those of the text's word count: in
    texts of millions of words, windows that share a hash with others that
    repeat, in turn with them, may be missed.  Rows are judged one by one:
    repeated rows and null ids get a row each, an empty table none.  Other
    columns are left out, so their names don't matter.
    """
    counted = docs.select("doc_id", measures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.lit(True)
    for ok in verdicts(thresholds).values():
        passed = passed & ok
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passed)
