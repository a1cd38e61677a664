"""Personal data by regular expressions, checksums and context words, in DataFrame functions only.

Spark gives the texts of a pattern's matches but not their places, so places
are summed up from the lengths of matches and of what lies between them.
Sums are collected in blocks, which keeps long match lists linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: Private-use characters that stand for a separator inside a run; texts' own become U+FFFD first.
INSIDE, DOT = "", ""


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, cheap test of whether it can match at all, and score rules."""

    name: str
    pattern: str
    needs: str
    base: float
    context: tuple[str, ...] = ()


#: The four base kinds, whose spans always stay.
BASE = (
    Kind("email", rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", 0.6, ("ip", "host", "address", "server")),
    Kind("card", rf"(?<![0-9{INSIDE}])[0-9](?:{INSIDE}?[0-9]){{12,18}}(?![0-9{INSIDE}])", r"[0-9](?:[ -]?[0-9]){12}", 0.5, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, ("phone", "call", "tel", "fax", "mobile")),
)
#: Kinds that the method adds; a span counts if its score reaches ACCEPT.
MORE = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", 0.4, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, ("ssn", "social security", "tax id")),
    Kind("local_phone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"[0-9]{3}[ .-][0-9]{4}", 0.3, ("phone", "call", "tel", "fax", "mobile")),
)
CHECKSUM_BONUS, CONTEXT_BONUS, ACCEPT = 0.5, 0.4, 0.7
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    doubled = F.transform(
        F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = F.aggregate(
        F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)),
        F.lit(0),
        lambda acc, x: F.when(x.rlike("[0-9]"), acc * 10 + F.ascii(x) - 48).otherwise(acc * 100 + F.ascii(x) - 55) % 97,
    )
    return value == 1


def matches(text: Column, kind: Kind) -> Column:
    """All matches of a text as structs of their text, start and end (code points, end exclusive)."""

    def placed(found: Column) -> Column:
        return let(F.transform(F.split(text, kind.pattern, -1), lambda x: F.length(x)), lambda between: summed(found, between))

    def summed(found: Column, between: Column) -> Column:
        pairs = F.transform(found, lambda x, i: F.struct(x.alias("m"), F.get(between, i).alias("gap")))
        span = "struct<m:string,start:int,end:int>"
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("now"), F.array().cast(f"array<array<{span}>>").alias("blocks"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            one = F.array(F.struct(x["m"].alias("m"), begin.alias("start"), (begin + F.length(x["m"])).alias("end")))
            full = F.size(acc["now"]) >= BLOCK
            return F.struct(
                (begin + F.length(x["m"])).alias("at"),
                F.when(full, one).otherwise(F.concat(acc["now"], one)).alias("now"),
                F.when(full, F.concat(acc["blocks"], F.array(acc["now"]))).otherwise(acc["blocks"]).alias("blocks"),
            )

        return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["now"]))))

    none = F.array().cast("array<struct<m:string,start:int,end:int>>")
    return F.when(text.rlike(kind.needs), let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)).otherwise(none)


def _marked(text: Column, kind: Kind) -> Column:
    """The text of the same length in which separators inside a card number or a domain have their own character."""
    if kind.name == "card":
        return F.regexp_replace(F.replace(text, F.lit(INSIDE), F.lit("�")), "(?<=[0-9])[ -](?=[0-9])", INSIDE)
    if kind.name == "email":
        return F.regexp_replace(F.replace(text, F.lit(DOT), F.lit("�")), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    return text


def _valid(kind: Kind, m: Column) -> Column:
    """The checks that a base match must pass."""
    if kind.name == "ip":
        parts = F.split(m, r"\.", -1)
        return F.forall(parts, lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3) & F.forall(parts, lambda x: F.coalesce(F.substring(F.regexp_replace(x, "^0+(?=[0-9])", ""), 1, 4).cast("int") <= 255, F.lit(False)))
    if kind.name == "card":
        return luhn(digits(m))
    if kind.name == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: Kind) -> Column:
    """Spans of a base kind. The text is marked only where the kind can match."""
    shortcut = F.when(text.rlike(kind.needs), _marked(text, kind)).otherwise(F.lit("")) if kind.name in ("email", "card") else text
    found = let(shortcut, lambda t: matches(t, Kind(kind.name, kind.pattern, "" if kind.name in ("email", "card") else kind.needs, kind.base)))
    return F.filter(found, lambda x: _valid(kind, x["m"]))


def has_context(text: Column, span: Column, context: tuple[str, ...]) -> Column:
    """Whether a context word stands near a span."""
    first = F.greatest(span["start"] - CONTEXT_BEFORE, F.lit(0))
    before = F.substr(text, first + 1, span["start"] - first)
    after = F.substr(text, span["end"] + 1, F.lit(CONTEXT_AFTER))
    pattern = "(?<![a-z])(?:" + "|".join(context) + ")(?![a-z])"
    return F.lower(before).rlike(pattern) | F.lower(after).rlike(pattern)


def score(text: Column, kind: Kind, span: Column) -> Column:
    """Base score of a kind, more for a checksum that holds and for context words nearby."""
    out = F.lit(kind.base)
    if kind.name == "iban":
        out = out + F.when(mod97(F.replace(span["m"], F.lit(" "), F.lit(""))), F.lit(CHECKSUM_BONUS)).otherwise(F.lit(-1.0))
    if kind.name == "card":
        out = out + F.lit(CHECKSUM_BONUS)
    if kind.context:
        out = out + F.when(has_context(text, span, kind.context), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
    return F.least(out, F.lit(1.0))


def added_spans(text: Column, kind: Kind, base: list[Column]) -> Column:
    """Spans of an added kind that stand free, overlap no base span and score enough."""

    def ok(x: Column) -> Column:
        near = F.concat(F.substr(text, F.greatest(x["start"], F.lit(1)), F.when(x["start"] > 0, 1).otherwise(0)), F.lit("\n"), F.substr(text, x["end"] + 1, F.lit(1)))
        apart = F.lit(True)
        for spans in base:
            apart = apart & ~F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return ~near.rlike("[A-Za-z0-9+-]") & apart & (score(text, kind, x) >= F.lit(ACCEPT))

    return F.filter(matches(text, kind), ok)


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and an array of spans (kind, start, end, score) for each kind, of each row of ``docs`` (doc_id, text).

    Places are code points, end exclusive.  Null text counts as empty and has
    no spans.  Rows are read one by one: repeated rows and null ids get a row
    each, an empty table none.  Other columns are left out, so their names
    don't matter.
    """
    text = F.col("_text")
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = out.select("doc_id", "_text", *(base_spans(text, k).alias(k.name) for k in BASE))
    out = out.select("*", *(added_spans(text, k, [F.col(b.name) for b in BASE]).alias(k.name) for k in MORE))

    def full(k: Kind) -> Column:
        return F.transform(F.col(k.name), lambda x: F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(score(text, k, x), 2).alias("score")))

    return out.select("doc_id", *(full(k).alias(k.name) for k in (*BASE, *MORE)))


def joined(kinds) -> Column:
    """kind:start:end of all spans, by kind as listed and start."""
    spans = F.concat(*(F.col(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scores(kinds) -> Column:
    """Scores of all spans in hundredths, in the same order."""
    spans = F.concat(*(F.col(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
