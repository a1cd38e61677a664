"""Pretokenization schemes as Catalyst columns.

A scheme is the regular expression by which a tokenizer parts text before it
merges bytes.  Spark's ``regexp_extract_all`` runs it in the JVM; the ``(?U)``
flag gives ``\\s`` and case folding their Unicode meaning.  Every scheme
partitions a text: its pieces joined are the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published patterns, by the scheme's name (fixed values).
PATTERNS: dict[str, tuple[str, ...]] = {
    "gpt2": (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",),
    "gpt4": (r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s+",),
    "qwen2": (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "qwen35": (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+|\p{N}| ?[^\s\p{L}\p{M}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "olmo3": (r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "o200k": (r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "nemotron": (r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "kimi": (r"[\p{Han}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]+[\p{Ll}\p{Lm}\p{Lo}\p{M}&&[^\p{Han}]]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+",),
    "deepseek_v3": (
        r"\p{N}{1,3}",
        "[一-龥぀-ゟ゠-ヿ]+",
        "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~][A-Za-z]+|[^\r\n\\p{L}\\p{P}\\p{S}]?[\\p{L}\\p{M}]+| ?[\\p{P}\\p{S}]+[\r\n]*|\\s*[\r\n]+|\\s+(?!\\S)|\\s+",
    ),
}
#: A second published spelling of gpt4, read as the first (fixed value).
OTHER_SPELLINGS = {(r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+",): "gpt4"}
ALIASES = {"r50k": "gpt2", "cl100k": "gpt4"}
DEFAULT = "gpt2"


def by_name(name: str) -> str:
    """Canonical name of a scheme; ValueError if there is none."""
    found = ALIASES.get(name, name)
    if found not in PATTERNS:
        raise ValueError(f"unknown pretokenizer scheme: {name!r}")
    return found


def by_patterns(patterns: tuple[str, ...]) -> str:
    """The scheme that a tokenizer's split patterns, in order, stand for."""
    for name, own in PATTERNS.items():
        if own == tuple(patterns):
            return name
    if tuple(patterns) in OTHER_SPELLINGS:
        return OTHER_SPELLINGS[tuple(patterns)]
    raise ValueError(f"unsupported split pattern: {list(patterns)}")


def java(pattern: str) -> str:
    """A pattern as java.util.regex reads it; ``$`` is the very end of the text."""
    return "(?U)" + pattern.replace(r"\p{Han}", r"\p{IsHan}").replace(r"\s++$", r"\s++\z")


def interleave(text: Column, pattern: str) -> Column:
    """The matches of a Java pattern and what lies between them, in order, without empty strings."""

    def mixed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        return F.array_remove(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(found, i), F.lit(""))))), "")

    # Inside the outer lambda the matches are a variable, worked out once for each text.
    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), mixed), 1)


def _deepseek_in_one_pass() -> str:
    """The three splits of deepseek_v3 as one Java pattern.

    The first two set digits and two scripts apart, so these end a text for the
    third: they are taken out of its classes and count as an end in its
    lookahead.  Runs of the scripts are split by the third, too.  What it leaves
    unmatched, characters of no class that no letter follows, is a piece.
    """
    apart = "一-龥぀-ゟ゠-ヿ"
    letters, signs, others = r"[\p{L}\p{M}]", r"[\p{P}\p{S}]", r"[^\s\p{L}\p{M}\p{N}\p{P}\p{S}]"
    letter_in, sign_in, other_in = (f"[{apart}&&{x}]" for x in (letters, signs, others))
    letter, sign, other = (f"[{x}&&[^{apart}]]" for x in (letters, signs, others))
    pieces = (
        r"\p{N}{1,3}",
        f"{other_in}?{letter_in}+",
        f"{sign_in}+",
        f"(?:{other_in}(?!{letter_in}))+",
        r"[!-/:-@\[-`{-~][A-Za-z]+",
        rf"[^\r\n\p{{L}}\p{{N}}\p{{P}}\p{{S}}{apart}]?{letter}+",
        rf" ?{sign}+[\r\n]*",
        r"\s*[\r\n]+",
        rf"\s+(?![^\s\p{{N}}{apart}])",
        r"\s+",
        f"(?:{other}(?!{letter}))+",
    )
    return "(?U)" + "|".join(pieces)


def pretokens(text: Column, scheme: str = DEFAULT) -> Column:
    """Array of a text's pieces under a scheme; empty text has none, null stays null."""
    name = by_name(scheme)
    pattern = _deepseek_in_one_pass() if name == "deepseek_v3" else java(PATTERNS[name][0])
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
