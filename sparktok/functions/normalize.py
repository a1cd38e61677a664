"""Normalizers as columns; only NFC, which Spark lacks, is an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MARK = "▁"


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII goes by unchanged in the JVM."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(_nfc(text))


def add_prefix_space(text: Column) -> Column:
    """A space before a text that has none and isn't empty."""
    return F.when((text != "") & ~F.startswith(text, F.lit(" ")), F.concat(F.lit(" "), text)).otherwise(text)


def prepend(text: Column, prefix: str = MARK) -> Column:
    """A prefix before a text that isn't empty."""
    return F.when(text != "", F.concat(F.lit(prefix), text)).otherwise(text)


def replace(text: Column, pattern: str = " ", content: str = MARK) -> Column:
    """All of a literal, left to right."""
    return F.replace(text, F.lit(pattern), F.lit(content)) if pattern else text


def collapse_spaces(text: Column, content: str = MARK) -> Column:
    """Each run of two or more ASCII spaces as ``content``."""
    return F.regexp_replace(text, " {2,}", content.replace("\\", "\\\\").replace("$", "\\$"))


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    """Without white space (as Unicode has it) at its ends."""
    if left:
        text = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.regexp_replace(text, r"(?U)\s+\z", "") if right else text


def metaspace(text: Column, content: str = MARK, scheme: str = "always") -> Column:
    """Spaces as ``content``, and one before a text that doesn't begin with it unless ``scheme`` is never.

    The text is a whole document, at whose start "first" is "always".
    """
    text = replace(text, " ", content)
    if scheme == "never":
        return text
    return F.when((text != "") & ~F.startswith(text, F.lit(content)), F.concat(F.lit(content), text)).otherwise(text)


#: White space by Unicode's property (fixed values), as a Python class.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LEADING, _TRAILING = re.compile(f"^[{WHITE_SPACE}]+"), re.compile(f"[{WHITE_SPACE}]+\\Z")


def trim(text: str, left: bool = True, right: bool = True) -> str:
    """The same as ``strip`` for a Python string."""
    if left:
        text = _LEADING.sub("", text)
    return _TRAILING.sub("", text) if right else text
