"""A scheme's pieces in a worker: the pattern in the standard library's terms, which is two to three times as fast.

The ``re`` module knows no classes of Unicode.  So each class of a published
pattern is written out as the ranges of characters that the ``regex`` module
finds in it, over the 65,536 characters of the basic plane; ``re`` looks these up
in a table.  A text with a character beyond them is left to ``regex``.
"""

from __future__ import annotations

import functools
import re

import regex

from . import schemes

#: A class in brackets (with nested ones), or an escape that stands for one.
_CLASS = regex.compile(r"(\[(?:\\p\{\w+\}|\\.|[^\[\]\\]|(?1))*\])|\\p\{\w+\}|\\[sS]")
_BEYOND = re.compile(r"[^\x00-￿]")


@functools.cache
def _ranges(found: str) -> str:
    """The characters of a class as ranges of code points."""
    plane = "".join(map(chr, range(0x10000)))
    runs = [m.span() for m in regex.finditer(f"(?:{found})+", plane, regex.V1)]
    return "[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in runs) + "]"


def standard(pattern: str) -> str:
    """A pattern whose classes are written out."""
    return _CLASS.sub(lambda m: _ranges(m[0]), pattern)


class Pieces:
    """Pieces of texts under a scheme; texts may hold lone surrogates."""

    def __init__(self, scheme: str = schemes.DEFAULT):
        patterns = schemes.PATTERNS[schemes.by_name(scheme)]
        self.whole = [regex.compile(p, regex.V1) for p in patterns]
        self.plane = [re.compile(standard(p)) for p in patterns]

    def __call__(self, text: str) -> list[str]:
        patterns = self.plane if text.isascii() or _BEYOND.search(text) is None else self.whole
        if len(patterns) == 1:
            return patterns[0].findall(text)
        out = [text] if text else []
        for pattern in patterns:
            parts = []
            for piece in out:
                at = 0
                for m in pattern.finditer(piece):
                    parts += [piece[at : m.start()], m[0]]
                    at = m.end()
                parts.append(piece[at:])
            out = [p for p in parts if p]
        return out
