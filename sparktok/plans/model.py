"""What a tokenizer is: an immutable description that is broadcast once and also readable as tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class AddedToken:
    """A literal that is one token wherever it stands."""

    content: str
    id: int
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False
    special: bool = False


@dataclass(frozen=True)
class Metaspace:
    """Spaces become ``content``; ``prepend`` is always, first or never; ``split`` keeps merges inside words."""

    content: str = "▁"
    prepend: str = "always"
    split: bool = True


@dataclass(frozen=True)
class TokenizerModel:
    """Vocabulary, ranked merges and the rules of the text before them.

    ``kind`` is "byte" (byte-level, pretokenized by ``scheme``) or "piece"
    (SentencePiece-style with byte fallback).  ``vocab`` is by id, b"" where an
    id is not assigned.  ``merges`` are (left id, right id, merged id) in order
    of rank.  ``steps`` are the piece normalizers: (name, arguments).
    """

    kind: str
    vocab: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    added: tuple[AddedToken, ...] = ()
    scheme: str = "gpt2"
    nfc: bool = False
    prefix_space: bool = False
    ignore_merges: bool = False
    steps: tuple[tuple[str, tuple], ...] = ()
    metaspace: Metaspace | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    @cached_property
    def digest(self) -> str:
        """Identifies the model in workers' caches."""
        return hashlib.sha256(repr((self.kind, self.vocab, self.merges, self.added, self.scheme, self.nfc, self.prefix_space, self.ignore_merges, self.steps, self.metaspace)).encode()).hexdigest()

    @property
    def vocab_size(self) -> int:
        """Highest id and one; holes count."""
        return len(self.vocab)

    def vocab_dict(self) -> dict[int, bytes]:
        return {i: b for i, b in enumerate(self.vocab) if b}

    def merge_bytes(self) -> list[tuple[bytes, bytes]]:
        return [(self.vocab[a], self.vocab[b]) for a, b, _ in self.merges]

    def with_added(self, *tokens: AddedToken) -> TokenizerModel:
        """This model with more added tokens, whose contents stand in the vocabulary at their ids."""
        vocab = list(self.vocab)
        for t in tokens:
            if t.id < 0 or not t.content:
                raise ValueError(f"an added token has a content and an id from 0, not {t.content!r} and {t.id}")
            vocab += [b""] * (t.id + 1 - len(vocab))
            vocab[t.id] = t.content.encode()
        return replace(self, vocab=tuple(vocab), added=(*self.added, *tokens))

    def with_options(self, **changes) -> TokenizerModel:
        """This model with another scheme, normalization or rule of merges."""
        allowed = {"scheme", "nfc", "prefix_space", "ignore_merges", "steps", "metaspace"}
        if not set(changes) <= allowed:
            raise ValueError(f"options are {', '.join(sorted(allowed))}, not {', '.join(sorted(set(changes) - allowed))}")
        return replace(self, **changes)

    def special_tokens(self) -> dict[str, int]:
        return {t.content: t.id for t in self.added if t.special}

    def __repr__(self) -> str:
        return f"TokenizerModel(kind={self.kind!r}, vocab_size={self.vocab_size}, merges={len(self.merges)}, scheme={self.scheme!r})"

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(b)) for i, b in sorted(self.vocab_dict().items())], "id int, bytes binary")

    def merges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(rank, *m) for rank, m in enumerate(self.merges)], "rank int, left int, right int, merged int")

    def added_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.id, t.content, t.lstrip, t.rstrip, t.normalized, t.special) for t in self.added], "id int, content string, lstrip boolean, rstrip boolean, normalized boolean, special boolean")
