"""Encoding and decoding with a memory of words: the body of the Arrow functions.

Ids are handled as bytes, four to an id: a text's are those of its words put
end to end, so that no id becomes a Python number, and a batch's become an
Arrow array as they are.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from ..functions.normalize import trim
from ..functions.pieces import Pieces
from ..plans.loaders import BYTE_TOKEN
from ..plans.model import AddedToken, TokenizerModel
from .charsmap import Charsmap
from .merging import Table, merge

#: Characters of texts whose new words are merged together, and the length of those worth it.
TOGETHER, MERGED_LENGTH = 1 << 20, 64
#: Bytes of words that an encoder remembers in each of two generations, what an entry takes beside its word and ids, and the length of words worth it.
MEMO_BYTES, ENTRY_BYTES, MEMO_LENGTH = 48 << 20, 180, 256


def code(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Memo(dict):
    """Ids by word, as bytes, in bounded memory; words that were ``given`` are never forgotten.

    When a generation is full, it becomes the old one, and the one before that
    is forgotten.  An old word that is met again goes on into the new one, so
    words that come back often are merged once.
    """

    def __init__(self, make: Callable[[str], list[int]], given: dict[str, bytes] | None = None, most: int = MEMO_BYTES):
        super().__init__(given or {})
        self.make, self.given, self.most = make, given or {}, most
        self.old: dict[str, bytes] = {}
        self.size = 0

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = code(self.make(word))
        if len(word) <= MEMO_LENGTH:
            self.add([word], [found])
        return found

    def new(self, words: Iterable[str]) -> list[str]:
        """Those of some words that it doesn't know."""
        return [w for w in words if w not in self and w not in self.old]

    def add(self, words: list[str], codes: list[bytes]) -> None:
        if self.size > self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.given)
            self.size = 0
        self.update(zip(words, codes, strict=True))
        self.size += ENTRY_BYTES * len(words) + sum(map(len, words)) + sum(map(len, codes))


def literals(tokens: list[AddedToken]) -> re.Pattern | None:
    """Matches the longest of the literals that begin furthest left."""
    contents = sorted({t.content for t in tokens if t.content}, key=lambda c: (-len(c), c))
    return re.compile("|".join(map(re.escape, contents))) if contents else None


class Splitter:
    """Parts a text at added tokens: yields text (not empty) and token ids."""

    def __init__(self, tokens: list[AddedToken]):
        self.pattern = literals(tokens)
        self.by_content = {t.content: t for t in tokens}

    def __call__(self, text: str) -> Iterator[str | int]:
        if self.pattern is None:
            if text:
                yield text
            return
        at = 0
        for m in self.pattern.finditer(text):
            if m.start() < at:
                continue
            token = self.by_content[m[0]]
            before = text[at : m.start()]
            if token.lstrip:
                before = trim(before, left=False)
            if before:
                yield before
            yield token.id
            at = m.end()
            if token.rstrip:
                at = len(text) - len(trim(text[at:], right=False))
        if at < len(text):
            yield text[at:]


class ByteEncoder:
    """Byte-level BPE."""

    def __init__(self, model: TokenizerModel):
        self.model = model
        self.split = Splitter(list(model.added))
        self.ranks = {}
        for rank, (a, b, merged) in enumerate(model.merges):
            self.ranks.setdefault((a, b), (rank, merged))
        single = {b[0]: i for i, b in reversed(list(enumerate(model.vocab))) if len(b) == 1}
        self.single = [single.get(b, -1) for b in range(256)]
        self.singles, self.table = np.array(self.single), Table(self.ranks)
        self.whole = {b: i for i, b in reversed(list(enumerate(model.vocab))) if b} if model.ignore_merges else {}
        self.pieces = Pieces(model.scheme)
        self.memo = Memo(self.word)
        # Without a split at added tokens, a piece that is one's content is that token (fixed: of up to 15 bytes).
        whole = {t.content: code([t.id]) for t in model.added if 1 <= len(t.content.encode()) <= 15}
        self.ordinary = Memo(self.word, whole) if whole else self.memo

    def word(self, piece: str) -> list[int]:
        """Ids of one piece, by merges."""
        data = piece.encode("utf-8", "surrogateescape")
        whole = self.whole.get(data)
        return [whole] if whole is not None else merge([s for b in data if (s := self.single[b]) >= 0], self.ranks)

    def parts(self, text: str) -> Iterator[int | list[str]]:
        """Added tokens of a text, and the pieces between them."""
        for part in self.split(text):
            if isinstance(part, int):
                yield part
                continue
            if self.model.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.model.prefix_space and not part.startswith(" "):
                part = " " + part
            yield self.pieces(part)

    def packed(self, text: str) -> bytes:
        """Ids of a text, as bytes."""
        return self._joined(self.parts(text), self.memo)

    @staticmethod
    def _joined(parts: Iterator[int | list[str]] | list[int | list[str]], memo: Memo) -> bytes:
        return b"".join(code([p]) if isinstance(p, int) else b"".join(map(memo.__getitem__, p)) for p in parts)

    def learn(self, words: list[str], memo: Memo) -> None:
        """Ids of new words, all of them merged together."""
        data = [w.encode("utf-8", "surrogateescape") for w in words]
        single = self.singles[np.frombuffer(b"".join(data), dtype=np.uint8)]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        if (single < 0).any():
            owner = np.repeat(np.arange(len(sizes)), sizes)[single >= 0]
            single, sizes = single[single >= 0], np.bincount(owner, minlength=len(sizes))
        found, sizes = self.table.merge(single, sizes)
        whole = found.astype("<i4").tobytes()
        cuts = (4 * np.cumsum(np.concatenate([[0], sizes]))).tolist()
        memo.add(words, [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])

    def packed_all(self, texts: list[str | None], added: bool = True) -> list[bytes | None]:
        """Ids of many texts; ``added`` False: nothing is looked for but words."""
        memo, out, a, size = self.memo if added else self.ordinary, [], 0, 0
        for b, text in enumerate(texts, 1):
            size += len(text or "")
            if size < TOGETHER and b < len(texts):
                continue
            found = [None if t is None else list(self.parts(t)) if added else [self.pieces(t)] for t in texts[a:b]]
            every = {w for parts in found if parts for p in parts if not isinstance(p, int) for w in p}
            new = [w for w in memo.new(every) if len(w) <= MERGED_LENGTH]
            self.learn([w for w in new if w.encode("utf-8", "surrogateescape") not in self.whole] if self.whole else new, memo)
            out += [None if parts is None else self._joined(parts, memo) for parts in found]
            a, size = b, 0
        return out

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()


class PieceEncoder:
    """SentencePiece-style BPE with byte fallback."""

    def __init__(self, model: TokenizerModel):
        self.model = model
        self.raw = Splitter([t for t in model.added if not t.normalized])
        self.maps = {args: Charsmap(args[0]) for name, args in model.steps if name == "charsmap"}
        self.late = Splitter([AddedToken(self.normalize(t.content), t.id, t.lstrip, t.rstrip) for t in model.added if t.normalized])
        self.ranks = {}
        for rank, (a, b, merged) in enumerate(model.merges):
            self.ranks.setdefault((a, b), (rank, merged))
        self.symbols: dict[str, int] = {}
        self.bytes: list[int | None] = [None] * 256
        for piece, i in model.extra["pieces"].items():
            if m := BYTE_TOKEN.fullmatch(piece):
                self.bytes[int(m[1], 16)] = i
            elif len(piece) == 1:
                self.symbols[piece] = i
        self.memo = Memo(self.word)
        mark = model.metaspace.content if model.metaspace else ""
        # Words behind a mark, without it.
        self.marked_words = Memo(lambda word: self.word(mark + word))

    def normalize(self, text: str) -> str:
        for name, args in self.model.steps:
            if name == "prepend":
                text = args[0] + text if text else text
            elif name == "replace":
                text = text.replace(*args) if args[0] else text
            elif name == "collapse":
                text = re.sub(" {2,}", lambda m, new=args[0]: new, text)
            elif name == "strip":
                text = trim(text, *args)
            else:
                text = self.maps[args](text)
        return text

    def word(self, piece: str) -> list[int]:
        """Ids of one piece, by merges."""
        start: list[int] = []
        for c in piece:
            own = self.symbols.get(c)
            start += [own] if own is not None else [i for b in c.encode() if (i := self.bytes[b]) is not None]
        return merge(start, self.ranks)

    def marked(self, text: str, first: bool) -> str:
        """Normalized text between added tokens with its space marks; ``first``: at the start of the document."""
        meta = self.model.metaspace
        if meta is None:
            return text
        text = text.replace(" ", meta.content)
        if text and not text.startswith(meta.content) and (meta.prepend == "always" or meta.prepend == "first" and first):
            text = meta.content + text
        return text

    def sections(self, text: str, normalized: bool = False) -> Iterator[int | str]:
        """Added tokens of a text, and what is between them, normalized and with marks."""
        for n, part in enumerate(self.raw(text)):
            if isinstance(part, int):
                yield part
                continue
            for m, inner in enumerate(self.late(part if normalized else self.normalize(part))):
                yield inner if isinstance(inner, int) else self.marked(inner, n == 0 and m == 0)

    def merged(self, section: str) -> bytes:
        """Ids of a section, as bytes."""
        if self.model.metaspace is not None and self.model.metaspace.split:
            # A mark begins a word; what is before the first one is a word, too.
            first, *rest = section.split(self.model.metaspace.content)
            return (self.memo[first] if first else b"") + b"".join(map(self.marked_words.__getitem__, rest))
        return self.memo[section] if section else b""

    def packed(self, text: str, normalized: bool = False) -> bytes:
        """Ids of a text, as bytes."""
        return b"".join(code([part]) if isinstance(part, int) else self.merged(part) for part in self.sections(text, normalized))

    def packed_all(self, texts: list[str | None], normalized: bool = False) -> list[bytes | None]:
        """Ids of many texts."""
        return [None if t is None else self.packed(t, normalized) for t in texts]

    def __call__(self, text: str, normalized: bool = False) -> list[int]:
        return np.frombuffer(self.packed(text, normalized), dtype="<i4").tolist()


Encoder = ByteEncoder | PieceEncoder


def encoder(model: TokenizerModel) -> Encoder:
    return (PieceEncoder if model.kind == "piece" else ByteEncoder)(model)


#: Bytes of texts that a decoder puts together at a time.
DECODED = 4 << 20


class Decoder:
    """Texts of many arrays of ids at once: the vocabulary's bytes end to end, gathered by place.

    An id beyond 32 bits (unsigned) is an error.  Byte-level: so is one that is
    outside the vocabulary.  Piece: such ids are passed over, the space mark
    becomes a space, and one space at the start goes if the model puts one
    there.  Bytes that aren't UTF-8 are replaced.
    """

    def __init__(self, model: TokenizerModel):
        self.model = model
        self.data = np.frombuffer(b"".join(model.vocab), dtype=np.uint8)
        self.stops = np.cumsum([0, *map(len, model.vocab)])
        self.sizes = np.diff(self.stops)
        self.mark = model.metaspace.content if model.metaspace else "▁"
        self.prepends = model.metaspace.prepend != "never" if model.metaspace else any(n == "prepend" for n, _ in model.steps)

    def packed(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of arrays of ids that lie end to end, ``counts`` of each."""
        ids = ids.astype(np.int64, copy=False)
        first = np.concatenate([[0], np.cumsum(counts)])
        beyond = np.nonzero((ids < 0) | (ids > 0xFFFFFFFF))[0]
        if len(beyond) and (self.model.kind == "piece" or ids[beyond[0]] > 0):
            raise OverflowError(f"id {ids[beyond[0]]} is not an unsigned number of 32 bits")
        known = (ids >= 0) & (ids < len(self.sizes))
        if not known.all():
            if self.model.kind == "byte":
                raise IndexError(f"id {ids[~known][0]} is outside the vocabulary of {len(self.sizes)}")
            ids, first = ids[known], np.concatenate([[0], np.cumsum(known)])[first]
        size = self.sizes[ids]
        stops = np.concatenate([[0], np.cumsum(size)])
        edges, out = stops[first], []
        a = 0
        while a < len(first) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + DECODED, "right")) - 1)
            n = size[first[a] : first[b]]
            begin = stops[first[a] : first[b]]
            place = np.arange(edges[b] - edges[a]) + np.repeat(self.stops[ids[first[a] : first[b]]] - (begin - edges[a]), n)
            data = self.data[place].tobytes()
            cuts = (edges[a : b + 1] - edges[a]).tolist()
            out += [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            a = b
        return out

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        out = [x.decode("utf-8", "replace") for x in self.packed(ids, counts)]
        return [self.plain(x) for x in out] if self.model.kind == "piece" else out

    def plain(self, text: str) -> str:
        """A piece model's text as it was before marks."""
        text = text.replace(self.mark, " ")
        return text[1:] if self.prepends and text.startswith(" ") else text

    def __call__(self, ids: pa.Array) -> pa.Array:
        """A column of lists as a column of texts; null stays null."""
        counts = np.array(pa.compute.list_value_length(ids).fill_null(0), dtype=np.int64)
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        return pa.array(self.texts(flat.to_numpy(zero_copy_only=False), counts), pa.string(), mask=np.array(ids.is_null()))


def decode(model: TokenizerModel, ids: list[int]) -> bytes:
    """Bytes of the ids of one text, by the rules of ``Decoder``."""
    decoder = Decoder(model)
    data = decoder.packed(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]
    return data if model.kind == "byte" else decoder.plain(data.decode("utf-8", "replace")).encode()
