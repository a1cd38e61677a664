"""Secrets in texts and in what is encoded inside them.

Each text starts a worklist of layers.  A layer is scanned, then searched for
encoded parts: percent and Unicode escapes are undone in place, base64 (plain,
URL-safe, wrapped in lines) is unwrapped token by token, and zlib and gzip
streams in it, and in one another, are unpacked.  Every result is a new layer
unless the same content from the same place has been met in this text, which
ends cycles, and layers are taken until none is left.  A layer knows for each
of its characters where it came from, so spans map back to the text.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Every match of ASSIGN has one of these in lower case.
HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
CHARACTERS = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Such a run that goes on in the next lines, as mail and PEM files wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t\r]*+\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Where in such a run a zlib or gzip stream may begin: by their first bytes without a dictionary or unknown flags.
STREAM = re.compile(r"(?:^|(?<=[/_-]))(?:e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])|H4sI[A-H])")
#: A compressed part that unpacks to more is read in pieces that overlap.
LARGEST, OVERLAP, SLICE = 1 << 24, 1 << 16, 1 << 16
_ABOVE = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
CONTROLS = bytes(b for b in range(32) if b not in b"\t\n\r")
UTF8 = re.compile(rb"(?:[\x00-\x7f]|" + _ABOVE + rb")+")
#: Readable stretches of bytes; the shortest secret has 14 characters.
STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|" + _ABOVE + rb"){14,}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base secrets of one layer: kind, start, end, by start and kind."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Layer:
    """Decoded text; ``begin[i]`` and ``end[i]`` are where its character i came from (None: itself)."""

    text: str
    begin: np.ndarray | None
    end: np.ndarray | None
    depth: int

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.begin is None:
            return a, b
        return int(self.begin[a]), int(self.end[b - 1])

    def key(self) -> bytes:
        """Digest of the text and of where its characters begin; ends differ by padding where two ways lead to one part."""
        digest = xxhash.xxh3_128(self.text.encode("utf-8", "surrogatepass"))
        if self.begin is not None:
            digest.update(np.ascontiguousarray(self.begin, dtype=np.int64))
        return digest.digest()


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all runs of a pattern decoded where they stand."""
    parts, begins, ends, at, changed = [], [], [], 0, False
    n = len(layer.text)
    whole_begin = layer.begin if layer.begin is not None else np.arange(n)
    whole_end = layer.end if layer.end is not None else np.arange(1, n + 1)
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        text, first, last = got
        changed = True
        parts += [layer.text[at : m.start()], text]
        begins += [whole_begin[at : m.start()], whole_begin[m.start() + first]]
        ends += [whole_end[at : m.start()], whole_end[m.start() + last - 1]]
        at = m.end()
    if not changed:
        return None
    parts.append(layer.text[at:])
    begins.append(whole_begin[at:])
    ends.append(whole_end[at:])
    return Layer("".join(parts), np.concatenate(begins), np.concatenate(ends), layer.depth + 1)


def _percent(run: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """Bytes that aren't UTF-8 stay as they stand."""
    data, at, parts, sizes = bytes.fromhex(run.replace("%", "")), 0, [], []
    for m in UTF8.finditer(data):
        text = m[0].decode()
        parts += [run[3 * at : 3 * m.start()], text]
        sizes += [1] * (3 * (m.start() - at)) + [3 * len(c.encode()) for c in text]
        at = m.end()
    if not parts:
        return None
    parts.append(run[3 * at :])
    sizes += [1] * len(parts[-1])
    stops = np.cumsum(sizes)
    return "".join(parts), stops - sizes, stops


def _unicode(run: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """Half surrogate pairs stay as they stand."""
    units = [(int(m[1] or m[2], 16), m.start(), m.end()) for m in ESCAPE.finditer(run)]
    text, first, last, k, changed = [], [], [], 0, False
    while k < len(units):
        code, a, b = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, b, k = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, units[k + 1][2], k + 1
        k += 1
        if 0xD800 <= code < 0xE000:
            text.append(run[a:b]), first.extend(range(a, b)), last.extend(range(a + 1, b + 1))
            continue
        text.append(chr(code)), first.append(a), last.append(b)
        changed = True
    return ("".join(text), np.array(first), np.array(last)) if changed else None


def _wbits(data: bytes) -> int | None:
    if data[:2] == b"\x1f\x8b":
        return 16 + zlib.MAX_WBITS
    return zlib.MAX_WBITS if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0 else None


class Feed:
    """Bytes that come in chunks, taken a few at a time; what was too much can be given back."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.now, self.at, self.done = iter(chunks), memoryview(b""), 0, 0

    def take(self, most: int) -> memoryview:
        while self.at >= len(self.now):
            chunk = next(self.chunks, None)
            if chunk is None:
                return memoryview(b"")
            self.now, self.at = memoryview(chunk), 0
        got = self.now[self.at : self.at + most]
        self.at += len(got)
        self.done += len(got)
        return got

    def back(self, count: int) -> None:
        self.at -= count
        self.done -= count

    def peek(self, most: int) -> bytes:
        got = bytes(self.take(most))
        while len(got) < most and (more := self.take(most - len(got))):
            got += more
            if len(more) == self.at:  # it is all that was taken of a new chunk: put both in front of the rest
                self.now, self.at = memoryview(got + bytes(self.now[self.at :])), len(got)
        self.back(len(got))
        return got


@dataclass
class Taken:
    """Where a stream's members begin, and how far it has been read."""

    starts: list[int] = field(default_factory=list)
    end: int = 0


def _inflated(feed: Feed, taken: Taken | None = None) -> Iterator[bytes]:
    """Parts of what all members of a stream hold, in order; ends where it breaks."""
    taken = taken or Taken()
    while (wbits := _wbits(feed.peek(3))) is not None:
        taken.starts.append(feed.done)
        stream, size = zlib.decompressobj(wbits), 1 << 9
        while not stream.eof:
            some = stream.unconsumed_tail or feed.take(size)
            size, taken.end = min(2 * size, SLICE), feed.done
            try:
                out = stream.decompress(some, 1 << 20)
            except zlib.error:
                return
            taken.end = feed.done - len(stream.unused_data)
            if out:
                yield out
            elif not some:
                return
        feed.back(len(stream.unused_data))
        while some := feed.take(SLICE):
            left = len(bytes(some).lstrip(b"\0"))
            feed.back(left)
            if left:
                break


def pieces(data: bytes, limit: int = LARGEST, overlap: int = OVERLAP, taken: Taken | None = None) -> Iterator[bytes]:
    """All that a stream's members hold, in pieces of about ``limit`` bytes that overlap; none if it is no stream.

    What is itself a stream is unpacked in turn, each level read through to its
    end; a level whose content was met before, as that of a stream that holds
    itself, is the last.  A level that fits in one piece is kept for the next,
    a longer one is unpacked anew.
    """
    make, seen = (lambda: _inflated(Feed([data]), taken)), set()
    while True:
        held, new, cut, head, digest = bytearray(), 0, False, b"", xxhash.xxh3_128()
        for out in make():
            digest.update(out)
            head = (head + out[:3])[:3]
            held += out
            new += len(out)
            if new >= limit:
                yield bytes(held)
                held, new, cut = held[-overlap:], 0, True
        if new:
            yield bytes(held)
        if _wbits(head) is None or digest.digest() in seen:
            return
        seen.add(digest.digest())
        if cut:
            make = lambda m=make: _inflated(Feed(m()))
        else:
            make = lambda d=bytes(held): _inflated(Feed([d]))


def _readable(data: bytes) -> str | None:
    """Decoded bytes as text if they look like one: UTF-8 with hardly a control character."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = len(data) - len(data.translate(None, CONTROLS))
    return text if text and odd * 20 <= len(text) else None


def _texts(data: bytes) -> Iterator[tuple[str, bytes, int]]:
    """The readable text that bytes hold, or its readable stretches, with their bytes and where these begin."""
    text = _readable(data)
    if text is not None:
        yield text, data, 0
    else:
        yield from ((m[0].decode(), m[0], m.start()) for m in STRETCH.finditer(data))


def _bytes(token: str) -> bytes:
    """Bytes of a run of base64 without padding, but for a last character that is too much."""
    token = token[: len(token) - (len(token) % 4 == 1)]
    return base64.b64decode(token + "=" * (-len(token) % 4))


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Runs of base64 characters with the place of each: those of one line, and lines put together where they are wrapped.

    Wrapped lines but the first and the last hold nothing else and a multiple
    of four characters; the first may begin with other text.
    """
    for m in BASE64.finditer(text):
        yield m[0].rstrip("="), np.arange(m.start(), m.end())
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in CHARACTERS.finditer(text, *m.span())]
        first = 0
        for k in range(1, len(lines)):
            if k == len(lines) - 1 or (lines[k][1] - lines[k][0]) % 4:
                some = lines[first : k + 1]
                padded = m.end() if k == len(lines) - 1 else lines[k][1]
                yield "".join(text[a:b] for a, b in some), np.concatenate([*(np.arange(a, b) for a, b in some), np.arange(lines[k][1], padded)])
                first = k


def _packed(layer: Layer) -> Iterator[Layer]:
    """Texts inside base64 tokens of a layer; three bytes come from four characters.

    A token may stand behind others of its characters, as in a path, so each
    run is decoded at all four alignments, and streams are unpacked from where
    one may begin.
    """
    for run, places in _runs(layer.text):
        stop = int(places[-1]) + 1
        places = places[: len(run)]
        plain = run.replace("-", "+").replace("_", "/")
        decoded = [_bytes(plain[k:]) for k in range(4)]

        def mapped(text: str, first: np.ndarray, last: np.ndarray) -> Layer:
            if layer.begin is not None:
                first, last = layer.begin[first], layer.end[last - 1]
            return Layer(text, first, last, layer.depth + 1)

        known: set[int] = set()  # where members begin that were unpacked with those before them
        for s in STREAM.finditer(run):
            if s.start() in known:
                continue
            k, taken = s.start() % 4, Taken()
            for piece in pieces(memoryview(decoded[k])[s.start() // 4 * 3 :], taken=taken):
                # Where the stream ends is known once its first level is read, as it is but for very long ones.
                last = min(s.start() + -(-taken.end // 3) * 4, len(run)) if len(piece) < LARGEST else len(run)
                for text, _, _ in _texts(piece):
                    got = mapped(text, places[s.start()][None], np.array([places[last - 1] + 1 if last < len(run) else stop]))
                    yield Layer(text, np.broadcast_to(got.begin, len(text)), np.broadcast_to(got.end, len(text)), got.depth)
            known.update(s.start() + m // 3 * 4 for m in taken.starts if m % 3 == 0)
        for k in range(4):
            for text, data, at in _texts(decoded[k]):
                begins = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
                stops = np.append(begins[1:], len(data)) + at
                first, last = (begins + at) // 3 * 4 + k, np.minimum(((stops - 1) // 3 + 1) * 4 + k, len(run))
                yield mapped(text, places[first], np.where(last < len(run), places[last - 1] + 1, stop))


def _decoded(layer: Layer) -> Iterator[Layer]:
    """What is encoded in a layer, one after the other."""
    yield from _packed(layer)
    if "%" in layer.text and (got := _in_place(layer, PERCENT, _percent)):
        yield got
    if "\\" in layer.text and (got := _in_place(layer, UNICODE, _unicode)):
        yield got


def layers(text: str) -> Iterator[Layer]:
    """The text and all that is decoded from it, each content once for each place that it came from."""
    seen: dict[bytes, int] = {}
    work = [iter([Layer(text, None, None, 0)])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if seen.get(key, layer.depth + 1) <= layer.depth:
            continue
        seen[key] = layer.depth
        yield layer
        work.append(_decoded(layer))


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans (kind, start, end) of the text itself, and all spans with their depth; by start and kind."""
    base: list[tuple[str, int, int]] = []
    every: dict[tuple[str, int, int], int] = {}
    for layer in layers(text):
        for kind, a, b in scan(layer.text):
            if layer.depth == 0:
                base.append((kind, a, b))
            span = (kind, *layer.span(a, b))
            every[span] = min(layer.depth, every.get(span, layer.depth))
    spans = sorted(((*s, d) for s, d in every.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, spans


def redact(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that touch go together."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


OUT = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int,depth:int>>"


def find_all(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of each row of ``docs`` (doc_id, text).

    Base spans are those of the text as it stands; ``spans`` has them and those
    found in decoded layers, mapped to the characters that they came from.
    Null text counts as empty.  Rows are read one by one: repeated rows and
    null ids get a row each, an empty table none.  Other columns are left out,
    so their names don't matter.
    """
    ship(docs.sparkSession)
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t or "") for t in batch.column("text").to_pylist()]
            base = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x, _ in found]
            spans = [[dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, base_type), pa.array(spans, span_type)], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, OUT)


def redact_all(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in its text column replaced by their kinds; all columns stay as they are.

    Null text stays null, a text without secrets as it is.  Spans that overlap
    or tie are replaced together, by the kind of the first (in the order of
    ``find``).  Each row is read by itself: repeated rows come out alike, an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redact(t, find(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def joined(spans: str):
    """kind:start:end of an array of spans, comma-joined in its order."""
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
