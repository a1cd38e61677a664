"""Giant texts cut where no token can cross, encoded in parts on many tasks and put together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import AddedToken, TokenizerModel
from ..shipping import ship
from .encode import _cached, encode, lists
from .encoder import code
from .slices import slices

#: Characters of a fragment, about; a text of fewer is left whole.
TARGET = 16 << 20
#: No scheme's piece has a space between a letter or digit and a letter inside it: it begins the next one.
BOUNDARY = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


def cuts(text: str, target: int = TARGET, added: tuple[AddedToken, ...] = ()) -> list[int]:
    """Places at which a text can be cut, each the first that will do ``target`` characters or more behind the one before.

    Not inside an added token, nor right behind one that takes in the white space after it.
    """
    spaced = [t.content for t in added if " " in t.content]
    taking = tuple(t.content for t in added if t.rstrip and t.content)

    def free(at: int) -> bool:
        inside = any(0 <= text.find(c, max(0, at - len(c) + 1), at + len(c) - 1) < at for c in spaced)
        return not inside and not (taking and text.endswith(taking, 0, at))

    out, start = [], 0
    while True:
        found = next((m.start() for m in BOUNDARY.finditer(text, start + max(1, target)) if free(m.start())), None)
        if found is None:
            return out
        out.append(found)
        start = found


def fragments(df: DataFrame, model: TokenizerModel, key: str, text: str = "text", target: int = TARGET) -> DataFrame:
    """``key, fragment, text``: the parts of each text in order; a null text has none, an empty one is itself."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.added)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows, numbers, texts = [], [], []
            for k, whole in enumerate(batch.column(1).to_pylist()):
                if whole is None:
                    continue
                edges = [0, *cuts(whole, target, shared.value), len(whole)]
                rows += [k] * (len(edges) - 1)
                numbers += range(len(edges) - 1)
                texts += (whole[a:b] for a, b in zip(edges, edges[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[key, "fragment", text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, fragment int, `{text}` string")


def mark_of(model: TokenizerModel) -> str | None:
    """The mark in front of which sections of a piece model's texts can be cut, None if there is no such mark.

    Where words are merged one by one, each mark begins a word.  Else no token
    may hold a mark behind another character, for such a token could lie over a
    cut; then the mark is the one that spaces are replaced by.
    """
    spaces = (args[1] for name, args in reversed(model.steps) if name == "replace" and args[0] == " ")
    mark = model.metaspace.content if model.metaspace is not None else next(spaces, "")
    if len(mark) != 1:
        return None
    if model.metaspace is not None and model.metaspace.split:
        return mark
    crossing = re.compile(f"[^{re.escape(mark)}]{re.escape(mark)}")
    return None if any(crossing.search(model.vocab[c].decode("utf-8", "replace")) for _, _, c in model.merges) else mark


def marked_cuts(section: str, mark: str, target: int = TARGET) -> list[int]:
    """Places in front of marks behind other characters, each the first that will do ``target`` characters or more behind the one before."""
    found, start = re.compile(f"(?<=[^{re.escape(mark)}]){re.escape(mark)}"), 0
    out = []
    while (m := found.search(section, start + max(1, target))) is not None:
        out.append(start := m.start())
    return out


def sections(df: DataFrame, model: TokenizerModel, key: str, text: str = "text", target: int = TARGET, normalized: bool = False) -> DataFrame:
    """``key, fragment, token, text``: under a piece model each text's added tokens and what is between them, in order.

    What is between them is normalized, has its marks and is cut in front of
    marks.  A null text has no row, an empty one has one of its own.
    """
    mark = mark_of(model)
    if mark is None:
        raise ValueError("tokens of this model can lie over any place of a text, so texts can't be cut")
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _cached(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            of, numbers, tokens, texts = [], [], [], []
            for k, whole in enumerate(batch.column(1).to_pylist()):
                if whole is None:
                    continue
                rows: list[tuple[int | None, str | None]] = []
                for part in own.sections(whole, normalized):
                    if isinstance(part, int):
                        rows.append((part, None))
                    else:
                        edges = [0, *marked_cuts(part, mark, target), len(part)]
                        rows += ((None, part[a:b]) for a, b in zip(edges, edges[1:]))
                rows = rows or [(None, "")]
                of += [k] * len(rows)
                numbers += range(len(rows))
                tokens += (token for token, _ in rows)
                texts += (section for _, section in rows)
            same = batch.column(0).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([same, pa.array(numbers, pa.int32()), pa.array(tokens, pa.int32()), pa.array(texts, pa.string())], names=[key, "fragment", "token", text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, fragment int, token int, `{text}` string")


def _merged(parts: DataFrame, model: TokenizerModel, key: str, text: str, out: str) -> DataFrame:
    """``key, fragment`` and the ids of rows of ``sections``."""
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _cached(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 3)):
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ids = lists([own.merged(section) if token is None else code([token]) for token, section in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=[key, "fragment", out])

    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(work, f"`{key}` {kind}, fragment int, `{out}` array<int>")


def encode_long(df: DataFrame, model: TokenizerModel, key: str, text: str = "text", out: str = "ids", target: int = TARGET) -> DataFrame:
    """``df`` with the ids of each text, as ``encode`` gives them; texts beyond ``target`` characters are encoded by many tasks.

    ``key``, which is not null, tells rows with long texts apart.  Texts of byte-level models are
    cut at spaces between words, those of piece models, once they are
    normalized, at their marks; ``mark_of`` says which piece models allow that,
    and others are refused.  One task reads and normalizes a text, and one row
    takes its ids; merging, which is most of the work, is dealt out.
    """
    is_long = F.coalesce(F.length(text) > target, F.lit(False))
    if model.kind == "byte":
        parts = fragments(df.where(is_long), model, key, text, target).repartition(key, "fragment")
        coded = encode(parts, model, text, out)
    else:
        coded = _merged(sections(df.where(is_long), model, key, text, target).repartition(key, "fragment"), model, key, text, out)
    whole = coded.select(key, F.struct("fragment", out).alias("_part")).groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p[out])).alias(out))
    joined = df.where(is_long).join(whole, key)
    return encode(df.where(~is_long), model, text, out).unionByName(joined)
