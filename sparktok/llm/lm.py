"""A gated recurrent language model over words, trained and applied in numpy.

Every training document's words are counted over the whole corpus.  The most
frequent words (the head) each have an embedding; all others share one for
their class, which their ending decides.  The output softmax is factored: a
class first, then the word in it.  Words of a head class have a softmax of
their own, words of a tail class their smoothed share of the class's counts,
so that the model gives every text a probability, unknown words included.

Training is data-parallel and reads every training document once: in each
round, each task runs truncated backpropagation over its documents of that
round, and the parameters of all tasks are averaged after it.  Scoring reads every document from
its first word to its end and carries the state across windows.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PARTITION_SHIFT
from .scratch import Scratch
from .substr_dedup import from_planes, planes

CLASS_SIZE, HEAD_CLASSES, TAIL_CLASSES = 32, 32, 32
HEAD = CLASS_SIZE * HEAD_CLASSES
SYMBOLS = HEAD + TAIL_CLASSES
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: The class of each symbol.
CLASS_OF = np.concatenate([np.repeat(np.arange(HEAD_CLASSES), CLASS_SIZE), np.arange(HEAD_CLASSES, CLASSES)]).astype(np.uint8)
HIDDEN = 16
#: Every training document gives gradients once, in one of ROUNDS.
ROUNDS = 3
LANES, WINDOW, TRAIN_LANES, TRAIN_WINDOW = 256, 64, 128, 32
RATE, MEAN, SQUARE, CLIP = 0.01, 0.9, 0.999, 1.0
#: Parts of the words that are merged apart, by the bytes of the chunks' compressed lists.
MAX_PARTS, PART_BYTES = 1 << 16, 1 << 18
#: Averages of the tasks' models that the driver gets in a round.
TEAMS = 32
END = 0
LOG10 = float(np.log(10))


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 7 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return (text or b"").lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


# ---------------------------------------------------------------- words

#: Rows of a chunk: for each text its words as numbers within the chunk, and one row with the chunk's words and
#: how often its training texts have them.
CODED = "chunk long, row int, doc_id long, held_out boolean, numbers binary, words binary, counts binary"
SENT = "part int, chunk long, words binary, places binary, counts binary"
MERGED = "chunk long, places binary, counts binary, words binary, tokens binary, kinds binary"


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def coded(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Texts as numbers of words, in chunks of about ``chunk_bytes``; each text is parted into words this once."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "row", "doc_id", "held_out", "numbers", "words", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, row = TaskContext.get().partitionId() << PARTITION_SHIFT, 0, 0
        numbers, counts = Numbers(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, held in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                t = np.array([*map(numbers.__getitem__, words_of(text))], dtype="<u4")
                if len(numbers) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(numbers), dtype=np.int64)])
                if not held:
                    np.add.at(counts, t, 1)
                out.append((chunk, row, doc_id, held, planes(t), None, None))
                size, row = size + len(text or b""), row + 1
                if size >= chunk_bytes or row >= 1 << 16:
                    out.append(_words_row(chunk, numbers, counts))
                    chunk, size, row = chunk + 1, 0, 0
                    numbers, counts = Numbers(), np.zeros(0, dtype=np.int64)
            if out:
                yield given(out)
        if row:
            yield given([_words_row(chunk, numbers, counts)])

    return rows.select("doc_id", "text", "held_out").mapInArrow(work, CODED)


def _words_row(chunk: int, numbers: Numbers, counts: np.ndarray) -> tuple:
    return chunk, -1, None, None, None, zlib.compress(b" ".join(numbers), 1), planes(counts[: len(numbers)].astype("<u4"))


def _listed(words: bytes) -> list[bytes]:
    whole = zlib.decompress(words)
    return whole.split(b" ") if whole else []


def send_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """Each chunk's words, their numbers and counts, by part of the hash space."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, code in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                every = _listed(words)
                part = np.fromiter(map(zlib.crc32, every), dtype=np.uint32, count=len(every)) % np.uint32(parts)
                order, counts = np.argsort(part, kind="stable"), from_planes(code, "<u4")
                found, first = np.unique(part[order], return_index=True)
                out = [(int(p), chunk, zlib.compress(b" ".join([every[k] for k in at.tolist()]), 1), planes(at.astype("<u4")), planes(counts[at])) for p, at in zip(found, np.split(order, first[1:]), strict=False)]
                for k in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), kinds, strict=True)], names=["part", "chunk", "words", "places", "counts"])

    return chunks.where("words is not null").select("chunk", "words", "counts").mapInArrow(work, SENT)


def merge_counts(sent: DataFrame) -> DataFrame:
    """The corpus's counts of each chunk's words, by their numbers; for each part one row without chunk:
    its most frequent words, as many as the head takes, and tokens and distinct words by tail class."""

    def work(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for x, code in zip(table.column("words"), table.column("counts"), strict=True):
            for w, k in zip(_listed(x.as_py()), from_planes(code.as_py(), "<u4").tolist(), strict=True):
                if k:
                    total[w] += k
        out = [(c, at.as_py(), planes(np.array([total[w] for w in _listed(x.as_py())], dtype="<u8")), None, None, None) for c, at, x in zip(table.column("chunk").to_pylist(), table.column("places"), table.column("words"), strict=True)]
        tokens, kinds = np.zeros(TAIL_CLASSES, dtype=np.int64), np.zeros(TAIL_CLASSES, dtype=np.int64)
        for w, k in total.items():
            c = tail_class(w)
            tokens[c] += k
            kinds[c] += 1
        top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[: HEAD - 1]
        out.append((None, None, planes(np.array([k for _, k in top], dtype="<u8")), zlib.compress(b" ".join(w for w, _ in top)), tokens.tobytes(), kinds.tobytes()))
        cols = zip(*out, strict=True)
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["chunk", "places", "counts", "words", "tokens", "kinds"])

    return sent.groupBy("part").applyInArrow(work, MERGED)


def head_words(merged: DataFrame) -> DataFrame:
    """``word, count``: the most frequent words over all parts, ties by the word's bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_listed(words), pa.binary()), pa.array(from_planes(code, "<u8").astype(np.int64))], names=["word", "count"])

    flat = merged.where("chunk is null").select("words", "counts").mapInArrow(work, "word binary, count long")
    return flat.orderBy(F.desc("count"), "word").limit(HEAD - 1)


def tail_totals(merged: DataFrame) -> DataFrame:
    """``class, tokens, kinds``: tokens and distinct words by tail class over all parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, TAIL_CLASSES), dtype=np.int64)
        for batch in batches:
            for k, column in enumerate(batch.columns):
                total[k] += sum((np.frombuffer(x, dtype=np.int64) for x in column.to_pylist()), np.zeros(TAIL_CLASSES, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL_CLASSES, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["class", "tokens", "kinds"])

    flat = merged.where("chunk is null").select("tokens", "kinds").mapInArrow(work, "class int, tokens long, kinds long")
    return flat.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))


@dataclass
class Vocabulary:
    """Head words with their counts, and what is left of each tail class."""

    head: dict[bytes, int]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray
    ends: int

    @functools.cached_property
    def symbols(self) -> Symbols:
        """One memory of words for all tasks of a worker."""
        return Symbols(self)

    @staticmethod
    def of(tops: list[tuple[bytes, int]], tokens: np.ndarray, kinds: np.ndarray, ends: int) -> Vocabulary:
        chosen = sorted(tops, key=lambda x: (-x[1], x[0]))[: HEAD - 1]
        counts = np.zeros(HEAD, dtype=np.float64)
        counts[END] = ends
        tokens, kinds, head = tokens.copy(), kinds.copy(), {}
        for k, (w, c) in enumerate(chosen, 1):
            head[w], counts[k] = k, c
            tokens[tail_class(w)] -= c
            kinds[tail_class(w)] -= 1
        return Vocabulary(head, counts, tokens, kinds, ends)

    def symbol(self, word: bytes) -> int:
        found = self.head.get(word)
        return HEAD + tail_class(word) if found is None else found


class Symbols(dict):
    """Symbols by word, with a memory of at most ``most`` words outside the head."""

    def __init__(self, vocabulary: Vocabulary, most: int = 1 << 18) -> None:
        super().__init__(vocabulary.head)
        self.vocabulary, self.most = vocabulary, len(vocabulary.head) + most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.vocabulary.head)
        found = self[word] = HEAD + tail_class(word)
        return found


# ---------------------------------------------------------------- model


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # what overflows becomes 0
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Model:
    """Parameters by name, float32.

    x: symbol to gate inputs; u, b: state to gates; c, cb: state to classes; o,
    ob: state to the words of each head class.
    """

    p: dict[str, np.ndarray]

    @staticmethod
    def start(v: Vocabulary, seed: int = 7) -> Model:
        """Small random weights; output biases that give the counted shares of classes and words."""
        rng = np.random.default_rng(seed)

        def small(*shape: int, scale: float = 0.1) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {"x": small(SYMBOLS, 3 * HIDDEN, scale=0.3), "u": small(HIDDEN, 3 * HIDDEN, scale=0.25), "b": np.zeros(3 * HIDDEN, dtype=np.float32)}
        mass = np.concatenate([v.counts.reshape(HEAD_CLASSES, CLASS_SIZE).sum(axis=1), v.tail_tokens.astype(np.float64)])
        p |= {"c": small(HIDDEN, CLASSES), "cb": np.log(mass + 1.0).astype(np.float32)}
        ob = np.where(v.counts > 0, np.log(np.maximum(v.counts, 1)), -30.0).reshape(HEAD_CLASSES, CLASS_SIZE)
        p |= {"o": small(HEAD_CLASSES, HIDDEN, CLASS_SIZE), "ob": (ob - ob.max(axis=1, keepdims=True)).astype(np.float32)}
        return Model(p)

    def pack(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    def unpack(self, flat: np.ndarray) -> Model:
        out, at = {}, 0
        for k in sorted(self.p):
            n = self.p[k].size
            out[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Model(out)

    def run(self, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each token of a window (units, time, lanes); the state (units, lanes) after it.

        ``symbols[t]`` is the token that comes at t; ``fresh[t]`` says that a
        text begins there, with an empty state.  Lanes lie side by side in
        memory, so that each step is a few passes over long rows.
        """
        p, n = self.p, HIDDEN
        length, lanes = symbols.shape
        states = np.empty((n, length, lanes), dtype=np.float32)
        kept = np.empty((5, length, n, lanes), dtype=np.float32) if keep is not None else None
        gates = np.take((p["x"] + p["b"]).T, symbols.ravel(), axis=1).reshape(3 * n, length, lanes)
        u, starts = np.ascontiguousarray(p["u"].T), fresh.any(axis=1)
        for t in range(length):
            if starts[t]:
                h = h * ~fresh[t]
            states[:, t] = h
            a = u @ h
            g = gates[:, t]
            zr = a[: 2 * n]
            zr += g[: 2 * n]
            zr = sigmoid(zr)
            z, r, un = zr[:n], zr[n:], a[2 * n :]
            m = r * un
            m += g[2 * n :]
            np.tanh(m, out=m)
            if kept is not None:
                for k, x in enumerate((h, z, r, un, m)):
                    kept[k, t] = x
            h = h - m
            h *= z
            h += m
        if keep is not None:
            keep["steps"] = kept
        return states, h

    def outputs(self, states: np.ndarray, symbols: np.ndarray, live: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log of P(class) and, for head words, P(word | class) of each token; dead places give 0.

        With ``grads``, adds the gradient of the summed negative logs and puts
        the one with regard to the states under "states".
        """
        p = self.p
        y = symbols.ravel()
        k, used = CLASS_OF[y], int(live.sum())
        at = np.argsort(k if used == len(k) else np.where(live.ravel(), k, np.uint8(CLASSES)), kind="stable")[:used]
        # The biases are weights of one more unit that is always 1.
        s, y, k = np.empty((HIDDEN + 1, len(at)), dtype=np.float32), y[at], k[at]
        np.take(states.reshape(HIDDEN, -1), at, axis=1, out=s[:-1])
        s[-1] = 1
        outer, inner = np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["o"], p["ob"][:, None]], axis=1)
        rows = np.arange(len(y))

        def loss(w: np.ndarray, own: np.ndarray, chosen: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Logs of the chosen ones' probabilities, and what the gradient of their negative is with regard to the logits."""
            logits = w.T @ own
            # States are within 1, so logits are within the sum of the weights; only large ones need the maximum taken off.
            if np.abs(w).sum(axis=0).max() > 60:
                logits -= logits.max(axis=0)
            picked = logits[chosen, line]
            np.exp(logits, out=logits)
            total = np.ones(len(logits), dtype=np.float32) @ logits
            if grads is not None:
                logits *= np.reciprocal(total)
                logits[chosen, line] -= 1
            return picked - np.log(total), logits

        out, wrong = loss(outer, s, k, rows)
        if grads is not None:
            change = s @ wrong.T
            grads["c"] += change[:-1]
            grads["cb"] += change[-1]
            ds = p["c"] @ wrong
        cuts = np.searchsorted(k, np.arange(HEAD_CLASSES + 1)).tolist()
        for c in range(HEAD_CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a == b:
                continue
            own = s[:, a:b]
            more, wrong = loss(inner[c], own, y[a:b] - c * CLASS_SIZE, rows[: b - a])
            out[a:b] += more
            if grads is not None:
                change = own @ wrong.T
                grads["o"][c] += change[:-1]
                grads["ob"][c] += change[-1]
                ds[:, a:b] += p["o"][c] @ wrong
        full = np.zeros(symbols.size, dtype=np.float32)
        full[at] = out
        if grads is not None:
            where = np.full(symbols.size, used)
            where[at] = np.arange(used)
            ds = np.concatenate([ds, np.zeros((HIDDEN, 1), dtype=np.float32)], axis=1)
            grads["states"] = np.take(ds, where, axis=1).reshape(states.shape)
        return full.reshape(symbols.shape)

    def backward(self, symbols: np.ndarray, fresh: np.ndarray, steps: np.ndarray, grads: dict) -> None:
        """Backpropagation through one window; what lies before it is taken as given."""
        p, n = self.p, HIDDEN
        length, lanes = symbols.shape
        h, z, r, un, m = steps
        to_m, to_z, to_r = (1 - z) * (1 - m * m), (h - m) * z * (1 - z), un * r * (1 - r)
        dh = np.zeros((n, lanes), dtype=np.float32)
        dg, da = np.empty((length, 3 * n, lanes), dtype=np.float32), np.empty((length, 3 * n, lanes), dtype=np.float32)
        starts = fresh.any(axis=1)
        for t in range(length - 1, -1, -1):
            g, d = dg[t], da[t]
            dm = g[2 * n :]
            np.multiply(dh, to_z[t], out=g[:n])
            np.multiply(dh, to_m[t], out=dm)
            np.multiply(dm, to_r[t], out=g[n : 2 * n])
            d[: 2 * n] = g[: 2 * n]
            np.multiply(dm, r[t], out=d[2 * n :])
            dh *= z[t]
            dh += p["u"] @ d
            dh += grads["states"][:, t]
            if starts[t]:
                dh *= ~fresh[t]
        grads["u"] += np.matmul(h, da.transpose(0, 2, 1)).sum(axis=0)
        flat = dg.transpose(0, 2, 1).reshape(-1, 3 * n)
        grads["b"] += flat.sum(axis=0)
        order = np.argsort(symbols.ravel().astype(np.uint16), kind="stable")
        found, first = np.unique(symbols.ravel()[order], return_index=True)
        grads["x"][found] += np.add.reduceat(flat[order], first, axis=0)


class Learner:
    """Adam over texts that run through lanes: each lane takes the next text when its own ends.

    A text carries its state from window to window up to its end.  Lanes that
    find no more text are left out; a step is taken when half of a full
    window's words have given gradients, so the last, long texts don't make
    steps of their own.
    """

    def __init__(self, model: Model, lanes: int) -> None:
        self.model = Model({k: v.copy() for k, v in model.p.items()})
        self.mean, self.square, self.grads = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(3))
        self.lanes, self.least, self.step, self.words = lanes, lanes * TRAIN_WINDOW // 2, 0, 0
        self.now: list[tuple[np.ndarray, int]] = []
        self.h = np.zeros((HIDDEN, 0), dtype=np.float32)

    def feed(self, texts: list[np.ndarray], last: bool = False) -> None:
        """Learns from texts, longest first, until lanes run out of them; all to their end if these are the last."""
        texts = sorted((t for t in texts if len(t)), key=len)
        while self.now or texts:
            if len(self.now) < self.lanes and texts:
                new = [(texts.pop(), 0) for _ in range(min(self.lanes - len(self.now), len(texts)))]
                self.now += new
                self.h = np.concatenate([self.h, np.zeros((HIDDEN, len(new)), dtype=np.float32)], axis=1)
            if not texts and not last:
                return
            self._window(texts)

    def _window(self, texts: list[np.ndarray]) -> None:
        # The fewer lanes are left, the longer the windows, for a window has costs of its own.
        length = TRAIN_WINDOW * min(8, self.lanes // len(self.now))
        shape = length, len(self.now)
        y, fresh, live = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        for k, (text, at) in enumerate(self.now):
            t = 0
            while t < length:
                if at == len(text):
                    if not texts:
                        break
                    text, at = texts.pop(), 0
                fresh[t, k] = at == 0
                n = min(length - t, len(text) - at)
                y[t : t + n, k], live[t : t + n, k] = text[at : at + n], True
                t, at = t + n, at + n
            self.now[k] = text, at
        keep: dict = {}
        states, h = self.model.run(y, fresh, self.h, keep)
        self.model.outputs(states, y, live, self.grads)
        self.model.backward(y, fresh, keep["steps"], self.grads)
        self.words += int(live.sum())
        if self.words >= self.least:
            self._step()
        left = [k for k, (text, at) in enumerate(self.now) if at < len(text) or texts]
        self.now, self.h = [self.now[k] for k in left], h[:, left]

    def _step(self) -> None:
        p, grads = self.model.p, self.grads
        self.step += 1
        norm = float(np.sqrt(sum(float((grads[k] ** 2).sum()) for k in p))) / self.words
        scale = np.float32((min(1.0, CLIP / norm) if norm > 0 else 1.0) / self.words)
        rate = np.float32(RATE * np.sqrt(1 - SQUARE**self.step) / (1 - MEAN**self.step))
        for k in p:
            g = grads[k]
            g *= scale
            self.mean[k] += (1 - MEAN) * (g - self.mean[k])
            self.square[k] += (1 - SQUARE) * (g * g - self.square[k])
            p[k] -= rate * self.mean[k] / (np.sqrt(self.square[k]) + np.float32(1e-6))
            g.fill(0)
        self.words = 0

    def end(self) -> Model:
        """The model after all that was fed."""
        self.feed([], last=True)
        if self.words:
            self._step()
        return self.model


@dataclass
class Lanes:
    """Texts laid end to end in lanes: (time, lanes) of symbols, of starts of texts, and of places in use.

    ``at[i]`` is the lane and time at which text i begins.  Lanes are full from
    their start and the fullest come first, so those in use at any time are the
    first ones.
    """

    symbols: np.ndarray
    fresh: np.ndarray
    live: np.ndarray
    at: list[tuple[int, int]]

    @staticmethod
    def of(texts: list[np.ndarray], lanes: int) -> Lanes:
        """Longest text first, each into the emptiest lane."""
        import heapq

        lanes = max(1, min(lanes, len(texts)))
        heap, at = [(0, k) for k in range(lanes)], [(0, 0)] * len(texts)
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            used, k = heap[0]
            at[i] = (k, used)
            heapq.heapreplace(heap, (used + len(texts[i]), k))
        order = {k: n for n, (_, k) in enumerate(sorted(heap, key=lambda x: (-x[0], x[1])))}
        at = [(order[k], a) for k, a in at]
        shape = (max(u for u, _ in heap), lanes)
        symbols, fresh, live = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        for t, (k, a) in zip(texts, at, strict=True):
            symbols[a : a + len(t), k], live[a : a + len(t), k] = t, True
            if len(t):
                fresh[a, k] = True
        return Lanes(symbols, fresh, live, at)


def log_probabilities(model: Model, texts: list[np.ndarray], constants: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """log10 of each text's probability; constants: natural logs of the tail words' shares in their classes."""
    laid = Lanes.of(texts, lanes)
    h = np.zeros((HIDDEN, laid.symbols.shape[1]), dtype=np.float32)
    logs = np.zeros(laid.symbols.shape, dtype=np.float32)
    a = 0
    while a < len(laid.symbols):
        used = int(laid.live[a].sum())
        # The fewer lanes are left, the longer the windows, for a window has costs of its own.
        b = min(len(laid.symbols), a + WINDOW * max(1, lanes // used))
        part = slice(a, b), slice(0, used)
        states, h = model.run(laid.symbols[part], laid.fresh[part], h[:, :used])
        logs[part] = model.outputs(states, laid.symbols[part], laid.live[part])
        a = b
    return np.array([(float(logs[a : a + len(t), k].sum(dtype=np.float64)) + float(c.sum())) / LOG10 for t, c, (k, a) in zip(texts, constants, laid.at, strict=True)])


# ---------------------------------------------------------------- Spark

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: A chunk's distinct words are sent once, so larger chunks send less.
CHUNK = 12 << 20
#: Words of texts that a task learns from, or scores, at a time.
GROUP_WORDS = 4_000_000
#: Written symbols that one task reads; they take two bytes a word, of which half is left when compressed.
SPLIT_BYTES = 16 << 20

SYMBOLIC = "chunk long, row int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, tail double, symbols binary"


def _symbolic(chunks: DataFrame, merged: DataFrame, vocabulary: Vocabulary, n: int, v: int) -> DataFrame:
    """Each text's symbols and counts, its base score, and the natural log of its tail words' shares in their classes."""
    shared = chunks.sparkSession.sparkContext.broadcast((vocabulary, n, v))

    def work(table: pa.Table, reply: pa.Table) -> pa.Table:
        vocabulary, n, v = shared.value
        is_text = pa.compute.is_valid(table.column("numbers"))
        texts = table.filter(is_text)
        words = [w for x in table.filter(pa.compute.invert(is_text)).column("words") for w in _listed(x.as_py())]
        # The end comes behind the chunk's words.
        c = np.zeros(len(words) + 1)
        c[-1] = vocabulary.ends
        for at, code in zip(reply.column("places"), reply.column("counts"), strict=True):
            c[from_planes(at.as_py(), "<u4")] = from_planes(code.as_py(), "<u8")
        symbols = np.array([*map(vocabulary.symbols.__getitem__, words), END], dtype="<u2")
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        tail = symbols >= HEAD
        k = np.where(tail, symbols.astype(np.int64) - HEAD, 0)
        share = np.where(tail, np.log((c + 1) / (vocabulary.tail_tokens[k] + vocabulary.tail_kinds[k] + 1)), 0.0)
        known, out = c > 0, []
        for x in texts.column("numbers"):
            t = np.append(from_planes(x.as_py(), "<u4"), np.uint32(len(words)))
            out.append((len(t), int(known[t].sum()), float(base[t].sum()), float(share[t].sum()), symbols[t].tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([*(texts.column(c) for c in ("chunk", "row", "doc_id", "held_out")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["chunk", "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail", "symbols"])

    return chunks.groupBy("chunk").cogroup(merged.where("chunk is not null").select("chunk", "places", "counts").groupBy("chunk")).applyInArrow(work, SYMBOLIC)


def _trained(texts: DataFrame, model: Model) -> Model:
    """Rounds of local training and averaging, weighted by words; each text not held out is in one of them."""
    context = texts.sparkSession.sparkContext
    training = texts.where(~F.col("held_out")).select("symbols", F.pmod(F.xxhash64("chunk", "row", F.lit("gradients")), F.lit(ROUNDS)).alias("round"))
    for k in range(ROUNDS):
        now = context.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            learner, weight, held, size = Learner(now.value, TRAIN_LANES), 0, [], 0
            for batch in batches:
                for text in batch.column("symbols"):
                    t = np.frombuffer(text.as_py(), dtype="<u2")
                    held.append(t)
                    size += len(t)
                    if size >= GROUP_WORDS:
                        learner.feed(held)
                        weight, held, size = weight + size, [], 0
            learner.feed(held, last=True)
            weight += size
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([learner.end().pack()], pa.binary())], names=["weight", "model"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One model of all that a task reads: a running sum, however many there are."""
            total, weights = 0.0, 0
            for batch in batches:
                for w, m in zip(batch.column("weight").to_pylist(), batch.column("model"), strict=True):
                    total, weights = total + np.frombuffer(m.as_py(), dtype=np.float32).astype(np.float64) * w, weights + w
            if weights:
                yield pa.RecordBatch.from_arrays([pa.array([weights], pa.int64()), pa.array([(total / weights).astype(np.float32).tobytes()], pa.binary())], names=["weight", "model"])

        kind = "weight long, model binary"
        teams = training.where(F.col("round") == k).select("symbols").mapInArrow(learn, kind).repartition(TEAMS).mapInArrow(average, kind).collect()
        if teams:
            total = sum(r["weight"] for r in teams)
            model = model.unpack(sum(np.frombuffer(r["model"], dtype=np.float32).astype(np.float64) * (r["weight"] / total) for r in teams))
    return model


def _scored(texts: DataFrame, model: Model, n: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def scores() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            symbols = [np.frombuffer(x.as_py(), dtype="<u2") for x in table.column("symbols")]
            score = log_probabilities(shared.value, symbols, [np.array([x]) for x in table.column("tail").to_pylist()])
            return pa.RecordBatch.from_arrays([*(table.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([n] * len(table), pa.int64()), table.column("base_score"), pa.array(score, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes // 2
            if size >= GROUP_WORDS // 2:
                yield scores()
                held, size = [], 0
        if held:
            yield scores()

    return texts.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "tail", "symbols").mapInArrow(work, OUT)


def score(docs: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs`` (doc_id, text).

    Learns from rows that aren't held out.  Null, empty and blank texts are
    their end alone.  Rows are scored one by one: repeated rows and null ids
    get a row each, an empty table none; if all rows are held out, nothing is
    known and the model is what it starts as.  Of words that tie for the last
    places of the head, those whose bytes come first are in it.  Other columns are left out, so
    their names don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    chunks = scratch.stage(coded(rows, chunk_bytes))
    about = chunks.agg(F.sum(F.octet_length("words")).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    parts, ends = int(min(MAX_PARTS, max(12, (about["bytes"] or 0) // PART_BYTES))), about["ends"]
    merged = scratch.stage(merge_counts(send_counts(chunks, parts)))

    tokens, kinds = np.zeros(TAIL_CLASSES, dtype=np.int64), np.zeros(TAIL_CLASSES, dtype=np.int64)
    for r in tail_totals(merged).collect():
        tokens[r["class"]], kinds[r["class"]] = r["tokens"], r["kinds"]
    tops = [(bytes(r["word"]), r["count"]) for r in head_words(merged).collect()]
    vocabulary = Vocabulary.of(tops, tokens, kinds, ends)
    n, v = int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0)
    texts = scratch.stage(_symbolic(chunks, merged, vocabulary, n, v))
    scratch.drop(chunks)
    with scratch.splits(SPLIT_BYTES):
        return scratch.stage(_scored(texts, _trained(texts, Model.start(vocabulary)), n))
