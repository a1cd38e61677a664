"""Training of byte-pair vocabularies.

Spark counts the words of the corpus.  Where the distinct ones fit, they come
to the driver, which keeps the places of each pair in numpy arrays and a heap
of pair counts, so each merge touches only what it changes.  Where they don't,
they stay in written tables, a round of Spark jobs touches the words of its
merges only, and the most frequent pairs come.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemes import DEFAULT
from ..plans.loaders import byte_alphabet
from ..plans.model import AddedToken, TokenizerModel
from ..shared import folder, remove
from ..shipping import ship
from .counts import pretoken_counts
from .merging import merge
from .scan import split_docs

TIES = ("huggingface", "raw_token_ids", "assembled_bytes")
DEFAULT_SEPARATOR = "<|endoftext|>"
#: Distinct words that the driver takes, and their bytes (each takes some 100 there); with more of them, training stays distributed.
MOST_WORDS, MOST_BYTES = 5_000_000, 4 << 20


@dataclass(frozen=True)
class Trained:
    """Tokens by id and merges in order: 256 bytes, special tokens, then one token for each merge."""

    vocab: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    specials: tuple[str, ...]

    def model(self, scheme: str = DEFAULT) -> TokenizerModel:
        added = tuple(AddedToken(s, 256 + k, special=True) for k, s in enumerate(self.specials))
        return TokenizerModel("byte", self.vocab, self.merges, added, scheme)

    def merge_bytes(self) -> list[tuple[bytes, bytes]]:
        return [(self.vocab[a], self.vocab[b]) for a, b, _ in self.merges]


def _tie_key(mode: str, vocab: list[bytes]):
    """Order of pairs with equal counts; smaller wins."""
    if mode == "huggingface":
        order = {b: k for k, b in enumerate(byte_alphabet()[c] for c in sorted(byte_alphabet()))}
        return lambda p: tuple(order.get(x, x) for x in p)
    if mode == "raw_token_ids":
        return lambda p: p
    if mode == "assembled_bytes":
        return lambda p: (vocab[p[0]].decode("latin-1"), vocab[p[1]].decode("latin-1"))
    raise ValueError(f"unknown tie-breaking: {mode!r} (one of {TIES})")


class Corpus:
    """Distinct words as one array of symbols, linked to their neighbours, with the places of each pair.

    A merge looks at the pair's own places only; places that no longer hold it
    are passed over.  ``counts`` are those of pairs side by side, overlaps
    included, each word counted as often as it occurs.
    """

    def __init__(self, words: list[bytes], times: list[int]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
        n = len(self.symbols)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.times, self.word = np.array(times, dtype=np.int64), word
        last = np.ones(n, dtype=bool)
        last[:-1] = word[1:] != word[:-1]
        place = np.arange(n, dtype=np.int32)
        self.after = np.where(last, -1, place + 1).astype(np.int32)
        self.before = np.where(np.concatenate([[True], last[:-1]])[:n], -1, place - 1).astype(np.int32)
        at = np.nonzero(~last)[0].astype(np.int32)
        self.places: dict[tuple[int, int], list[np.ndarray]] = {}
        self.counts: dict[tuple[int, int], int] = {}
        for pair, count, where in self._grouped(at):
            self.counts[pair], self.places[pair] = count, [where]

    def _grouped(self, at: np.ndarray) -> Iterator[tuple[tuple[int, int], int, np.ndarray]]:
        """Pairs that begin at some places: each with its count and places."""
        key = self.symbols[at].astype(np.int64) << 32 | self.symbols[self.after[at]]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(at) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(self.times[self.word[at]], first) if len(at) else []
        for k, n, where in zip(key[first].tolist(), np.asarray(sums).tolist(), np.split(at, first[1:]), strict=False):
            yield (k >> 32, k & 0xFFFFFFFF), n, where

    def merge(self, pair: tuple[int, int], new: int) -> set[tuple[int, int]]:
        """Put ``new`` for a pair wherever it stands, left to right; the pairs whose counts may have changed."""
        a, b = pair
        at = np.unique(np.concatenate(self.places.pop(pair)))
        at = at[(self.symbols[at] == a) & (self.after[at] >= 0)]
        at = at[self.symbols[self.after[at]] == b]
        if a == b and len(at):
            # In a run of equal symbols every other pair is merged.
            begins = np.concatenate([[True], self.after[at[:-1]] != at[1:]])
            run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = self.after[at]
        left, right = self.before[at], self.after[gone]
        near = np.unique(np.concatenate([left[left >= 0], at, gone]))
        touched: set[tuple[int, int]] = set()
        for p, n, _ in self._grouped(near[self.after[near] >= 0]):
            self.counts[p] -= n
            touched.add(p)
        self.symbols[at], self.symbols[gone], self.after[at] = new, -1, right
        self.before[right[right >= 0]] = at[right >= 0]
        near = near[self.symbols[near] >= 0]
        for p, n, where in self._grouped(near[self.after[near] >= 0]):
            self.counts[p] = self.counts.get(p, 0) + n
            touched.add(p)
            if new in p:
                self.places.setdefault(p, []).append(where)
        for p in touched:
            if not self.counts[p]:
                del self.counts[p]
        return touched


def train(words: list[tuple[bytes, int]], vocab_size: int, specials: tuple[str, ...] = (), tie_breaking: str = "huggingface") -> Trained:
    """Merge the most frequent pair until there are ``vocab_size`` tokens or no pair occurs.

    Ties go by ``tie_breaking``.  Pairs are counted where they stand side by
    side, overlaps included; a pair that no longer occurs is never merged.
    """
    vocab = [bytes([b]) for b in range(256)] + [s.encode() for s in specials]
    key = _tie_key(tie_breaking, vocab)
    corpus = Corpus([w for w, _ in words], [n for _, n in words])
    heap = [(-n, key(p), p) for p, n in corpus.counts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while len(vocab) < vocab_size and heap:
        n, _, pair = heapq.heappop(heap)
        if -n != corpus.counts.get(pair, 0) or n >= 0:
            continue
        new = len(vocab)
        vocab.append(vocab[pair[0]] + vocab[pair[1]])
        merges.append((*pair, new))
        for p in corpus.merge(pair, new):
            if p in corpus.counts:
                heapq.heappush(heap, (-corpus.counts[p], key(p), p))
    return Trained(tuple(vocab), tuple(merges), tuple(specials))


#: Rows of a round's log: a pair that it made in a word, or (without word) what a pair lost.
LOG = "left int, right int, word binary, cnt long, delta long"
#: Merges of one round at most.
MOST_MERGES = 64


def _log(words: DataFrame, ranks: dict, fresh: dict | None) -> DataFrame:
    """Log rows of a table of words (word, cnt): how ``fresh`` merges change pairs after those of ``ranks``; None: all pairs of bytes."""
    ship(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast((ranks, fresh))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, fresh = shared.value
        for batch in batches:
            lost: Counter = Counter()
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("cnt").to_pylist(), strict=True):
                was = [] if fresh is None else merge(list(word), ranks)
                now = list(word) if fresh is None else merge(was, fresh)
                before, after = Counter(zip(was, was[1:])), Counter(zip(now, now[1:]))
                rows += [(*pair, word, n, k * n) for pair, k in after.items() if pair not in before]
                for pair, k in before.items():
                    lost[pair] += (after[pair] - k) * n
            rows += [(*pair, None, None, n) for pair, n in lost.items() if n]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["left", "right", "word", "cnt", "delta"])

    return words.mapInArrow(work, LOG)


class Rounds:
    """Training state in written tables: an index from pairs to words, and what each round did to the counts.

    A pair first stands in a word in the round that made the later of its two
    symbols and in no other one, so the words that may hold it are found in
    that round's log alone (in the first one, by its left byte's folder).
    Symbols of a word are worked out from its bytes and the merges, so words
    themselves are never rewritten.

    Old pairs only become rarer.  So the driver holds the first ``most_pairs``
    pairs with exact counts and a bound that all others rank behind; a round
    brings changes of held pairs and new pairs before the bound, and only when
    none is left before it are all counts added up again.
    """

    def __init__(self, words: DataFrame, vocab: list[bytes], tie_breaking: str, most_pairs: int):
        self.spark, self.vocab, self.tie, self.most = words.sparkSession, vocab, tie_breaking, most_pairs
        self.key = _tie_key(tie_breaking, vocab)
        self.places = ", ".join(str(self.key((b, b))[0]) for b in range(256)) if tie_breaking == "huggingface" else ""
        self.root = folder(self.spark, "-training")
        self.made: dict[int, str] = {}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self.held: dict[tuple[int, int], int] = {}
        self.bound: tuple | None = None
        base = _log(words.where("word IS NOT NULL AND cnt > 0").groupBy("word").agg(F.sum("cnt").alias("cnt")), {}, None)
        base.hint("rebalance", "left").sortWithinPartitions("left", "right").write.partitionBy("left").parquet(f"{self.root}/base")
        self.pending, self.total, self.totals = [f"{self.root}/base"], None, 0
        self.refill()

    def rank(self, pair: tuple[int, int], n: int) -> tuple:
        return -n, self.key(pair), pair

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*paths)

    def _ordered(self, counts: DataFrame, *first: Column) -> DataFrame:
        """Pairs (left, right, delta) in the order of ranks."""
        if self.tie == "assembled_bytes":
            # As many rows as the vocabulary has tokens.
            tokens = F.broadcast(self.spark.createDataFrame(list(enumerate(self.vocab)), "id int, bytes binary"))
            for side in ("left", "right"):
                counts = counts.join(tokens.select(F.col("id").alias(side), F.col("bytes").alias(f"_{side}")), side)
            keys = ["_left", "_right"]
        elif self.tie == "huggingface":
            keys = [F.expr(f"coalesce(get(array({self.places}), {side}), {side})") for side in ("left", "right")]
        else:
            keys = []
        return counts.orderBy(*first, F.desc("delta"), *keys, "left", "right")

    def refill(self) -> None:
        """Add up all logs since the last time and hold the first pairs."""
        logs = self._read(*self.pending).select("left", "right", "delta")
        if self.total is not None:
            logs = logs.union(self.spark.read.schema("left int, right int, delta long").parquet(self.total))
        self.total, self.pending, self.totals = f"{self.root}/total-{self.totals}", [], self.totals + 1
        logs.groupBy("left", "right").agg(F.sum("delta").alias("delta")).where("delta > 0").write.parquet(self.total)
        counts = self.spark.read.schema("left int, right int, delta long").parquet(self.total)
        found = self._ordered(counts).limit(self.most).collect()
        self.held = {(r["left"], r["right"]): r["delta"] for r in found}
        self.bound = self.rank(*list(self.held.items())[-1]) if len(found) == self.most else None

    def best(self) -> list[tuple]:
        """Held pairs before the bound, in order; none if no pair is left at all."""
        self._forget()
        if not self.held and self.bound is not None:
            self.refill()
        return sorted(self.rank(p, n) for p, n in self.held.items())

    def _forget(self) -> None:
        self.held = {p: n for p, n in self.held.items() if n > 0 and (self.bound is None or self.rank(p, n) <= self.bound)}
        if len(self.held) > 2 * self.most:
            self.bound = sorted(self.rank(p, n) for p, n in self.held.items())[self.most - 1]
            self._forget()

    def _words(self, pairs: list[tuple[int, int]]) -> DataFrame:
        """(word, cnt) of all words that some pairs may stand in."""
        homes: dict[str, list[tuple[int, int]]] = {}
        for a, b in pairs:
            homes.setdefault(self.made.get(max(a, b), f"{self.root}/base/left={a}"), []).append((a, b))
        parts = []
        for path, own in homes.items():
            of_base = path.startswith(f"{self.root}/base/")
            table = self.spark.read.schema(LOG.split(", ", 1)[1]).parquet(path) if of_base else self._read(path)
            asked = [F.col("right") == b if of_base else (F.col("left") == a) & (F.col("right") == b) for a, b in own]
            parts.append(table.where(F.col("word").isNotNull() & reduce(or_, asked)).select("word", "cnt"))
        found = reduce(DataFrame.union, parts)
        return found if len(pairs) == 1 else found.groupBy("word").agg(F.first("cnt").alias("cnt"))

    def apply(self, merges: list[tuple[int, int, int]]) -> None:
        """One round: merges that share no symbol, with their new ids, in order; ``vocab`` has their tokens already."""
        fresh = {(a, b): (len(self.ranks) + k, new) for k, (a, b, new) in enumerate(merges)}
        path = f"{self.root}/round-{len(self.ranks)}"
        _log(self._words([(a, b) for a, b, _ in merges]), self.ranks, fresh).write.parquet(path)
        self.ranks |= fresh
        self.made |= {new: path for _, _, new in merges}
        self.pending.append(path)
        touched = {s for a, b, _ in merges for s in (a, b)}
        near = [p for p in self.held if touched.intersection(p)]
        known = F.broadcast(self.spark.createDataFrame([(*p, True) for p in near], "left int, right int, held boolean"))
        least = 1 if self.bound is None else -self.bound[0]
        net = self._read(path).groupBy("left", "right").agg(F.sum("delta").alias("delta")).join(known, ["left", "right"], "left")
        net = net.where(F.col("held") | (F.col("delta") >= least))
        found = self._ordered(net, F.desc_nulls_last("held")).select("left", "right", "delta", "held").limit(len(near) + self.most).collect()
        new = [r for r in found if not r["held"]]
        for r in found:
            pair = r["left"], r["right"]
            self.held[pair] = self.held.get(pair, 0) + r["delta"]
        if len(new) == self.most:
            last = self.rank((new[-1]["left"], new[-1]["right"]), new[-1]["delta"])
            self.bound = last if self.bound is None else min(self.bound, last)


def train_distributed(words: DataFrame, vocab_size: int, specials: tuple[str, ...] = (), tie_breaking: str = "huggingface", most_pairs: int = 10_000) -> Trained:
    """The same merges from a table of words (word binary, cnt long) that stays distributed.

    Rows of the same word are added up; words that are null or occur less than
    once are left out.  A round merges the most frequent pairs as long as they
    share no symbol with one before them: such merges change no other's count,
    and a pair that one of them makes is at most as frequent as one that
    shares a symbol with it and so comes later (a pair of equal symbols shares
    them with itself, so it is the last of its round).  A round reads and
    writes what belongs to the words that its pairs may stand in; see
    ``Rounds``.  The driver gets at most two times ``most_pairs`` pairs a round.
    """
    vocab = [bytes([b]) for b in range(256)] + [s.encode() for s in specials]
    merges: list[tuple[int, int, int]] = []
    rounds = Rounds(words, vocab, tie_breaking, most_pairs)
    try:
        while len(vocab) < vocab_size and (ranked := rounds.best()):
            taken, seen = [], set()
            least = 0 if rounds.bound is None else -rounds.bound[0]
            for n, _, pair in ranked:
                if seen.intersection(pair) or len(taken) == MOST_MERGES or (taken and len(set(taken[-1][1])) == 1):
                    least = max(least, -n)
                    break
                taken.append((-n, pair))
                seen.update(pair)
            # What a merge makes, or what isn't held, may come before those that are as frequent as ``least``.
            sure = [pair for n, pair in taken if n > least] or [ranked[0][2]]
            made = []
            for a, b in sure[: vocab_size - len(vocab)]:
                made.append((a, b, len(vocab)))
                vocab.append(vocab[a] + vocab[b])
            merges += made
            if len(vocab) < vocab_size:
                rounds.apply(made)
    finally:
        remove(rounds.spark, rounds.root)
    return Trained(tuple(vocab), tuple(merges), tuple(specials))


def train_bpe(df: DataFrame, vocab_size: int, specials: tuple[str, ...] = (), tie_breaking: str = "huggingface", separator: str | None = None, text: str = "text", scheme: str = DEFAULT, least_count: int = 1, most_words: int = MOST_WORDS, most_bytes: int = MOST_BYTES) -> Trained:
    """Train on a table of texts.

    ``separator`` parts each text into documents first.  The count is
    distributed.  Up to ``most_words`` distinct words of ``most_bytes`` in all
    are merged on the driver, more of them by rounds of Spark jobs, with the same result.  Words rarer
    than ``least_count`` are left out.
    """
    _tie_key(tie_breaking, [])
    docs = df.select(F.explode(split_docs(F.col(text), separator)).alias("text")) if separator else df.select(F.col(text).alias("text"))
    counted = pretoken_counts(docs, "text", scheme).where(F.col("cnt") >= least_count)
    words = counted.select(F.col("pretoken").cast("binary").alias("word"), "cnt").persist()
    try:
        number, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
        if number > most_words or size > most_bytes:
            return train_distributed(words, vocab_size, specials, tie_breaking)
        found = words.toArrow()
    finally:
        words.unpersist()
    return train(list(zip(found.column("word").to_pylist(), found.column("cnt").to_pylist(), strict=True)), vocab_size, specials, tie_breaking)
