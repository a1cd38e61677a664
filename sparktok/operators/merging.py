"""Merging of symbols by rank: what the Arrow functions run for new words, one by one or many at once."""

from __future__ import annotations

import heapq

import numpy as np


#: Stands for the rank of a pair that is no merge.
NONE = (1 << 62, -1)


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equal ones, until none is left.

    ``ranks``: pair to (rank, merged id).  Short words keep the ranks of their
    pairs in a list, of which a merge changes two; long ones keep them in a
    heap over a linked list.
    """
    if len(symbols) > 64:
        return _merge_long(symbols, ranks)
    out, get = list(symbols), ranks.get
    found = [get(pair, NONE) for pair in zip(out, out[1:])]
    while found:
        best = min(found)
        if best is NONE:
            break
        k = found.index(best)
        out[k : k + 2] = [best[1]]
        del found[k]
        if k:
            found[k - 1] = get((out[k - 1], out[k]), NONE)
        if k < len(found):
            found[k] = get((out[k], out[k + 1]), NONE)
    return out


def _merge_long(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    n = len(symbols)
    value: list[int | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] < n:
            found = ranks.get((value[k], value[after[k]]))
            if found is not None:
                heapq.heappush(heap, (found[0], k, value[k], value[after[k]], found[1]))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, k, left, right, merged = heapq.heappop(heap)
        if value[k] != left or after[k] >= n or value[after[k]] != right:
            continue
        gone = after[k]
        value[k], value[gone], after[k] = merged, None, after[gone]
        if after[k] < n:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [v for v in value if v is not None]


class Table:
    """Merges as sorted arrays, for many words at once."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        pairs = np.array([a << 32 | b for a, b in ranks], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.rank = np.array([r for r, _ in ranks.values()], dtype=np.int64)[order]
        self.merged = np.array([m for _, m in ranks.values()], dtype=np.int64)[order]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; those that are no merge have the rank of NONE."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == key
        return np.where(hit, self.rank[at], NONE[0]), np.where(hit, self.merged[at], -1)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that lie end to end after all their merges, and their sizes; each step takes one merge of each word."""
        symbols, word = symbols.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
        if not len(self.pairs) or not len(symbols):
            return symbols, sizes
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, merged = np.full(len(symbols), NONE[0]), np.full(len(symbols), -1)
        inner = np.nonzero(word[1:] == word[:-1])[0]
        rank[inner], merged[inner] = self.look(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(symbols)))
            over = np.repeat(best == NONE[0], counts)
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, merged = symbols[~over], word[~over], rank[~over], merged[~over]
                counts, best = counts[best != NONE[0]], best[best != NONE[0]]
                if not len(symbols):
                    break
            at = np.nonzero(rank == np.repeat(best, counts))[0]
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbols[at] = merged[at]
            stay = np.ones(len(symbols), dtype=bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            symbols, word, rank, merged = symbols[stay], word[stay], rank[stay], merged[stay]
            for begin in (at - 1, at):
                begin = begin[(begin >= 0) & (begin + 1 < len(symbols))]
                same = word[begin] == word[begin + 1]
                rank[begin], merged[begin] = NONE[0], -1
                begin = begin[same]
                rank[begin], merged[begin] = self.look(symbols[begin], symbols[begin + 1])
            last = at[at + 1 == len(symbols)]
            rank[last], merged[last] = NONE[0], -1
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))
