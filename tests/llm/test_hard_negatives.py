"""Hard negatives: against all inner products."""

import collections
import math
import random

import numpy as np
import pytest

from sparktok.llm import hard_negatives
from sparktok.llm.scratch import Scratch


def brute(rows):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = collections.Counter()
    for a, (anchor, label, v) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), i, l2) for b, (i, l2, w) in enumerate(kept) if b != a))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out.update((anchor, positive, k, i, -p, -s) for k, (s, i, _) in enumerate(fit, 1))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, tree string, v int, rid string, data string"


def mined(spark, rows):
    table = spark.createDataFrame([(*r, "t", 1, "r", "d") for r in rows], SCHEMA)
    with Scratch(spark) as scratch:
        return collections.Counter(tuple(r) for r in scratch.keep(hard_negatives.mine(table, scratch)).collect())


def vectors(rng, n, dim, spread=0.3, labels=10):
    centres = [[rng.gauss(0, 0.5) for _ in range(dim)] for _ in range(labels)]
    out = []
    for k in range(n):
        label = rng.randrange(labels) if k % 3 else 0
        out.append((k, [c + rng.gauss(0, spread) for c in centres[label]], label))
    return out


def test_equals_all_inner_products(spark):
    rng = random.Random(6)
    rows = vectors(rng, 900, 8)
    rows += [(2000 + k, [0.5] * 8, k % 10) for k in range(250)]  # copies of one vector: ties by id
    rows += [(None, [1.0] * 8, 1), (3000, None, 1), (3100, [1.0] * 8, None), (3200, [1.0] * 7 + [float("nan")], 1), (3300, [None] * 8, 1), (3400, [float("inf")] * 8, 2)]
    rows += [(100, [0.25] * 8, 3), (100, [0.25] * 8, 3), (3500, [], 1), (3600, [0.5] * 3, 1), (3700, [0.1] * 12, 1), (4000, [9.0] * 8, 77)]
    assert mined(spark, rows) == brute(rows)


def test_blocks_and_many_trees(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k * 20, v, label) for k, v, label in vectors(rng, 600, 5, labels=4)]
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)
    assert mined(spark, rows) == brute(rows)


def test_edges(spark):
    assert not mined(spark, []) and not mined(spark, [(0, [1.0, 2.0], 1)]) and not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    rows = [(0, [1.0], 1), (5, [1.0], 1), (6, [-1.0], 1), (8, [0.5], 2), (9, [0.31], 2)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="don't fit into a long"):
        mined(spark, [(k, [1e30], 1) for k in range(3)])


def test_largest_components_of_a_type(spark):
    """256 * 0.5 is 128, which one byte holds with a minus only; large scores stay exact, and products fit though their bound doesn't."""
    rng = random.Random(8)
    for most in (0.5, 128.0, 2.0**21):
        rows = [(k * 10, [rng.choice([most, -most, most / 2, 0.25]) for _ in range(3)], rng.randrange(3)) for k in range(200)]
        assert mined(spark, rows) == brute(rows)
    far = [(k * 10, [rng.choice([5.5e5, 1.1e6, 5.0e5]), 0.0], k % 3) for k in range(60)] + [(7000 + k, [0.0, 1e15 + k], 1) for k in range(1, 4)]
    assert mined(spark, far) == brute(far)
    scores = [0, 7, -7, 99, -101, 1 << 58, -(1 << 58), (1 << 63) - 2]
    low, high = hard_negatives.windows(np.array(scores))
    assert low.tolist() == [-(-30 * p // 100) for p in scores] and high.tolist() == [90 * p // 100 for p in scores]


def test_tree_prunes_and_is_exact():
    """Clustered rows: far boxes are never opened, and large numbers stay exact in longs."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (16, 12))
    v = (centres[np.arange(4096) % 16] + rng.integers(-20, 20, (4096, 12))).astype(np.int64)
    ids, labels = np.arange(4096), np.arange(4096) % 16
    for factor in (1, 30_000):
        tree = hard_negatives.Tree.load(hard_negatives.Tree.packed(ids, ids, labels, v * factor).dump())
        assert all((tree.vectors[k * 64 : (k + 1) * 64] >= tree.low[0][k]).all() and (tree.vectors[k * 64 : (k + 1) * 64] <= tree.high[0][k]).all() for k in range(64))
        n, some = 20, ids[::16][:20]
        search = hard_negatives.Search(v[some] * factor, labels[some], some, np.arange(n), np.full(n, hard_negatives.NOTHING), np.full(n, -hard_negatives.NOTHING), True, 5)
        search.over(tree)
        for a in range(n):
            score = (v @ v[some[a]]) * factor**2
            want = sorted((-int(score[i]), int(i)) for i in ids if i != some[a] and labels[i] == 0)[:5]
            assert [(-int(s), int(i)) for s, i in zip(search.scores[a], search.found[a], strict=True)] == want
        assert search.leaves <= 8
    one = hard_negatives.Search(v[:1], labels[:1], ids[:1], np.array([0]), np.full(1, hard_negatives.NOTHING), np.full(1, -hard_negatives.NOTHING), True, 5)
    one.over(hard_negatives.Tree.packed(ids, ids, labels, v))
    assert one.leaves <= 8
