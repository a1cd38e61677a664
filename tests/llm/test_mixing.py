"""Mixing of sources: targets and tilts against plain Python, sums against targets."""

import collections
import math
import random
import re

import pytest

from sparktok.llm import mixing
from sparktok.llm.scratch import Scratch

from .conftest import CLASHING, clash, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Targets by source: dealt by weight, stopped at twice the size, the excess dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        each = left / sum(weight[s] for s in free)
        full = {s for s in free if each * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: each * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    return out


def plain_tilt(words, target):
    """By bisection: the tilt at which rates of min(2, exp(tilt * size)) take the target."""
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(w * min(2.0, math.exp(min(mid * w, 1))) for w in words) < target else (low, mid)
    return low


def mixed(spark, rows):
    docs = spark.createDataFrame([(*clash(i, t)[:3], s, *clash(i, t)[4:]) for i, t, s in rows], CLASHING)
    with Scratch(spark) as scratch:
        return scratch.keep(mixing.mix(docs, scratch)).collect()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for k in range(900):
        source = None if k % 11 == 0 else f"s{int(rng.random() ** 2 * 9)}" if k % 3 else "hot"
        made.append((k, "w " * int(rng.lognormvariate(3.5, 1.0)), source))
    made += [(2000 + k, "same words in each copy", "hot") for k in range(400)] + [(3, "again and again", "hot")] * 7 + [(None, None, "é"), (None, "x", "é"), (5, "", "é"), (6, " \n", ""), (7, "y " * 5000, "S")]
    return made


def test_mix_reaches_targets(spark, rows):
    got = mixed(spark, rows)
    sizes, sources = collections.Counter(), collections.defaultdict(list)
    for _, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        sources[s].append(n)
    want = plain_targets(sizes)
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, goal in want.items():
        least = min([n for n in sources[s] if n], default=0)
        assert abs(taken[s] - goal) <= max(1, least), (s, taken[s], goal)


def test_rates_are_tilted(spark, rows):
    got = mixed(spark, rows)
    by = collections.defaultdict(list)
    for r in got:
        if r["size"]:
            by[r["source"]].append(r)
    for found in by.values():
        target, words = found[0]["target"], [r["size"] for r in found]
        if target >= 2 * sum(words):
            assert all(r["rate"] == 2 for r in found)
            continue
        tilt = plain_tilt(words, target)
        for r in found:
            assert r["rate"] == pytest.approx(min(2.0, math.exp(min(tilt * r["size"], 1))), rel=1e-4, abs=1e-6)


def test_mix_reruns_agree_and_edges(spark, rows):
    def digest(found):
        return sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"], r["target"]) for r in found)

    rng = random.Random(1)
    other = rows[:]
    rng.shuffle(other)
    assert digest(mixed(spark, rows)) == digest(mixed(spark, other))
    assert mixed(spark, []) == []
    assert [(r["size"], r["target"], r["taken"]) for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [(0, 0.0, 0)] * 2
    with Scratch(spark) as scratch:
        plan = mixing.mix(table(spark, [(1, "a b")]), scratch)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
