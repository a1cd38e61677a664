"""The prefix trie: parentheses against a stack, nodes against a trie of dictionaries."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from sparktok.llm import prefix_trie
from sparktok.llm.scratch import Scratch


def test_findclose_and_leaf_pairs():
    rng = random.Random(2)
    for n in (1, 2, 3, 40, 700):
        for shape in (0.5, 0.9, 0.1):
            bits, depth, opened = [], 0, 0
            while opened < n or depth:
                go = opened < n and (depth == 0 or rng.random() < shape)
                bits.append(go)
                depth, opened = depth + (1 if go else -1), opened + go
            stack, want = [], {}
            for k, b in enumerate(bits):
                if b:
                    stack.append(k)
                else:
                    want[stack.pop()] = k
            for block in (2, 64):
                p = prefix_trie.Parens(np.array(bits), block)
                got = p.findclose(p.opens())
                assert dict(zip(p.opens().tolist(), got.tolist(), strict=True)) == want
                pairs = [sum(bits[k] and not bits[k + 1] for k in range(a, want[a])) for a in p.opens().tolist()]
                assert p.leaf_pairs(p.opens(), got).tolist() == pairs


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - c % 100, [])
        turns = tuple(x[2:] for x in base[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string, depth string, a1 int, n string, path int, conv string"


def built(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)
    with Scratch(spark) as scratch:
        got = scratch.keep(prefix_trie.nodes(table, scratch, **more)).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for c in range(420):
        if c in (200, 301, 302):
            continue  # no first conversation; gaps
        n = rng.choice((1, 1, 2, 3, 5, 8))
        words = ["a", "b", "é" * 3, "", None, "long " * 50]
        out += [(c, rng.choice((None, 0, 1)) if t == 0 else t + 1, rng.choice(("user", None, "bot")), rng.choice(words) if rng.random() < 0.7 else f"own {c} {t}") for t in range(n)]
    out += [(c, t, "user", f"copy {t}") for c in range(1000, 1090) for t in range(4)]  # a large group of copies
    out += [(2000, t, "user", f"deep {t}") for t in range(90)] + [(2001, t, "user", f"deep {t}") for t in range(80)]
    out += [(None, 1, "user", "nobody's"), (5000, None, None, None), (5001, 3, "a", "same"), (5001, 3, "a", "same"), (5001, 4, "a", "same")]
    rng.shuffle(out)
    return out


def distinct_turns(rows):
    """Without ties of turns, whose order is the operator's own."""
    seen, out = set(), []
    for r in rows:
        if r[:2] not in seen or r[3] == "same":
            out.append(r)
        seen.add(r[:2])
    return out


def test_nodes_equal_a_trie(spark, rows):
    rows = distinct_turns(rows)
    want = brute(rows)
    assert built(spark, rows) == want


def test_spines_merge_over_small_shards(spark, rows):
    """Shards of a few elements, and rounds of them."""
    some = [r for r in distinct_turns(rows) if r[0] is not None and r[0] < 1100]
    assert built(spark, some, shard_nodes=7) == brute(some)


def test_conversations_cut_anywhere(spark):
    """Tasks that begin inside a conversation, at each place of its first turns and heads."""
    rng = random.Random(1)
    rows = [(c, t, "u", f"{rng.randrange(3)}") for c in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 101, 107, 200) for t in range(rng.choice((1, 3, 6, 9, 40)))]
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (3, 40, 61):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert built(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])


def test_empty_and_turnless(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "a", "b")]) == []
    turnless = [c for c in range(700, 800) if zlib.crc32(str(c).encode()) % 6 == 5][:3]
    assert 700 not in turnless
    for rows in ([(c, 0, "u", "t") for c in turnless], [(turnless[0], 0, "u", "t")], [(turnless[0], 0, "u", "t"), (1, 0, "u", "t"), (800, 1, "x", None)]):
        assert built(spark, rows) == brute(rows)
