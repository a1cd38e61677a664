"""Joins and repeated passages: against brute force."""

import collections
import random

import numpy as np
import pytest

from sparktok.llm import components, ngram_join, sketch, substr_dedup, words
from sparktok.llm.scratch import Scratch

from .conftest import sentence, table


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for universe in (1, 2, 50, 10_000, 1 << 40):
        for n in (0, 1, 5, 200):
            values = np.unique(rng.integers(0, universe, n))
            assert sketch.ef_decode(sketch.ef_encode(values, universe)).tolist() == values.tolist()


def test_word_hashes_do_not_depend_on_where_a_word_stands():
    import pyarrow as pa

    long = "x" * 300_000
    w = words.words_of(pa.array(["Ab cd", None, "", f"{long} cd ab", "cd\tAb\x1cq é"]))
    h = w.hashes()
    assert w.counts().tolist() == [2, 0, 0, 3, 3] and h[1] == h[3] == h[5] and h[0] != h[4]
    assert w.hashes(lower=True)[0] == w.hashes(lower=True)[4]


def test_components(spark):
    """Chains, random links, a node with very many, links repeated, in both directions, to itself and to nothing."""
    rng = random.Random(1)
    links = [(500, 500 + k) for k in range(90)] + [(550, 499), (499, 550), (499, 550), (7, 7), (600, 400), (600, 401)] + [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    with Scratch(spark) as scratch:
        got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([*links, (None, 5), (5, None)], "src long, dst long"), scratch).collect()}
        assert components.components(spark.createDataFrame([], "src long, dst long"), scratch).count() == 0
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in parent if top(x) != x}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return collections.Counter((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_copies(rng, k, n, edits):
    base = sentence(rng, n, 3000).split()
    out = []
    for _ in range(k):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w[rng.randint(0, 2) :]))
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, edge_rows, n, percent):
    rng = random.Random(n)
    passage = sentence(rng, 50, 10**5)
    texts = near_copies(rng, 60, 120, 6) + near_copies(rng, 40, 60, 3) + near_copies(rng, 30, 300, 14) + [f"{sentence(rng, 200, 10**5)} {passage} {sentence(rng, 20, 10**5)}" for _ in range(40)]
    rng.shuffle(texts)
    rows = edge_rows + [(100 + k, t) for k, t in enumerate(texts)]
    with Scratch(spark) as scratch:
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, rows).repartition(5), scratch, n, percent, chunk_bytes=20_000).collect())
        kept = ngram_join.keep_first(table(spark, rows), scratch, n, percent, chunk_bytes=20_000).collect()
    want = brute_components(rows, n, percent)
    assert got == want
    named = {c for (d, s, c) in want if s and c is not None}
    assert named <= {r["doc_id"] for r in kept} | {None} and kept[0]["rid"] == "r"


def test_large_group_of_near_copies_is_joined_over_many_tasks(spark):
    rng = random.Random(11)
    rows = list(enumerate(near_copies(rng, 400, 70, 3)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        with Scratch(spark) as scratch:
            got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, rows).repartition(7), scratch, chunk_bytes=10_000).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_components(rows, 4, 85)


def shared_passages(rng, k, passages=60, of_each=4, head=120):
    """Texts of one head and some of a few passages: every token is in very many of them, and some pairs are near copies."""
    first, parts = sentence(rng, head, 10**6), [sentence(rng, 40, 10**6) for _ in range(passages)]
    return [" ".join([first, *rng.sample(parts, of_each)]) for _ in range(k)]


def test_blocks_of_frequent_tokens_equal_brute_force(spark, monkeypatch):
    """Owners of a token in blocks of about 16, so that tiles are of two blocks, and all pairs still meet."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(31)
    rows = list(enumerate(shared_passages(rng, 250, 8, 5, 60)))
    with Scratch(spark) as scratch:
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(table(spark, rows).repartition(4), scratch, chunk_bytes=30_000).collect())
    want = brute_components(rows, 4, 85)
    assert got == want and 10 < len({c for _, _, c in want}) < 240


def test_prefixes_have_the_rarest_tokens(spark):
    """The prefix of a set whose first tokens by hash are frequent is of its rare ones, and long enough for the rule."""
    rule = ngram_join.Rule(85)
    rng = np.random.default_rng(0)
    every = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    rows = [(k, 100, np.concatenate([every[:60], np.sort(rng.choice(every[60:], 40, replace=False))]).tobytes()) for k in range(50)]
    near = spark.createDataFrame([(r, n, bytearray(s)) for r, n, s in rows], "rid long, n int, shared binary")
    got = collections.defaultdict(list)
    for r in ngram_join._prefixes(near, rule, 1 << 20).collect():
        got[r["rid"]].append((np.int64(r["token"]).astype(np.uint64), r["is_index"]))
    assert all(len(got[k]) == rule.probe(100) and sum(i for _, i in got[k]) == rule.index(100) for k in range(50))
    assert all(t not in every[:60] for k in got for t, _ in got[k])


def test_empty_tables(spark):
    with Scratch(spark) as scratch:
        assert ngram_join.join(table(spark, []), scratch).count() == 0
        assert substr_dedup.drop_repeats(table(spark, []), scratch).count() == 0


@pytest.mark.parametrize("window", [20, 4])
def test_passages_equal_brute_force(spark, window):
    rng = random.Random(window)
    passage = [sentence(rng, 30, 10**5) for _ in range(4)]
    rows = [(None, f"a b {passage[0]}"), (7, None), (8, ""), (9, " \t"), (3, passage[0]), (2, f"{passage[0]} {passage[0]}"), (5, "x " * 100)]
    rows += [(20 + k, " ".join(rng.choice([passage[rng.randrange(4)], sentence(rng, rng.randint(1, 40), 50)]) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    rng.shuffle(rows)
    with Scratch(spark) as scratch:
        got = collections.Counter(tuple(r) for r in substr_dedup.drop_repeats(table(spark, rows).repartition(4), scratch, window, chunk_bytes=3000).collect())
    seen, want = set(), collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert got == want


def test_repeated_ids_and_rows_lose_all_but_one_copy(spark):
    text = sentence(random.Random(4), 50)
    with Scratch(spark) as scratch:
        got = sorted(r["n_removed"] for r in substr_dedup.drop_repeats(table(spark, [(1, text)] * 5), scratch).collect())
    assert got == [0, 50, 50, 50, 50]
