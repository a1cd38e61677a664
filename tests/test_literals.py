"""The automaton against regular expressions and str.count."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from sparktok.operators import literals, scan


def test_equals_regular_expressions(monkeypatch):
    rng = random.Random(4)
    for strip in (7, 64, 2048):
        monkeypatch.setattr(literals, "STRIP", strip)
        for _ in range(60):
            letters = rng.choice(["ab", "abc", "aé日"])
            words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))})
            texts = ["".join(rng.choices(letters + "x", k=rng.randrange(120))) for _ in range(6)] + [None, ""]
            auto = literals.Automaton.of(words)
            data, begins = literals.joined(pa.array(texts))
            end, found = auto.ends(data)
            got = sorted((int(np.searchsorted(begins, e - 1, side="right")) - 1, int(e - begins[np.searchsorted(begins, e - 1, side="right") - 1]), words[k]) for e, k in zip(end, found, strict=True))
            want = sorted((d, m.start() + len(w.encode()), w) for d, t in enumerate(texts) for w in words for m in re.finditer(b"(?=" + re.escape(w.encode()) + b")", (t or "").encode()))
            assert got == want
            begin, found = auto.spans(data)
            got = [(int(np.searchsorted(begins, b, side="right")) - 1, int(b - begins[np.searchsorted(begins, b, side="right") - 1]), words[k]) for b, k in zip(begin, found, strict=True)]
            longest = re.compile(b"|".join(re.escape(w.encode()) for w in sorted(words, key=lambda w: -len(w.encode()))))
            assert got == [(d, m.start(), m[0].decode()) for d, t in enumerate(texts) for m in longest.finditer((t or "").encode())]


def test_time_does_not_follow_the_number_of_literals():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9))) for _ in range(50_000)})
    data, _ = literals.joined(pa.array(["".join(rng.choices("abcdefghijklmnop ", k=200_000)) for _ in range(5)]))
    took = []
    for some in (words[:100], words):
        auto = literals.Automaton.of(some)
        began = time.process_time()
        auto.ends(data)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.5


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(literals, "GROUP", 40)
    rows = [(1, "the cat, then the dog"), (2, None), (3, ""), (4, "é then"), (5, "none"), (6, "the " * 500)]
    df = spark.createDataFrame(rows, "spans long, text string")
    counts = {r["pattern"]: r["docs"] for r in literals.literal_counts(df, ["the", "then", "é", "zzz", "n"]).collect()}
    assert counts == {0: 3, 1: 2, 2: 1, 4: 3}
    parts = {r["spans"]: r["parts"] for r in literals.literal_parts(df, ["the", "then", "é", ","]).collect()}
    assert parts[1] == ["the", " cat", ",", " ", "then", " ", "the", " dog"] and parts[2] is None and parts[3] == [] and parts[4] == ["é", " ", "then"] and parts[5] == ["none"] and len(parts[6]) == 1000
    many = [f"p{k}" for k in range(50)] + ["dog", "none"]
    assert [r["pattern"] for r in scan.forbidden(df, many).where("found").collect()] == [50, 51]
    assert literals.literal_counts(df.limit(0), ["a"]).count() == 0
    for bad in ([""], ["a", "a"]):
        with pytest.raises(ValueError, match="not empty"):
            literals.Automaton.of(bad)
    monkeypatch.setattr(literals, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="more than"):
        literals.Automaton.of(["abc"])
