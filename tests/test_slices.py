"""Workers work on bounded parts of a batch, and give the same as on the whole."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from sparktok.operators import charsmap, counts, encode, fragments, literals, slices
from sparktok.operators import train as training
from sparktok.queries import piece_model, small_model

TEXTS = ["the cat and the dog, then " * (k % 70 + 1) for k in range(3000)] + [None, "", "the " * 400_000]


class Frame:
    """In place of a DataFrame: gives the worker's function, which a broadcast only wraps."""

    def __init__(self, **kinds):
        self.schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
        self.columns, self.sparkSession, self.sparkContext = list(kinds), self, self
        self.value = None

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, work, kinds):
        return work


@pytest.fixture(autouse=True)
def unshipped(monkeypatch):
    for module in (encode, charsmap, counts, fragments, literals):
        monkeypatch.setattr(module, "ship", lambda spark: None)


def batch():
    return pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS, pa.string())], names=["doc_id", "text"])


def test_slices_are_whole_and_bounded():
    rng = random.Random(1)
    lists = pa.array([[1] * rng.randrange(50) if k % 9 else None for k in range(2000)], pa.list_(pa.int32()))
    both = pa.RecordBatch.from_arrays([lists, pa.array(["x" * rng.randrange(90) for _ in range(2000)])], names=["a", "b"])
    for column, most in ((0, 500), (1, 100)):
        parts = list(slices.slices(both, column, most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([both])) and len(parts) > 100
        assert all(p.num_rows == 1 or int(slices.lengths(p.column(column)).sum()) * (8 if column == 0 else 1) <= most for p in parts)


def test_columns_are_made_of_bounded_parts():
    seen = []
    work = encode._with(Frame(doc_id=T.LongType(), text=T.StringType()), "text", "n", "long", lambda: lambda v: seen.append(len(v)) or slices.pa.array(slices.lengths(v)))
    out = pa.Table.from_batches(work([batch()]))
    assert out.column("n").to_pylist() == [len(t or "") for t in TEXTS] and len(seen) > 3 and seen[-1] == 1


def test_parts_of_long_texts_come_together(monkeypatch):
    texts = [t for t in TEXTS if t is not None]
    out = list(fragments.fragments(Frame(doc_id=T.LongType(), text=T.StringType()), small_model(), "doc_id", target=400)([batch()]))
    assert len(out) < 10 and [len(b) for b in out]
    rows = pa.Table.from_batches(out).to_pylist()
    whole = {}
    for r in rows:
        assert r["fragment"] == len(whole.setdefault(r["doc_id"], []))
        whole[r["doc_id"]].append(r["text"])
    assert ["".join(p) for p in whole.values()] == texts
    assert len(list(fragments.sections(Frame(doc_id=T.LongType(), text=T.StringType()), piece_model(), "doc_id", target=400)([batch()]))) < 10


def test_maps_walk_bounded_parts(monkeypatch):
    seen, blob = [], charsmap.build({"T": "t", "c": "cc"})
    monkeypatch.setattr(charsmap.Charsmap, "hits", lambda self, data, own=charsmap.Charsmap.hits: seen.append(len(data)) or own(self, data))
    out = pa.Table.from_batches(charsmap.precompiled(Frame(doc_id=T.LongType(), text=T.StringType()), blob)([batch()]))
    assert out.column("text").to_pylist() == [t and t.replace("c", "cc") for t in TEXTS]
    assert max(seen[:-1]) <= charsmap.WALKED


def test_literals_cut_texts_in_one_pass():
    rng = random.Random(3)
    words = ["the", "then", "a", "é", "<m>", "ab"]
    texts = ["".join(rng.choice(["the", "then", "a", "b", "é", " ", "<m", ">"]) for _ in range(rng.randrange(40))) for _ in range(500)] + [None, ""]
    pattern = re.compile("(" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + ")")
    found = literals.parted(pa.array(["off", *texts])[1:], literals.Automaton.of(words))
    assert found.to_pylist() == [None if t is None else [p for p in pattern.split(t) if p] for t in texts]


def test_a_piece_models_words_begin_with_marks():
    own = encode._cached(piece_model())
    rng = random.Random(5)
    for _ in range(300):
        section = "".join(rng.choice("▁▁the and") for _ in range(rng.randrange(12)))
        assert own.merged(section) == b"".join(encode.code(own.word(w)) if hasattr(encode, "code") else np.array(own.word(w), "<i4").tobytes() for w in re.findall("▁?[^▁]+|▁", section))


def test_a_vocabulary_is_looked_up_without_a_shuffle(spark, monkeypatch):
    model = small_model()
    rows = [(0, [97, 98, 256 + 5]), (1, []), (2, None), (3, [104])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    vocab = model.vocab_table(spark)
    found = encode.decode_join(df, vocab, "doc_id")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(k, b"".join(model.vocab[i] for i in ids or []).decode()) for k, ids in rows]
    assert sorted(tuple(r) for r in found.select("doc_id", "text").collect()) == want
    for bad in ([-1], [97, None], [5000], [1 << 30]):
        with pytest.raises(Exception, match="outside"):
            encode.decode_join(spark.createDataFrame([(0, bad)], "doc_id long, ids array<int>"), vocab, "doc_id").collect()
    monkeypatch.setattr(encode, "MOST_IDS", 10)
    assert sorted(tuple(r) for r in encode.decode_join(df, vocab, "doc_id").select("doc_id", "text").collect()) == want


def test_many_bytes_of_words_stay_distributed(spark, monkeypatch):
    df = spark.createDataFrame([("the cat and the hat sat on the mat " * 3,)], "text string")
    want, called = training.train_bpe(df, 262), []
    monkeypatch.setattr(training, "train_distributed", lambda *a, own=training.train_distributed: called.append(1) or own(*a))
    assert training.train_bpe(df, 262, most_bytes=20) == want and called
