"""Language of texts: averaged embeddings of hashed subwords and a linear softmax.

Subwords are runs of three and four bytes of a lower-cased text in which
whatever parts words is one boundary byte; runs with a boundary inside are
left out.  Training is stochastic gradient descent in numpy over a bounded
sample of labelled documents.

Rejection is calibrated on a part of the sample kept aside.  The softmax only
tells known languages apart, so beside it stands how familiar a text is: the
mean log share of its subwords in the sample, as a deviation from that of
texts kept aside, in units of what a text of its length varies by.  A logistic
curve over that tells texts and snippets of known languages from the same ones
written with other letters; the score is the product of both probabilities.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import words
from .decontam import SEPARATORS, slices

BUCKETS, DIMENSIONS = 1 << 15, 16
#: Bounds of the sample: languages (the most frequent ones), and documents of a language and of all (in expectation);
#: of each the driver gets a count for each bucket.
MOST_LANGUAGES, PER_LANGUAGE, IN_ALL = 256, 700, 40_000
EPOCHS, RATE = 12, 1.0
#: Kept aside for calibration: one in so many.  The threshold lies between the scores that these shares have: of whole
#: texts answered rightly those that score less, of texts in strange letters those that score more.
ASIDE, REJECTED, PASSED = 5, 0.002, 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: First letters of other scripts in which a text can be written anew for calibration (fixed values: Greek, Cyrillic,
#: Armenian, Hebrew, Devanagari, Thai, Georgian, kana, Han, Hangul).
SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x915, 0xE01, 0x10D0, 0x3042, 0x4E00, 0xAC00)


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of texts, and where each text's begin (one more at the end)."""
    joined = pa.array([f" {t.lower()} " for t in texts], pa.string())
    data, offsets = words.texts_buffer(joined)
    gap = SEPARATORS | (np.arange(256) >= 48) & (np.arange(256) < 58)
    b = np.where(gap[data], 32, data).astype(np.uint32)
    space = b == 32
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    found, owner = [], []
    for n in (3, 4):
        if len(b) < n:
            continue
        size = len(b) - n + 1
        h = np.zeros(size, dtype=np.uint32)
        ok = doc[:size] == doc[n - 1 :]
        for k in range(n):
            h = h * np.uint32(257) + b[k : k + size]
            if 0 < k < n - 1:
                ok &= ~space[k : k + size]
        at = np.nonzero(ok & ~(space[:size] & space[n - 1 :]))[0]
        h = h[at] * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        found.append((h * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32))
        owner.append(doc[at])
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


@dataclass
class Model:
    """``table``: each bucket's share of the logits (embedding times output weights), and its log share of the sample.

    ``usual``: mean familiarity of known texts, its variance between texts,
    and the variance of one subword's; ``curve``: slope and height.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    usual: tuple[float, float, float]
    curve: tuple[float, float]
    threshold: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores; a text without a subword has score 0."""
        buckets, first = subwords(texts)
        n = np.diff(first)
        out = np.zeros((len(texts), self.table.shape[1]))
        full = np.nonzero(n)[0]
        if len(full):
            out[full] = np.add.reduceat(self.table[buckets], first[full], axis=0, dtype=np.float64) / n[full, None]
        return self.judge(out, n)

    def judge(self, means: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the means of the table's rows over each text's ``n`` subwords."""
        p = softmax((means[:, :-1] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        known = 1 / (1 + np.exp(-np.clip(self.curve[0] * deviation(means[:, -1], n, self.usual) + self.curve[1], -30, 30)))
        return best, np.where(n > 0, known * p[np.arange(len(n)), best], 0.0)


def deviation(familiar: np.ndarray, n: np.ndarray, usual: tuple[float, float, float]) -> np.ndarray:
    return (familiar - usual[0]) / np.sqrt(usual[1] + usual[2] / np.maximum(n, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    return np.unique(subwords([text])[0], return_counts=True)


def snippet(text: str, rng: random.Random) -> str:
    """Some words of a text that stand together."""
    every = text.split()
    n = rng.randint(4, 40)
    at = rng.randrange(max(1, len(every) - n + 1))
    return " ".join(every[at : at + n])


def strange(text: str, rng: random.Random) -> str:
    """The text with its letters exchanged: among themselves, or for those of another script."""
    letters = sorted(set(LETTER.findall(text.lower())))
    if rng.random() < 0.3:
        others = rng.sample(letters, len(letters))
    else:
        script = rng.choice(SCRIPTS)
        others = [chr(script + k) for k in rng.sample(range(max(24, len(letters))), len(letters))]
    return text.lower().translate(dict(zip(map(ord, letters), others, strict=True)))


#: What a row of the sample is: a text to learn from or to calibrate with, part of such a text, and the latter two in strange letters.
LEARN, CHECK, PART, STRANGE = range(4)


def variants(text: str) -> Iterator[tuple[int, str]]:
    """A sampled text as rows of the sample; which it is goes by its own bytes."""
    number = int(words.mix(np.array([len(text)], dtype=np.uint64) + words.words_of(pa.array([text])).hashes().sum())[0])
    if number % ASIDE:
        yield LEARN, text
        return
    rng = random.Random(number)
    part = snippet(text, rng)
    yield from ((CHECK, text), (PART, part), (STRANGE, strange(text, rng)), (STRANGE, strange(part, rng)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and height of a logistic curve by Newton's method, lightly held back; both classes weigh the same."""
    w, weight = np.zeros(2), np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    rows = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (p - y)) + 1e-4 * w
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(w[0]), float(w[1])


def train(samples: list[tuple[str, int, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """A model from (language, what it is, buckets, counts); None if there is no sample to learn from.

    Languages weigh the same however many samples they have.
    """
    samples = [s for s in samples if len(s[2])]
    if not samples:
        return None
    if not any(s[1] == LEARN for s in samples):
        samples = [(language, LEARN if kind == CHECK else kind, *x) for language, kind, *x in samples]
    use = [s for s in samples if s[1] == LEARN]
    if not use:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({s[0] for s in use})
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[s[0]] for s in use])
    e = (rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    w, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    weight = np.minimum(5.0, len(use) / len(languages) / np.maximum(np.bincount(y, minlength=len(languages)), 1))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(use)):
            _, _, buckets, counts = use[i]
            share = counts / counts.sum()
            h = share @ e[buckets]
            p = softmax((h @ w + bias)[None])[0]
            p[y[i]] -= 1
            p *= rate * weight[y[i]]
            back = w @ p
            w -= np.outer(h, p)
            bias -= 0.1 * p
            e[buckets] -= np.outer(share * len(share) ** 0.5, back)
    # Every language is as familiar as the others; every bucket has been met at least half a time.
    met = np.zeros(BUCKETS)
    for (_, _, buckets, counts), k in zip(use, y, strict=True):
        met[buckets] += counts * weight[k]
    log_share = np.log((met + 0.5) / (met.sum() + 0.5 * BUCKETS))
    table = np.concatenate([e @ w, log_share[:, None]], axis=1).astype(np.float32)
    return calibrated(Model(languages, table, bias, 1.0, (0.0, 1.0, 1.0), (0.0, 30.0), 0.0), [s for s in samples if s[1] != LEARN and s[0] in number], use)


def calibrated(model: Model, aside: list[tuple[str, int, np.ndarray, np.ndarray]], use: list[tuple[str, int, np.ndarray, np.ndarray]]) -> Model:
    """The model with temperature, familiarity and threshold from samples kept aside; without a whole text there, from those it learned from."""
    samples = aside if any(s[1] == CHECK for s in aside) else use + aside
    kind, n = np.array([s[1] for s in samples]), np.array([int(s[3].sum()) for s in samples])
    means = np.array([(s[3] / s[3].sum()) @ model.table[s[2]] for s in samples], dtype=np.float64)
    truth, line = np.array([model.languages.index(s[0]) for s in samples]), np.arange(len(samples))
    whole, known = kind < PART, kind != STRANGE
    logits = means[:, :-1] + model.bias

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits[known] / t)[np.arange(known.sum()), truth[known]] + 1e-12).mean())

    model.temperature = min(np.geomspace(0.002, 20, 120).tolist(), key=loss)
    familiar = means[:, -1]
    spread = np.array([(s[3] / s[3].sum()) @ (model.table[s[2], -1] - f) ** 2 for s, f in zip(samples, familiar, strict=True)])
    model.usual = (float(familiar[whole].mean()), float(familiar[whole].var()) + 1e-3, float(spread[whole].mean()) + 1e-3)
    if not known.all():
        model.curve = logistic(deviation(familiar, n, model.usual), known)
    best, score = model.judge(means, n)
    right = score[whole & (best == truth)]
    least = float(np.quantile(right, REJECTED)) if len(right) else 0.5
    most = float(np.quantile(score[~known], 1 - PASSED)) if not known.all() else least
    model.threshold = min(0.5, least, max(most, (least * most) ** 0.5))
    return model


def fit(docs: DataFrame) -> Model | None:
    """A model from rows with text and ``lang`` that aren't held out; None if there is none.

    The sample takes whole texts by hash: of each of the MOST_LANGUAGES most
    frequent languages about PER_LANGUAGE rows, fewer if that makes more than
    IN_ALL of all; the driver gets their subword counts.  Repeated rows are in
    it together or not at all; an empty or unlabelled table gives None.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out().alias("held_out"))
    rows = rows.where("not held_out and text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES)
    sizes = sizes.withColumn("each", F.expr(f"least({PER_LANGUAGE}, {IN_ALL} / count(*) over ())"))
    chosen = rows.join(F.broadcast(sizes), "lang").where(F.expr("pmod(xxhash64(id, text), 1000003) < 1000003.0D * each / rows"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(language, kind, *features(text)) for language, whole in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for kind, text in variants(whole)]
            cols = list(zip(*((language, kind, x.astype("<u2").tobytes(), k.astype("<u4").tobytes()) for language, kind, x, k in out), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["lang", "kind", "buckets", "counts"])

    found = chosen.select("lang", "text").mapInArrow(work, "lang string, kind int, buckets binary, counts binary").collect()
    samples = [(r["lang"], r["kind"], np.frombuffer(r["buckets"], dtype="<u2"), np.frombuffer(r["counts"], dtype="<u4")) for r in found]
    return train(sorted(samples, key=lambda s: (s[1], s[2].tobytes(), s[0], s[3].tobytes())))


OUT = "lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; only ``text`` is read.

    A text that is null or has no letter (Unicode category L) is ``und`` with
    score 0 and rejected; so is every text if there is no model.  A text whose
    score is below the model's threshold keeps its prediction and is rejected.  Rows are read one by one, whole;
    an empty table gives no rows.  Columns of those three names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            language, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
            for a, b in slices([texts[i] for i in known]):
                for i, k, p in zip(known[a:b], *model.predict([texts[i] for i in known[a:b]]), strict=True):
                    language[i], score[i], rejected[i] = model.languages[k], float(p), bool(p < model.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(work, f"{fields}, {OUT}")


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` whose language is not rejected, all columns as they are.

    Null texts and those without a letter go.  Without a model (no labelled
    row) no language is known, so every row goes.  Each row is judged by its
    own text: repeated rows stay or go together; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            good = np.zeros(len(texts), dtype=bool)
            known = np.array([i for i, t in enumerate(texts) if model and t and LETTER.search(t)], dtype=np.int64)
            for a, b in slices([texts[i] for i in known]):
                good[known[a:b]] = model.predict([texts[i] for i in known[a:b]])[1] >= model.threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
