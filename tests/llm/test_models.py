"""Language model, language identification, decontamination, shards, the pipeline."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparktok.llm import decontam, langid, lm, packing, queries, sharding
from sparktok.llm.scratch import Scratch

from .conftest import sentence, table

SF = "/root/testdata/sf0.01"


def vocabulary(words):
    count = collections.Counter(words)
    tokens, kinds = np.zeros(lm.TAIL_CLASSES, dtype=np.int64), np.zeros(lm.TAIL_CLASSES, dtype=np.int64)
    for w, k in count.items():
        tokens[lm.tail_class(w)] += k
        kinds[lm.tail_class(w)] += 1
    return count, lm.Vocabulary.of(count.most_common(), tokens, kinds, 3)


def test_gradients():
    _, v = vocabulary([f"w{k}".encode() for k in range(50) for _ in range(k)])
    m, rng = lm.Model.start(v), np.random.default_rng(0)
    y, fresh, live = rng.integers(0, lm.SYMBOLS, (6, 3)).astype(np.int32), np.zeros((6, 3), bool), np.ones((6, 3), bool)
    fresh[0], fresh[3, 1], live[5, 2] = True, True, False
    h = np.zeros((lm.HIDDEN, 3), np.float32)

    def loss(p):
        other = lm.Model(p)
        return -float(other.outputs(other.run(y, fresh, h)[0], y, live).sum(dtype=np.float64))

    keep, grads = {}, {k: np.zeros_like(p) for k, p in m.p.items()}
    m.outputs(m.run(y, fresh, h, keep)[0], y, live, grads)
    m.backward(y, fresh, keep["steps"], grads)
    for k in m.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        up, down = ({n: p.copy() for n, p in m.p.items()} for _ in range(2))
        up[k][at] += 0.01
        down[k][at] -= 0.01
        assert abs((loss(up) - loss(down)) / 0.02 - grads[k][at]) < 0.02 * abs(grads[k][at]) + 1e-3


def test_next_word_probabilities_sum_to_one():
    count, v = vocabulary([f"w{k}".encode() for k in range(2000) for _ in range(1 + k % 7)])
    m = lm.Model.start(v)
    before = np.array([3, 700, lm.HEAD + 5], dtype=np.int32)
    total = 0.0
    for s in [k for k in range(lm.HEAD) if v.counts[k] > 0] + list(range(lm.HEAD, lm.SYMBOLS)):
        texts = [np.append(before, np.int32(s))]
        total += 10 ** (lm.log_probabilities(m, texts, [np.zeros(1)])[0] - lm.log_probabilities(m, [before], [np.zeros(1)])[0])
    assert abs(total - 1) < 1e-3
    for c in range(lm.TAIL_CLASSES):
        known = [k for w, k in count.items() if v.symbol(w) == lm.HEAD + c]
        assert abs(sum(k + 1 for k in known) + 1 - (v.tail_tokens[c] + v.tail_kinds[c] + 1)) < 1e-9


def test_windows_and_lanes_do_not_change_a_score():
    _, v = vocabulary([f"w{k}".encode() for k in range(99)])
    m, rng = lm.Model.start(v), np.random.default_rng(1)
    texts = [rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (1, 300, 5, 64, 65, 2)]
    zeros = [np.zeros(1)] * 6
    alone = [lm.log_probabilities(m, [t], [z])[0] for t, z in zip(texts, zeros)]
    for lanes in (1, 2, 256):
        assert np.allclose(lm.log_probabilities(m, texts, zeros, lanes), alone, rtol=1e-5)


def plain_log10(m, symbols, constants):
    """Token after token in float64, by the equations: class, then word in it; then one step of the cell."""
    p, n = {k: v.astype(np.float64) for k, v in m.p.items()}, lm.HIDDEN

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    h, total = np.zeros(n), float(np.sum(constants))
    for y in symbols:
        c = y // lm.CLASS_SIZE if y < lm.HEAD else lm.HEAD_CLASSES + y - lm.HEAD
        total += log_softmax(h @ p["c"] + p["cb"])[c]
        if y < lm.HEAD:
            total += log_softmax(h @ p["o"][c] + p["ob"][c])[y % lm.CLASS_SIZE]
        a, g = h @ p["u"], p["x"][y] + p["b"]
        z, r = (1 / (1 + np.exp(-(a + g)[k * n : (k + 1) * n])) for k in (0, 1))
        h = (1 - z) * np.tanh(r * a[2 * n :] + g[2 * n :]) + z * h
    return total / np.log(10)


def test_scores_equal_a_plain_loop():
    """At the start, after training, and with weights so large that the maximum is taken off."""
    _, v = vocabulary([f"w{k}".encode() for k in range(1500) for _ in range(1 + k % 5)])
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, lm.SYMBOLS, n).astype(np.int32) for n in (1, 2, 31, 64, 65, 400)]
    learner = lm.Learner(lm.Model.start(v), 4)
    learner.feed([rng.integers(0, 60, 900).astype(np.uint16) for _ in range(12)])
    trained = learner.end()
    large = lm.Model({k: x * 40 for k, x in trained.p.items()})
    constants = [rng.standard_normal(len(t)) for t in texts]
    for m in (lm.Model.start(v), trained, large):
        assert np.allclose(lm.log_probabilities(m, texts, constants), [plain_log10(m, t, c) for t, c in zip(texts, constants)], rtol=1e-4)


def check_scores(rows, got):
    count, ends = collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    want = collections.Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want[i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), n, round(base, 4)] += 1
    assert want == collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_scores_on_edges(spark, edge_rows):
    with Scratch(spark) as scratch:
        check_scores(edge_rows, lm.score(table(spark, edge_rows), scratch, chunk_bytes=5000).collect())
        assert lm.score(table(spark, []), scratch).count() == 0
        held = [(k, "a b") for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2]
        check_scores(held, lm.score(table(spark, held), scratch).collect())


def test_every_training_document_reaches_backpropagation(spark):
    """A round that a document is in moves the embeddings of its own word; no other document has it."""
    rows = [(k, f"own{k} " * 3 + "shared words") for k in range(300)]
    docs = table(spark, rows)
    with Scratch(spark) as scratch:
        chunks = scratch.stage(lm.coded(docs.select("doc_id", "text").withColumn("held_out", lm.held_out()), 2000))
        merged = scratch.stage(lm.merge_counts(lm.send_counts(chunks, 3)))
        words = [w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.encode().split()]
        _, v = vocabulary(words)
        start = lm.Model.start(v)
        got = lm._trained(scratch.stage(lm._symbolic(chunks, merged, v, len(words), len(set(words)))), start)
    moved = np.abs(got.p["x"] - start.p["x"]).max(axis=1) > 0
    own = [v.head[w] for w in set(words) if w.startswith(b"own")]
    assert len(own) > 200 and moved[own].all()


def test_training_carries_the_state_through_whole_texts(monkeypatch):
    _, v = vocabulary([f"w{k}".encode() for k in range(99)])
    m, rng = lm.Model.start(v), np.random.default_rng(2)
    texts = [rng.integers(0, lm.SYMBOLS, n).astype(np.uint16) for n in (1500, 3, 700, 33, 64, 1, 32)]
    seen, run = [], lm.Model.run
    monkeypatch.setattr(lm, "RATE", 0.0)
    monkeypatch.setattr(lm.Model, "run", lambda self, y, fresh, h, keep=None: seen.append((fresh, *run(self, y, fresh, h, keep))) or seen[-1][1:])
    learner = lm.Learner(m, 1)
    learner.feed(texts[:3])
    learner.feed(texts[3:])
    learner.end()
    assert sum(int(fresh.sum()) for fresh, _, _ in seen) == len(texts)
    states = np.concatenate([s[:, :, 0] for _, s, _ in seen], axis=1)
    want, _ = run(m, texts[0].astype(np.int32)[:, None], np.arange(1500)[:, None] == 0, np.zeros((lm.HIDDEN, 1), np.float32))
    assert np.allclose(states[:, :1500], want[:, :, 0], atol=1e-5)


def test_model_beats_the_base_on_held_out_documents(spark):
    out = queries.op2_lm_scoring(spark, SF).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert out["s"] > out["b"]


def test_language_id(spark, edge_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98 and got.where("rejected").count() < 3
    rows = table(spark, edge_rows)
    out = langid.predict(rows, langid.fit(rows)).collect()
    assert len(out) == len(edge_rows) and out[0]["rid"] == "r"
    for r in out:
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(c.isalpha() for c in r["text"])) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.predict(rows, None).collect()} == {"und"} and langid.keep(rows, None).count() == 0
    assert langid.fit(table(spark, [])) is None and langid.train([]) is None


def test_text_in_no_known_language_is_rejected(spark):
    """Other scripts, letters drawn at random, letters exchanged: nearly all rejected, while held-out documents and parts of them are kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(12)
    own = [r["text"] for r in docs.where(langid.held_out()).select("text").collect() if langid.LETTER.search(r["text"])]
    strange = ["Привет, как дела у тебя сегодня, мой друг?", "안녕하세요 오늘 날씨가 정말 좋습니다", "日本語のテキストです。今日は良い天気です。", "Καλημέρα σας, πώς είστε σήμερα;", "qwrt zxcv plkm bvnm qqqq zzxx ghjk wvbx"]
    strange += [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(30)) for _ in range(50)]
    strange += [langid.strange(t, rng) for t in own[:150]]
    parts = [langid.snippet(t, rng) for t in own]
    (_, s), (_, kept), (_, cut) = (model.predict(x) for x in (strange, own, parts))
    assert (s[:5] < model.threshold).all() and (s < model.threshold).mean() > 0.98
    assert (kept < model.threshold).mean() < 0.005 and (cut < model.threshold).mean() < 0.02
    out = langid.predict(table(spark, [(1, strange[0]), (2, own[0]), (3, "²½ ①"), (4, "12 + 3")]), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"] == "und", r["rejected"]) for r in out] == [(False, True), (False, False), (True, True), (True, True)]
    assert [r["doc_id"] for r in langid.keep(table(spark, [(1, strange[0]), (2, own[0]), (3, "²½ ①"), (4, None)]), model).collect()] == [2]


def test_languages_with_long_documents_only_are_learned(spark):
    words = {"aa": "nol wek tir bam ".split(), "bb": "ushi oro ete ".split()}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(40_000 if x == "bb" else 60)), x) for k in range(12) for x in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"] and [model.languages[k] for k in model.predict(["wek bam tir nol", "ete oro ushi ete"])[0]] == ["aa", "bb"]
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None and langid.keep(docs, None).count() == 0


def test_predictions_do_not_read_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = langid.fit(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert plain == {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None)), model).collect()}


def test_best_run():
    same = np.array([0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1], dtype=bool)
    assert decontam.best_run(same, 80) == (6, 1, 8) and decontam.best_run(np.zeros(5, bool), 80)[0] == 0
    rng = random.Random(0)
    for _ in range(300):
        s = np.array([rng.random() < 0.7 for _ in range(rng.randint(1, 30))])
        widest = max((b - a for a in range(len(s)) for b in range(a, len(s) + 1) if b > a and s[a:b].sum() * 100 >= 80 * (b - a)), default=0)
        agree, a, b = decontam.best_run(s, 80)
        assert agree == s[a:b].sum() and b - a <= max(widest, 0) and (widest == 0 or agree > 0)


def decontaminated(spark, rows, benchmark, take=lambda df: df.collect()):
    with Scratch(spark) as scratch:
        return take(decontam.find(table(spark, rows), benchmark, scratch)), take(decontam.clean(table(spark, rows), benchmark, scratch))


def test_decontamination(spark, edge_rows):
    rng = random.Random(8)
    items = [(k, sentence(rng, 40, 10**5)) for k in range(30)] + [(90, None), (None, "x"), (91, "a b c"), (92, "one two three four five six seven"), (93, ""), (94, "...")]
    rows, planted = list(edge_rows), {}
    for k in range(60):
        i, t = items[rng.randrange(30)]
        w = t.split()
        for _ in range(4):
            w[rng.randrange(40)] = "changed"
        planted[200 + k] = i
        rows.append((200 + k, f"{sentence(rng, 50)} {' '.join(w).upper()}, {sentence(rng, 50)}"))
    rows += [(300, f"{sentence(rng, 30)} {' '.join(items[0][1].split()[:9])} {sentence(rng, 30)}"), (301, "so: one two three four five six seven!"), (302, "x A, b: C y"), (303, "x a b y c")]
    planted |= {301: 92, 302: 91}
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    found, kept = decontaminated(spark, rows, benchmark)
    assert {r["doc_id"]: r["item_id"] for r in found if r["contaminated"]} == planted
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) and (by_id[302]["agree"], by_id[302]["length"], by_id[302]["first_word"]) == (3, 3, 1)
    assert all(r["first_word"] == 50 or r["first_word"] > 50 for r in found if 200 <= (r["doc_id"] or 0) < 260)
    # The item without id counts in clean, whose rows with the word x go, too.
    with_x = sum("x" in decontam_words(t) for i, t in rows if i not in planted)
    assert with_x > 1 and len(kept) == len(rows) - len(planted) - with_x and kept[0].__fields__ == table(spark, []).columns
    found, kept = decontaminated(spark, rows, benchmark.limit(0))
    assert not any(r["contaminated"] for r in found) and len(kept) == len(rows)
    assert decontaminated(spark, [], benchmark) == ([], [])


def decontam_words(text):
    return "".join(c if not c.isascii() or c.isalnum() else " " for c in (text or "").lower()).split()


def plain_overlap(doc, item):
    """Whether any alignment of two lists of words holds an overlap that the rule accepts, by trying all stretches."""
    n = len(item)
    for d in range(1 - n, len(doc)):
        same = [doc[d + k] == item[k] for k in range(n) if 0 <= d + k < len(doc)]
        if n < 6:
            if len(same) == n and all(same):
                return True
            continue
        need = min(13, n)
        ends = [k for k, x in enumerate(same) if x]
        if any(b - a + 1 >= need and sum(same[a : b + 1]) * 100 >= 80 * (b - a + 1) for a in ends for b in ends):
            return True
    return False


def test_decontamination_finds_what_all_alignments_hold(spark):
    """Items of each length from 1 to 40, each in texts with words replaced, cut off at the text's ends, or left alone."""
    rng = random.Random(21)
    items = [(n * 10 + k, [f"i{n}x{k}x{j}" for j in range(n)]) for n in range(1, 41) for k in range(2)]
    rows, truth = [], {}
    for item_id, item in items:
        for k in range(12):
            w = list(item)
            for j in rng.sample(range(len(w)), min(len(w), rng.choice((0, 1, 1, 2, 3, len(w) // 5, len(w) // 4)))):
                w[j] = "other"
            w = w[rng.choice((0, 0, 0, len(w) // 3)) :]
            doc = [f"d{rng.randrange(500)}" for _ in range(rng.choice((0, 3, 20)))] + w + [f"d{rng.randrange(500)}" for _ in range(rng.choice((0, 9)))]
            i = len(rows)
            rows.append((i, " ".join(doc)))
            truth[i] = item_id if plain_overlap(doc, item) else None
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    found, kept = decontaminated(spark, rows, benchmark)
    got = {r["doc_id"]: r["item_id"] for r in found}
    assert got == truth and sum(v is not None for v in truth.values()) > 300 and sum(v is None for v in truth.values()) > 100
    assert {r["doc_id"] for r in kept} == {i for i, v in truth.items() if v is None}


def test_hot_items_and_seeds(spark):
    """One passage in every text and one phrase in every item: each text finds its item, and all that share the passage."""
    phrase = "which of these is the right answer to what is asked"
    items = [(k, f"{phrase} {' '.join(f"q{k}x{j}" for j in range(20))}") for k in range(40)] + [(99, " ".join(f"z{j}" for j in range(15)))]
    rows = [(k, f"text {k} {items[40][1]} then {items[k % 40][1] if k % 3 else phrase} end") for k in range(600)]
    found, kept = decontaminated(spark, rows, spark.createDataFrame(items, "item_id long, text string"))
    assert all((r["n_items"], r["item_id"]) == ((2, r["doc_id"] % 40) if r["doc_id"] % 3 else (1, 99)) for r in found) and len(found) == 600 and not kept


def test_masks_hit_all_that_the_rule_accepts():
    """Every item of up to 12 words, and passage of 13 to 20, of whose inner words up to a fifth are replaced."""
    for n in range(1, 21):
        masks = [[j for j, bit in enumerate(m) if bit == "1"] for m, least, most in decontam.MASKS if least <= n <= (most or n)]
        for k in range(n - -(-n * 80 // 100) + 1 if n >= 6 else 1):
            for gone in itertools.combinations(range(1, n - 1), k):
                assert any(not any(a + j in gone for j in m) for m in masks for a in range(n - m[-1])), (n, gone)


def test_items_without_id_are_cleaned_away(spark):
    words = " ".join(f"q{k}" for k in range(20))
    benchmark = spark.createDataFrame([(None, words)], "item_id long, text string")
    found, kept = decontaminated(spark, [(1, f"a {words} b"), (2, "a b")], benchmark)
    assert [r["doc_id"] for r in kept] == [2] and not any(r["contaminated"] for r in found)


def test_shards(spark, edge_rows):
    with Scratch(spark) as scratch:
        rows = sharding.shard(table(spark, edge_rows), scratch, f"{scratch.root}-m1").collect()
        again = {r["doc_id"]: r["shard"] for r in sharding.shard(table(spark, edge_rows[::3]), scratch, f"{scratch.root}-m2").collect()}
        assert sharding.shard(table(spark, []), scratch, f"{scratch.root}-m3").count() == 0 and sharding.SlotMap.versions(spark, f"{scratch.root}-m3") == [1]
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    places, of, bytes_of = collections.defaultdict(list), {}, collections.Counter()
    for r in rows:
        places[r["shard"]].append(r["slot"])
        bytes_of[r["virtual_slot"]] += r["size"]
        assert r["grown_shard"] in (r["shard"], 24) and of.setdefault(r["doc_id"], r["shard"]) == r["shard"] and again.get(r["doc_id"], r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and all(bytes_of[r["virtual_slot"]] == r["slot_bytes"] for r in rows)


def test_the_next_version_evens_out_bytes(spark):
    """Rows of the second call are placed by the map that the first one stored; only slots that moved change their shard."""
    rng = random.Random(5)
    docs = table(spark, [(k, "x" * rng.choice((5, 50, 4000))) for k in range(3000)])
    with Scratch(spark) as scratch:
        folder = f"{scratch.root}-map"
        first, second = (sharding.shard(docs, scratch, folder, 6).collect() for _ in range(2))
        assert sharding.SlotMap.versions(spark, folder) == [1, 2]
        maps = [sharding.SlotMap.load(spark, folder, v) for v in (1, 2)]
        with pytest.raises(ValueError):
            sharding.shard(docs, scratch, folder, 7)
        with pytest.raises(Exception, match="(?i)exist"):
            maps[1].save(spark, folder)

    def loads(rows, column):
        out = collections.Counter()
        for r in rows:
            out[r[column]] += r["size"]
        return max(out.values()) - min(out.values()), sum(out.values()) / 6

    assert maps[0] == sharding.SlotMap.initial(6)
    before, after = {r["doc_id"]: r for r in first}, {r["doc_id"]: r for r in second}
    assert all(before[k]["balanced_shard"] == after[k]["shard"] == after[k]["balanced_shard"] for k in before)
    assert all((before[k]["shard"] != after[k]["shard"]) == (maps[0].owner[before[k]["virtual_slot"]] != maps[1].owner[before[k]["virtual_slot"]]) for k in before)
    assert loads(first, "shard")[0] > 0.05 * loads(first, "shard")[1] and loads(second, "shard")[0] <= 0.02 * loads(second, "shard")[1]
    assert sum(before[k]["shard"] != after[k]["shard"] for k in before) < 600


def test_slot_maps(spark, tmp_path):
    first = sharding.SlotMap.initial(24)
    grown = first.grown()
    moved = [k for k in range(sharding.SLOTS) if first.owner[k] != grown.owner[k]]
    assert {grown.owner[k] for k in moved} == {24} and len(moved) == sharding.SLOTS // 25 and grown.version == 2
    sizes = {k: 1 + k % 97 * (k % 24 == 3) for k in range(sharding.SLOTS)}
    even = first.rebalanced(sizes)
    load = [sum(sizes[k] for k in range(sharding.SLOTS) if even.owner[k] == s) for s in range(24)]
    assert max(load) - min(load) <= 0.02 * sum(load) / 24 + 97 and even.version == 2 and even.rebalanced(sizes).owner == even.owner
    for m in (first, even):
        m.save(spark, str(tmp_path / "map"))
        assert sharding.SlotMap.load(spark, str(tmp_path / "map"), m.version) == m
    with pytest.raises(ValueError):
        sharding.SlotMap.initial(0)


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start = docs.collect()
    clean = [r for r in start if len(r["text"].split()) > 80][:25]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.first()["text"]
    long = clean[0]["text"].split()
    extra = [(9001, None), (9002, "12345 !!!"), (9003, " ".join([*long[:-1], "other"])), (9004, clean[1]["text"] + " " + item), (9005, " ".join(clean[2]["text"].split()[::-1]) + ' token = "abcdefgh12345678" end')]
    rows = [tuple(r) for r in start] + [(i, t, "en", "x", None) for i, t in extra]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    left, frame = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        frame = spark.read.parquet(str(tmp_path / f"s{k}"))
        left.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    assert not {9001, 9002} & left[0] and {r["doc_id"] for r in start} <= left[0]
    assert len({9003, clean[0]["doc_id"]} & left[1]) == 1
    assert 9004 not in left[2] and left[3] == left[2] == left[4]
    final = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert "[assign]" in final[9005] and "abcdefgh12345678" not in final[9005]
    decoder = packing.Encoder(queries.tokenizer_path()).tokenizer
    parts = collections.defaultdict(dict)
    for r in frame.collect():
        parts[r["doc_id"]][r["piece"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, text in final.items():
        ids = [x for k in sorted(parts[i]) for x in parts[i][k]]
        assert ids[-1] == 0 and decoder.decode(ids[:-1], skip_special_tokens=False) == text
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == left[4]


def test_registered_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 11))
    for name, sql in queries.oracle_sql().items():
        df = found[name](spark, "/root/testdata/sf0.001")
        names, result = sorted(df.columns), con.execute(sql)
        at = [[d[0] for d in result.description].index(n) for n in names]
        assert sorted([str(r[n]) for n in names] for r in df.collect()) == sorted([str(r[i]) for i in at] for r in result.fetchall()), name


def test_words_of_items():
    assert decontam.tokens(["a-b", None]).counts().tolist() == [2, 0]


def test_head_words_are_exact_and_ties_go_by_bytes(spark):
    """More words than the head takes, of which the last places tie, most of them in one part."""
    counts = {f"w{k}".encode(): 5 for k in range(lm.HEAD)} | {b"first": 9, b"last": 9, "é".encode(): 9} | {f"x{k}".encode(): 2 for k in range(300)}
    text = " ".join(w.decode() for w, n in counts.items() for _ in range(n))
    rows = spark.createDataFrame([(1, text), (4, None), (5, "")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    with Scratch(spark) as store:
        for parts in (1, 5):
            merged = store.stage(lm.merge_counts(lm.send_counts(store.stage(lm.coded(rows, 1 << 20)), parts)))
            want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.HEAD - 1]
            assert [(bytes(r["word"]), r["count"]) for r in lm.head_words(merged).collect()] == want
            totals = {r["class"]: (r["tokens"], r["kinds"]) for r in lm.tail_totals(merged).collect()}
            assert sum(t for t, _ in totals.values()) == sum(counts.values()) and sum(k for _, k in totals.values()) == len(counts)
            assert len(totals) == lm.TAIL_CLASSES and all(k == sum(lm.tail_class(w) == c for w in counts) for c, (_, k) in totals.items())


def test_gates_stay_in_range_without_warnings():
    x = np.array([-1e4, -90, 0, 90, 1e4], dtype=np.float32)
    with np.errstate(all="raise", under="ignore"):
        assert lm.sigmoid(x).tolist()[1:] == pytest.approx([0, 0.5, 1, 1])
