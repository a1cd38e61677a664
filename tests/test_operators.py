import dataclasses
import datetime
import gzip
import json
import random
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import sparktok
from sparktok import cli, queries
from sparktok.functions import normalize, schemes
from sparktok.operators import batch, compare, counts, encode, fragments, scan, shape, train
from sparktok.operators import encoder as encoder_module
from sparktok.operators.encoder import decode, encoder
from sparktok.plans.model import AddedToken, Metaspace, TokenizerModel
from sparktok.sources import files
from sparktok.streaming import encode as streams

TEXTS = ["The quick brown fox jumps over the lazy dog.", "Café society meets at dawn.", "日本語のテキストです。", "A final short document."]
END = "<|endoftext|>"


@pytest.fixture(scope="module")
def model():
    return queries.small_model()


def ids_of(df):
    return [r["ids"] for r in df.orderBy("doc_id").collect()]


# ---- encoding


def test_columns_binary_null_and_round_trip(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None, "the" + END])], "doc_id long, text string")
    own = encoder(model)
    got = ids_of(encode.encode(df, model))
    assert got == [None if t is None else own(t) for t in [*TEXTS, "", None, "the" + END]] and got[-1][-1] == 256
    assert ids_of(encode.encode(df.withColumn("text", F.col("text").cast("binary")), model)) == got
    assert ids_of(encode.encode(df.coalesce(1), model)) == got
    back = encode.decode_text(encode.encode(df, model).drop("text"), model).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == [*TEXTS, "", None, "the" + END]
    joined = encode.decode_join(encode.encode(df.where("text is not null"), model).drop("text"), model.vocab_table(spark), "doc_id").orderBy("doc_id").collect()
    assert [r["text"] for r in joined] == [*TEXTS, "", "the" + END]


def test_invalid_utf8(spark, model):
    df = spark.createDataFrame([(0, bytearray(b"a\xff\xfeb"))], "doc_id long, text binary")
    assert ids_of(encode.encode(df, model)) == [[97, 255, 254, 98]]
    with pytest.raises(Exception, match="utf-8|UTF-8"):
        encode.encode(df, queries.piece_model()).collect()


def test_unknown_ids_in_the_join_are_an_error(spark, model):
    df = spark.createDataFrame([(0, [97, 99999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside"):
        encode.decode_join(df, model.vocab_table(spark), "doc_id").collect()


def test_sql_functions(spark, model):
    encode.register(spark, model, "t")
    assert spark.sql("select t_decode(t_encode('the cat')) as x, t_encode(null) as y").first()[:] == ("the cat", None)


def test_model_tables(spark, model):
    assert model.vocab_table(spark).count() == len(model.vocab_dict()) and model.merges_table(spark).count() == 60
    assert model.added_table(spark).first()["content"] == END and "merges=60" in repr(model)


# ---- shapes


def rows(spark, *ids):
    return spark.createDataFrame([(i, list(x)) for i, x in enumerate(ids)], "doc_id long, ids array<int>")


def test_padding(spark):
    df = rows(spark, [1, 2, 3, 4, 5], [6], [])
    out = shape.pad(df, shape.Padding(0)).orderBy("doc_id").collect()
    assert [r["ids"] for r in out] == [[1, 2, 3, 4, 5], [6, 0, 0, 0, 0], [0] * 5] and [r["length"] for r in out] == [5, 1, 0] and out[1]["mask"] == [1, 0, 0, 0, 0]
    out = shape.pad(df, shape.Padding(9, 4, True, True, True, True, (7,), (8,))).orderBy("doc_id").collect()
    assert [r["ids"] for r in out] == [[7, 4, 5, 8], [9, 7, 6, 8], [9, 9, 7, 8]] and [r["length"] for r in out] == [4, 3, 2]
    for bad in (shape.Padding(0, 1, prefix=(1, 2)), shape.Padding(0, truncate=True), shape.Padding(0, 3)):
        with pytest.raises(ValueError):
            shape.pad(df, bad)
    with pytest.raises(Exception, match="a row has 5 tokens, max_length is 3"):
        shape.pad(df, shape.Padding(0, 3, True)).collect()


def test_wrapping(spark):
    got = rows(spark, [1, 2, 3], []).select("doc_id", shape.wrap(F.col("ids"), (8,), (9,), 2, True).alias("ids"))
    assert ids_of(got) == [[8, 2, 3, 9], [8, 9]]


def test_packed(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, ""])], "doc_id long, text string")
    ids = encode.encode(df, model)
    ragged = ids_of(ids)
    packed = shape.Packed.of(ids.orderBy("doc_id"))
    assert packed.to_list() == ragged and len(packed) == 5 and packed.token_count == sum(map(len, ragged)) and packed[-1].tolist() == []
    with pytest.raises(IndexError):
        packed[5]
    offsets = [r["offset"] for r in shape.packed_offsets(ids, "doc_id").orderBy("doc_id").collect()]
    assert offsets == packed.offsets[:-1].tolist()


# ---- texts


def test_splitting_and_scanning(spark):
    df = spark.createDataFrame([("a||b||||c",), ("|",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(scan.split_docs(F.col("text"), "||")).collect()] == [["a", "b", "c"], ["|"], [], None]
    assert [r[0] for r in df.select(scan.split_added(F.col("text"), ["|", "||"])).collect()][:2] == [["a", "||", "b", "||", "||", "c"], ["|"]]
    assert scan.forbidden(df, ["b", "zz"]).orderBy("pattern").collect()[0]["found"]
    with pytest.raises(scan.ForbiddenText) as e:
        scan.refuse(df, ["zz", "c", "||"])
    assert e.value.indices == [1, 2] and scan.refuse(df, ["zz"]) is df


def test_limit_bytes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "", "éé", "xyz"])], "doc_id long, text string")
    for most in range(0, 12):
        got = b"".join(bytes(r["text"]) for r in scan.limit_bytes(df, most).orderBy("doc_id").collect())
        assert got == "abcééxyz".encode()[:most]
    assert scan.limit_bytes(df, None).count() == 4
    # As long as all before it fits, an empty document stays; one that would be cut to nothing doesn't.
    assert [r["doc_id"] for r in scan.limit_bytes(df, 3).orderBy("doc_id").collect()] == [0, 1]
    assert [scan.parse_size(x) for x in ("100MB", "2kb", "7", "1.5G", "none")] == [100_000_000, 2000, 7, 1_500_000_000, None]
    with pytest.raises(ValueError):
        scan.parse_size("lots")


KEYS = {
    "long": [None, -5, 0, 7, 8, 12, 10**15],
    "string": [None, "", "a", "ab", "abcdefghij", "abcdefghik", "é"],
    "timestamp": [None, *(datetime.datetime(y, 1, 1) for y in (1950, 1999, 2024, 2025, 2026, 9000))],
    "double": [None, float("-inf"), -1.5, 0.0, 2.5, float("inf"), float("nan")],
    "binary": [None, bytearray(b""), bytearray(b"a"), bytearray(b"a\xff"), bytearray(b"b"), bytearray(b"c"), bytearray(b"d")],
}


@pytest.mark.parametrize("kind", KEYS)
def test_orders_of_keys(spark, kind):
    """Null keys come first; keys that share their first bytes or lie far off are in order."""
    texts = ["nul", "abc", "", "éé", "xyz", "1234567", None]
    data = list(enumerate(zip(KEYS[kind], texts)))
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in random.Random(1).sample(data, 7)], f"key {kind}, text string, n int").repartition(3)
    whole = "".join(t or "" for t in texts).encode()
    for most in (0, 3, 4, 8, 100):
        got = scan.limit_bytes(df, most, "key").orderBy("n").collect()
        assert b"".join(bytes(r["text"] or b"") for r in got) == whole[:most] and (most < 100 or (len(got) == 7 and got[-1]["text"] is None))
    offsets = shape.packed_offsets(df.withColumn("ids", F.when(F.col("text") != "xyz", F.array_repeat(F.lit(1), F.length("text")))), "key", ranges=4).collect()
    assert len(offsets) == 7 and sum(r["length"] for r in offsets) == 3 + 3 + 2 + 7 and [r["offset"] for r in offsets if r["key"] is None] == [0]
    assert sorted(r["offset"] for r in offsets) == [0, 3, 6, 6, 8, 8, 15]


def test_keys_without_an_order_are_refused(spark):
    with pytest.raises(TypeError, match="order"):
        scan.limit_bytes(spark.createDataFrame([([1], "a")], "doc_id array<int>, text string"), 5)


def test_ranges_follow_the_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 7, F.lit(10**17)).otherwise(F.col("id")).alias("key"))
    sizes = [r["count"] for r in df.select(scan.key_block(df, "key", 16).alias("b")).groupBy("b").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 500


def test_normalizers(spark):
    df = spark.createDataFrame([(t,) for t in ("a  b   c d  ", "a \t  b", " x\xa0", "é", "")], "text string")
    assert [r[0] for r in df.select(normalize.collapse_spaces(F.col("text"), "▁")).collect()][:2] == ["a▁b▁c d▁", "a \t▁b"]
    assert [r[0] for r in df.select(normalize.strip(F.col("text"))).collect()][2] == "x" == normalize.trim(" x\xa0")
    assert [r[0] for r in df.select(normalize.nfc(F.col("text"))).collect()][3] == "é"
    assert [r[0] for r in df.select(normalize.metaspace(F.col("text"))).collect()][-2:] == ["▁é", ""]


# ---- counting and training


@pytest.mark.parametrize("scheme", sorted(schemes.PATTERNS))
def test_spans_tile_texts(spark, scheme):
    """Pieces by place are those of the texts between literals; null, empty and repeated rows; null keys."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "the", "T", " ", "\n", "7", "é", "漢", "😀", "<m>", "<m", "!", "'s", "\u0301"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "the <m>"), (61, None), (62, ""), (63, texts[0])]
    table = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    for added in ((), ("<m>", "the", "<m")):
        got = counts.pretoken_spans(table, "k", scheme=scheme, added=added).collect()
        for k, text in rows:
            own = sorted((r for r in got if r["k"] == k), key=lambda r: r["pos"])
            raw = (text or "").encode()
            assert [r["pos"] for r in own] == list(range(len(own)))
            assert [r["byte_start"] for r in own] == [0, *(r["byte_end"] for r in own)][: len(own)] and (own[-1]["byte_end"] if own else 0) == len(raw)
            assert all(raw[r["byte_start"] : r["byte_end"]] == r["pretoken"].encode() for r in own)
            assert [r["pretoken"] for r in own if r["added"]] == (regex.findall("<m>|the|<m", text or "") if added else [])
    assert counts.pretoken_spans(table.limit(0), "k", added=("a",)).count() == 0


def test_first_difference_by_ranges(spark):
    """One id, an order, a null for nothing, a row more; keys below zero; only the range that differs is made again."""
    rows = [(k, [k, 1, 2]) for k in range(-50, 400)]
    table = spark.createDataFrame(rows, "n long, ids array<int>").repartition(5)

    def first(changed, keys=16, make=lambda df: df):
        other = spark.createDataFrame(changed, "n long, ids array<int>").repartition(3)
        return [(r["n"], r["left_ids"], r["right_ids"]) for r in compare.first_difference(table, other, make, keys=keys).collect()]

    assert first(rows) == []
    assert first([(k, [k, 2, 1] if k in (77, 300) else v) for k, v in rows]) == [(77, [77, 1, 2], [77, 2, 1])]
    assert first([(k, None if k == -50 else v) for k, v in rows], 1000) == [(-50, [-50, 1, 2], None)]
    assert first([*rows, (400, None)]) == [(400, None, None)] and first(rows[:-1]) == [(399, [399, 1, 2], None)]
    assert first([(k, v[:2]) for k, v in rows], make=lambda df: df.withColumn("ids", F.slice("ids", 1, 1))) == []
    empty = table.limit(0)
    assert compare.first_difference(empty, empty).count() == 0


def test_counts_weights_and_pairs(spark):
    df = spark.createDataFrame([("a a", 2), ("a", 3), ("", 1), (None, 1)], "text string, w int")
    assert {r["pretoken"]: r["cnt"] for r in counts.pretoken_counts(df).collect()} == {"a": 2, " a": 1}
    assert {r["pretoken"]: r["cnt"] for r in counts.pretoken_counts(df, weight="w").collect()} == {"a": 5, " a": 2}
    words = spark.createDataFrame([([1, 1, 1], 5), ([2], 7), ([], 1)], "symbols array<int>, cnt long")
    assert [tuple(r) for r in counts.pair_counts(words).collect()] == [(1, 1, 10)]


def rewrite(word, pair, new):
    """A word with a pair merged, left to right."""
    out = []
    for x in word:
        if out and (out[-1], x) == pair:
            out[-1] = new
        else:
            out.append(x)
    return out


def naive(words, size, specials, key):
    vocab, words, merges = [bytes([b]) for b in range(256)] + [s.encode() for s in specials], [(list(w), n) for w, n in words], []
    while len(vocab) < size:
        count = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                count[p] += n
        if not count:
            break
        best = min(count, key=lambda p: (-count[p], key(p, vocab)))
        merges.append((*best, len(vocab)))
        words = [(rewrite(w, best, len(vocab)), n) for w, n in words]
        vocab.append(vocab[best[0]] + vocab[best[1]])
    return merges


def test_distributed_training_equals_that_on_the_driver(spark):
    """Few letters, so that pairs tie, overlap and share symbols; rounds of few pairs; more merges asked for than there are."""
    rng = random.Random(6)
    for most, size, tie in ((2, 256 + 7, "huggingface"), (5, 256 + 7, "assembled_bytes"), (1000, 999, "raw_token_ids")):
        words = Counter(bytes(rng.choice(b"aab ") for _ in range(rng.randint(1, 5))) for _ in range(12))
        table = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()], "word binary, cnt long").coalesce(2)
        assert train.train_distributed(table, size, (), tie, most) == train.train(list(words.items()), size, (), tie)


def test_distributed_training_of_runs_and_repeated_rows(spark):
    """A pair of equal symbols makes pairs that are more frequent than others of its round; rows of a word are added up."""
    rows = [(b"aaaaaaaa", 10), (b"bc", 8), (b"de", 4), (b"de", 4), (None, 9), (b"fg", 0), (b"", 3), (b"aab", 2)]
    table = spark.createDataFrame([(None if w is None else bytearray(w), n) for w, n in rows], "word binary, cnt long")
    once = [(b"aaaaaaaa", 10), (b"bc", 8), (b"de", 8), (b"aab", 2)]
    for most in (1, 3, 100):
        assert train.train_distributed(table, 999, (), "raw_token_ids", most) == train.train(once, 999, (), "raw_token_ids")
    assert train.train_distributed(table.limit(0), 999).merges == ()


@pytest.mark.parametrize("tie", train.TIES)
def test_rounds_hold_few_pairs_and_read_the_words_of_theirs_only(spark, tie):
    rng = random.Random(8)
    words = Counter(bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300))
    table = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()], "word binary, cnt long").coalesce(2)
    assert train.train_distributed(table, 256 + 1 + 12, ("<s>",), tie, 7) == train.train(list(words.items()), 256 + 1 + 12, ("<s>",), tie)
    rounds = train.Rounds(table, vocab := [bytes([b]) for b in range(256)], tie, 5)
    vocab.append(b"ab")
    rounds.apply([(97, 98, 256)])
    assert len(rounds.held) <= 10 and {r["word"] for r in rounds._words([(256, 99)]).collect()} == {w for w in words if b"abc" in w}


@pytest.mark.parametrize("tie", train.TIES)
def test_training_equals_recounting(tie):
    from sparktok.plans.loaders import byte_alphabet

    alphabet = byte_alphabet()
    order = {b: k for k, b in enumerate(alphabet[c] for c in sorted(alphabet))}
    keys = {"huggingface": lambda p, v: tuple(order.get(x, x) for x in p), "raw_token_ids": lambda p, v: p, "assembled_bytes": lambda p, v: (v[p[0]].decode("latin-1"), v[p[1]].decode("latin-1"))}
    rng = random.Random(2)
    for _ in range(25):
        words = Counter(bytes(rng.choice(b"ab \xc3\xa9!") for _ in range(rng.randint(1, 9))) for _ in range(30))
        got = train.train(list(words.items()), 256 + 1 + rng.randint(0, 40), ("<s>",), tie)
        assert list(got.merges) == naive(list(words.items()), len(got.vocab), ("<s>",), keys[tie])


def test_training_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = train.train_bpe(docs, 256 + 15, ("<s>",))
    words = Counter(w.encode() for r in docs.collect() for w in regex.findall(schemes.PATTERNS["gpt2"][0], r["text"]))
    assert got == train.train(list(words.items()), 256 + 15, ("<s>",)) and len(got.merges) == 14
    assert train.train_bpe(docs, 256 + 15, ("<s>",), most_words=100) == got
    assert train.train([], 100).vocab == tuple(bytes([b]) for b in range(256))
    with pytest.raises(ValueError):
        train.train_bpe(docs, 300, tie_breaking="coin")


# ---- sources


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "d.txt").write_text(END.join(TEXTS))
    lines = "".join(json.dumps({"text": t, "id": i}, ensure_ascii=i % 2 == 0) + "\n\n" for i, t in enumerate(TEXTS))
    (folder / "d.jsonl").write_text(lines)
    for name in ("d.txt", "d.jsonl"):
        data = (folder / name).read_bytes()
        (folder / f"{name}.gz").write_bytes(gzip.compress(data))
        with pa.CompressedOutputStream(str(folder / f"{name}.zst"), "zstd") as out:
            out.write(data)
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"text": [*TEXTS[:2], None, *TEXTS[2:], ""], "raw": pa.array([b"x"] * 6, pa.binary()), "id": list(range(6))}), folder / "d.parquet")
    return folder


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def test_all_formats_read_the_same(spark, corpus):
    for name in ("d.txt", "d.txt.gz", "d.txt.zst"):
        assert texts(files.TextSource(corpus / name, END).read(spark)) == TEXTS
        assert texts(files.TextSource(str(corpus / name)).read(spark)) == [END.join(TEXTS)]
    for name in ("d.jsonl", "d.jsonl.gz", "d.jsonl.zst"):
        assert texts(files.resolve(corpus / name).read(spark)) == TEXTS
    assert texts(files.resolve(str(corpus / "d.parquet")).read(spark)) == [*TEXTS[:2], "", *TEXTS[2:], ""]
    assert [bytes(t) for t in texts(files.ParquetSource(corpus / "d.parquet", "raw").read(spark))] == [b"x"] * 6
    assert texts(files.BytesSource(["a,b", ",c"], ",").read(spark)) == ["a", "b", "c"]


def test_documents_of_several_lines(spark, tmp_path):
    """Whole files and parted ones keep their line ends; a file of no bytes is no document."""
    parts = ["a\nb\r\n", "\n", "c\n\nd"]
    for name, data in (("m.txt", END.join(parts)), ("e.txt", "")):
        (tmp_path / name).write_bytes(data.encode())
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data.encode()))
        with pa.CompressedOutputStream(str(tmp_path / f"{name}.zst"), "zstd") as out:
            out.write(data.encode())
    for ending in ("", ".gz", ".zst"):
        assert texts(files.TextSource(tmp_path / f"m.txt{ending}").read(spark)) == [END.join(parts)]
        assert texts(files.TextSource(tmp_path / f"m.txt{ending}", END).read(spark)) == parts
        assert texts(files.TextSource(tmp_path / f"e.txt{ending}").read(spark)) == ([""] if ending else [])
        assert texts(files.TextSource(tmp_path / f"e.txt{ending}", END).read(spark)) == []


def test_small_tables_are_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(9).write.parquet(str(tmp_path / "many"))
    one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert files.spread(one).rdd.getNumPartitions() == 4 and files.spread(one).count() == 1000 and files.spread(many) is many
    monkeypatch.setattr(files, "SPREAD_BYTES", 10)
    assert files.spread(one) is one


def test_source_errors(spark, corpus, tmp_path):
    with pytest.raises(ValueError, match="there are: text"):
        files.ParquetSource(corpus / "d.parquet", "nope").read(spark)
    with pytest.raises(ValueError, match="bigint"):
        files.ParquetSource(corpus / "d.parquet", "id").read(spark)
    with pytest.raises(TypeError):
        files.BytesSource(["a", b"b"])
    with pytest.raises(Exception):
        files.TextSource("/nowhere/x.txt").read(spark).collect()
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"text": "ok"}\n{"text": 3}\nnot json\n{"other": "x"}\n')
    assert texts(files.JsonlSource(bad, on_error="skip").read(spark)) == ["ok"]
    assert texts(files.JsonlSource(bad, on_error="null").read(spark)) == ["ok", None, None, None]
    with pytest.raises(Exception, match="no string field"):
        files.JsonlSource(bad).read(spark).collect()
    with pytest.raises(ValueError):
        files.JsonlSource(bad, on_error="shrug")


def test_detect_format():
    for name, want in {"a.txt": ("text", None), "a.jsonl.gz": ("jsonl", "gz"), "a.parquet": ("parquet", None), "a.zst": ("text", "zst"), "a.jsonl.zstd": ("jsonl", "zst"), "a": ("text", None)}.items():
        assert files.detect_format(name) == want


# ---- command line, streams, entry


def test_command_line(spark, corpus, tmp_path, capsys, model):
    path = tmp_path / "t.tiktoken"
    import base64

    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)))
    assert cli.main(["bench", str(path), str(corpus / "d.txt"), "--limit-bytes", "40"]) == 0 and "40 bytes, 40 tokens" in capsys.readouterr().out
    assert cli.main(["validate", str(path), str(corpus / "d.txt")]) == 0 and "all documents match" in capsys.readouterr().out
    left, right = rows(spark, [1], [2]).withColumnRenamed("doc_id", "n"), rows(spark, [1], [3], [4]).withColumnRenamed("doc_id", "n")
    assert sorted(r["n"] for r in compare.mismatches(left, right).collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path, model):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(END.join(TEXTS))
    stream = streams.encode_stream(streams.read_texts(spark, str(folder), END), model)
    query = stream.writeStream.format("memory").queryName("encoded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    own = encoder(model)
    assert sorted((r["text"], r["ids"]) for r in spark.table("encoded").collect()) == sorted((t, own(t)) for t in TEXTS)
    batch = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    assert {tuple(r) for r in streams.running_counts(batch).collect()} == {tuple(r) for r in counts.pretoken_counts(batch).collect()}


def test_charsmaps_that_are_built(spark):
    """Shared beginnings and keys inside others; clusters replaced whole up to five bytes, else by character; the column against one text at a time."""
    from sparktok.operators.charsmap import Charsmap, build, precompiled

    rng = random.Random(4)
    keys = {"".join(rng.choice("abcé漢ﬁ") for _ in range(rng.randint(1, 3))): rng.choice(["", "z", "ßß"]) for _ in range(200)}
    found = Charsmap(build(keys))._find
    for key in keys:
        shortest = next(k for n in range(1, len(key) + 1) if (k := key[:n]) in keys)
        assert found(key.encode()) == keys[shortest]
    assert found(b"q") is None and found("ü".encode()) is None
    accents = Charsmap(build({"e": "E", "\u0301": "+", "\r": "R", "👩": "w"}))
    # Two characters in one cluster; clusters above five bytes; a line end of two characters, a zero.
    assert [accents(t) for t in ("e", "e\u0301", "e\u0301\u0301\u0301", "\r\n", "👩\u200d👩", "q\0")] == ["E", "E", "E+++", "R", "w\u200dw", "q\0"]
    texts = [None, "", "none", *("".join(rng.choice("abcdé漢ﬁ\u0301 \0") for _ in range(rng.randint(0, 12))) for _ in range(80)), "q"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    few = build({"é": "e", "漢ﬁ": "x", "a": ""})
    got = {r["k"]: r["out"] for r in precompiled(table, few, out="out").collect()}
    assert got == {k: None if t is None else Charsmap(few)(t) for k, t in enumerate(texts)}
    assert precompiled(table.limit(0), few).count() == 0 and [r["text"] for r in precompiled(table, build({})).orderBy("k").collect()] == texts
    for bad in ({"": "a"}, {"a\0": "b"}):
        with pytest.raises(ValueError):
            build(bad)


def test_charsmap():
    import struct

    from sparktok.operators.charsmap import Charsmap

    # A trie of one string: unit 0 is the root, the child of byte b sits at offset ^ b.
    target, new = "ﬁ".encode(), b"fi\0"
    units, node, base = [0] * 2048, 0, 256
    units[0] = base << 10
    at = base
    for k, byte in enumerate(target):
        node = at ^ byte
        nxt = 512 + 256 * k
        units[node] = byte | (node ^ nxt) << 10 | (1 << 8 if k == len(target) - 1 else 0)
        at = nxt
    units[at] = 1 << 31
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + new
    assert Charsmap(blob)("aﬁb") == "afib"
    with pytest.raises(ValueError):
        Charsmap(struct.pack("<I", 400))


def test_every_query_gives_rows(spark, sf):
    for name, query in queries.queries().items():
        assert query(spark, sf).count() > 0, name
    assert set(queries.oracle_sql()) == set(queries.queries())
    assert isinstance(queries.small_model(), TokenizerModel)


def test_queries_equal_their_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "events", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = queries.queries()
    for name, sql in queries.oracle_sql().items():
        df = found[name](spark, sf)
        names = sorted(df.columns)
        result = con.execute(sql)
        at = [[d[0] for d in result.description].index(n) for n in names]
        assert sorted([str(r[n]) for n in names] for r in df.collect()) == sorted([str(r[i]) for i in at] for r in result.fetchall()), name


# ---- whole calls


def test_batches_in_memory(spark, model):
    own = encoder(model)
    for given in (TEXTS, [t.encode() for t in TEXTS], tuple(TEXTS), pa.array(TEXTS, pa.large_string()), pa.chunked_array([TEXTS[:1], TEXTS[1:]]), pa.array([t.encode() for t in TEXTS]), pa.array(TEXTS).dictionary_encode()):
        assert ids_of(batch.encode_batch(spark, given, model)) == [own(t) for t in TEXTS]
    assert ids_of(batch.encode_batch(spark, [], model)) == [] and ids_of(batch.encode_batch(spark, pa.array(["a", None]), model)) == [[97], None]
    for bad in (["a", b"a"], [1], "a", [None], pa.array([1]), pa.array([["a"]])):
        with pytest.raises(TypeError):
            batch.texts(spark, bad)


def test_files_in_one_call(spark, model, tmp_path):
    own = encoder(model)
    (tmp_path / "a.txt").write_text(END.join(TEXTS))
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in TEXTS))
    source = files.TextSource(tmp_path / "a.txt", END)
    assert ids_of(batch.encode_files(spark, source, model)) == [own(t) for t in TEXTS] == ids_of(batch.encode_files(spark, str(tmp_path / "b.jsonl"), model))
    packed = batch.encode_files(spark, source, model, packed=True)
    assert packed.to_list() == [own(t) for t in TEXTS]
    with pytest.raises(ValueError, match="one format"):
        files.resolve([str(tmp_path / "a.txt"), str(tmp_path / "b.jsonl")])
    want = Counter(p for t in TEXTS for p in regex.findall(schemes.PATTERNS["gpt2"][0], t))
    for found in (batch.pretoken_counts_files(spark, str(tmp_path / "a.txt")), batch.pretoken_counts_files(spark, source), batch.pretoken_counts_files(spark, str(tmp_path / "b.jsonl"))):
        assert {r["pretoken"]: r["cnt"] for r in found.collect()} == want
    assert "tok/s" in cli.bench(spark, model, source.read(spark), packed=True)


def test_wrapped_and_padded_in_one_call(spark, model):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    own = encoder(model)
    rule = batch.Wrapping((1,), (2,), 3, True, ("zzz",))
    assert ids_of(batch.encode_wrapped(df, model, rule)) == [[1, *own(t)[-3:], 2] for t in TEXTS]
    assert ids_of(batch.encode_padded(df, model, shape.Padding(0, 4, True, True), ("zzz",))) == [own(t)[:4] for t in TEXTS]
    for call in (lambda: batch.encode_wrapped(df, model, batch.Wrapping(forbid=("q", "zz", "quick"))), lambda: batch.encode_padded(df, model, shape.Padding(0), ("q", "zz", "quick"))):
        with pytest.raises(scan.ForbiddenText) as e:
            call()
        assert e.value.indices == [0, 2]


@pytest.mark.parametrize("scheme", list(schemes.PATTERNS))
def test_long_texts_are_cut_where_no_token_crosses(spark, model, scheme):
    tokens = (AddedToken("b cd", 300), AddedToken("x1", 301, rstrip=True), AddedToken("<m>", 302, lstrip=True, rstrip=True))
    cut = dataclasses.replace(model, scheme=scheme, added=tokens)
    rng = random.Random(scheme)
    parts = ["a", "b cd", "x1", " ", "  ", "\n", "<m>", "word", "12", "don't", "é", ".", " b", " cd", "日本"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(60)] + [None, "", "word " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("more", F.lit(1))
    for target in (1, 20):
        for t in texts:
            edges = [0, *fragments.cuts(t or "", target, tokens), len(t or "")]
            assert edges == sorted(edges) and all(b - a >= target for a, b in zip(edges, edges[1:-1]))
    got = fragments.encode_long(df, cut, "doc_id", target=20)
    assert ids_of(got) == ids_of(encode.encode(df, cut)) and set(got.columns) == {"doc_id", "text", "more", "ids"}
    assert len(fragments.cuts("word " * 400, 20)) > 50


def _piece_models():
    base = queries.piece_model()
    tokens = (AddedToken("</s>", 2, special=True), AddedToken("the end", 1, normalized=True), AddedToken("<r>", 0, rstrip=True))
    for prepend in ("always", "first", "never"):
        for split in (True, False):
            yield dataclasses.replace(base, added=tokens, metaspace=Metaspace("▁", prepend, split))
    yield dataclasses.replace(base, added=tokens, metaspace=None, steps=(("strip", (True, True)), ("prepend", ("▁",)), ("collapse", ("▁",)), ("replace", (" ", "▁"))))


def test_piece_models_cut_at_marks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "on", " ", "  ", "▁", "é", "den", "</s>", "the end", "<r>", "x", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, " ", "a" * 300, " ".join(t for t in texts * 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for model in _piece_models():
        assert fragments.mark_of(model) == "▁"
        own = encoder(model)
        got = {r["doc_id"]: r["ids"] for r in fragments.encode_long(df, model, "doc_id", target=15).collect()}
        assert got == {i: None if t is None else own(t) for i, t in enumerate(texts)}
    parts = fragments.sections(df.where("length(text) > 10000"), model, "doc_id", target=100)
    assert parts.count() > 100


def test_models_whose_tokens_cross_marks_are_not_cut(spark):
    base = queries.piece_model()
    n = len(base.vocab)
    over = dataclasses.replace(base, vocab=(*base.vocab, "e▁".encode()), merges=(*base.merges, (264, 259, n)))
    assert fragments.mark_of(over) == "▁"
    whole = dataclasses.replace(over, metaspace=Metaspace("▁", "always", False))
    assert fragments.mark_of(whole) is None and fragments.mark_of(dataclasses.replace(base, metaspace=None)) is None
    with pytest.raises(ValueError):
        fragments.encode_long(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), whole, "doc_id", target=1)


def test_pieces_that_are_added_tokens(spark):
    """Where added tokens aren't looked for, a piece that is the content of one is that token, above or below the merge's id."""
    single = tuple(bytes([b]) for b in range(256))
    df = spark.createDataFrame([(0, "hi"), (1, "hip hi")], "doc_id long, text string")
    for vocab, merged, own in ((single + (b"hi",), 256, 1000), (single + (b"", b"hi"), 257, 256)):
        m = TokenizerModel("byte", vocab, ((104, 105, merged),), (AddedToken("hi", own),))
        assert ids_of(encode.encode(df, m, added=False)) == [[own], [merged, 112, 32, merged]]
    long = TokenizerModel("byte", single, (), (AddedToken("h" * 16, 300), AddedToken("h" * 15, 301)))
    got = ids_of(encode.encode(spark.createDataFrame([(0, "h" * 16), (1, "h" * 15)], "doc_id long, text string"), long, added=False))
    assert got == [[104] * 16, [301]]


def test_kinds_of_ids(spark, model):
    for kind in ("smallint", "int", "bigint"):
        assert encode.decode_text(spark.createDataFrame([([104, 105],), (None,)], f"ids array<{kind}>"), model).select("text").collect()[0]["text"] == "hi"
    for kind in ("string", "double"):
        with pytest.raises(TypeError, match="whole numbers"):
            encode.decode_text(spark.createDataFrame([], f"ids array<{kind}>"), model)
    piece = queries.piece_model()
    assert decode(piece, [99999, 259, 266, *b"\x04"]) == decode(piece, [259, 266, 4])
    for bad in (-1, 1 << 32):
        with pytest.raises(OverflowError):
            decode(piece, [bad])
    with pytest.raises(IndexError, match="-1"):
        decode(model, [-1])
    with pytest.raises(Exception, match="outside the vocabulary"):
        encode.decode_text(spark.createDataFrame([([99999],)], "ids array<int>"), model).collect()


def test_decoding_many_arrays(spark, model, monkeypatch):
    monkeypatch.setattr(encoder_module, "DECODED", 7)
    rng = random.Random(2)
    ids = [[rng.randrange(len(model.vocab)) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    got = encoder_module.Decoder(model)(pa.array([*ids, None], pa.list_(pa.int32()))).to_pylist()
    assert got == [b"".join(model.vocab[i] for i in x).decode("utf-8", "replace") for x in ids] + [None]


def test_version():
    assert sparktok.__version__
