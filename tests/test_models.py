import base64
import json
import random

import numpy as np
import pytest

from sparktok import queries
from sparktok.operators import encoder as encoder_module
from sparktok.operators.encoder import decode, encoder
from sparktok.operators.merging import Table, _merge_long, merge
from sparktok.plans import loaders
from sparktok.plans.model import AddedToken, Metaspace


def byte_json(vocab=(), merges=(), added=(), pre=None, normalizer=None, **model) -> str:
    shown = {b: c for c, b in loaders.byte_alphabet().items()}
    ids = {shown[b]: b for b in range(256)} | dict(vocab)
    pre = {"type": "ByteLevel", "add_prefix_space": False} if pre is None else pre
    return json.dumps({"model": {"type": "BPE", "vocab": ids, "merges": list(merges), **model}, "added_tokens": list(added), "pre_tokenizer": pre, "normalizer": normalizer})


def token(content, i, **flags):
    return {"content": content, "id": i, "special": True, **flags}


def encode(text, **k):
    return encoder(loaders.load_hf_json(byte_json(**k)))(text)


def test_rank_order_not_id_order():
    k = {"vocab": {"bc": 350, "ab": 300}, "merges": [["b", "c"], ["a", "b"]]}
    assert [encode(t, **k) for t in ("abc", "ab", "bc")] == [[97, 350], [300], [350]]
    assert encode("abc", vocab={"bc": 300, "ab": 350}, merges=["b c", "a b"]) == [97, 300]


def test_added_tokens_strip_white_space():
    k = {"added": [token("<m>", 400, lstrip=True), token("<r>", 401, rstrip=True)]}
    cases = {"a <m> b": [97, 400, 32, 98], "a \t\n<m>": [97, 400], "a\xa0<m>": [97, 400], "a <r> b": [97, 32, 401, 98], "<r>\n\n\nb": [401, 98], "<r> <m>": [401, 400]}
    for text, ids in cases.items():
        assert encode(text, **k) == ids, text


def test_prefix_space():
    k = {"added": [token("<m>", 400, lstrip=True)], "pre": {"type": "ByteLevel", "add_prefix_space": True}}
    cases = {"ab": [32, 97, 98], " ab": [32, 97, 98], "a<m>b": [32, 97, 400, 32, 98], "<m><m>": [400, 400], "x <m> y": [32, 120, 400, 32, 121], "": []}
    for text, ids in cases.items():
        assert encode(text, **k) == ids, text


def test_longest_added_token_wins_and_last_duplicate():
    assert encode("hi", added=[token("hi", 256), token("hi", 1000)]) == [1000]
    assert encode("abc", added=[token("ab", 300), token("abc", 301)]) == [301]


def test_ignore_merges_and_no_shortcut():
    k = {"vocab": {"abc": 300}, "merges": []}
    assert encode("abc", **k) == [97, 98, 99]
    assert encode("abc", ignore_merges=True, **k) == [300]


def test_nfc_and_bytes_that_are_not_utf8():
    assert encode("é", normalizer={"type": "NFC"}) == list("é".encode())
    assert encode(b"a\xffb".decode("utf-8", "surrogateescape")) == [97, 255, 98]


def test_unresolvable_and_repeated_merges():
    m = loaders.load_hf_json(byte_json({"ab": 300, "x": 301}, [["a", "b"], ["a", "b"], ["q", "zz"]]))
    assert m.merges == ((97, 98, 300),)


def test_refuses_what_it_cannot_do():
    for model in ({"type": "Unigram"}, {"type": "WordPiece"}, {"unk_id": 0}, {"max_input_chars_per_word": 100}):
        with pytest.raises(loaders.UnsupportedTokenizer):
            loaders.load_hf_json(json.dumps({"model": {"vocab": {}, "merges": [], **model}}))
    with pytest.raises(loaders.UnsupportedTokenizer):
        loaders.load_hf_json(byte_json(normalizer={"type": "Lowercase"}))
    with pytest.raises(loaders.UnsupportedTokenizer):
        loaders.load_hf_json(byte_json(pre={"type": "Split", "pattern": {"Regex": "x"}}))
    with pytest.raises(ValueError, match="parse"):
        loaders.load_hf_json("{")
    with pytest.raises(ValueError, match="single-byte"):
        loaders.load_hf_json(json.dumps({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}))


def sp_json(meta=None, steps=None) -> str:
    words = ["he", "hel", "hell", "hello", "▁hello", "wo", "wor", "worl", "world", "▁world"]
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", *"helowrd", *words]
    merges = [["h", "e"], ["he", "l"], ["hel", "l"], ["hell", "o"], ["▁", "hello"], ["w", "o"], ["wo", "r"], ["wor", "l"], ["worl", "d"], ["▁", "world"]]
    steps = [{"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}] if steps is None else steps
    added = [{"content": p, "id": i, "special": True, "normalized": True} for i, p in enumerate(pieces[:3])]
    return json.dumps({"model": {"type": "BPE", "byte_fallback": True, "vocab": {p: i for i, p in enumerate(pieces)}, "merges": merges}, "added_tokens": added, "normalizer": {"type": "Sequence", "normalizers": steps}, "pre_tokenizer": meta})


def test_piece_model():
    model = loaders.load_hf_json(sp_json())
    e = encoder(model)
    cases = {"hello world": [271, 276], "hello": [271], "world": [276], "": [], "\U0001f389": [259, 243, 162, 145, 140]}
    for text, ids in cases.items():
        assert e(text) == ids and decode(model, ids).decode() == text
    assert (model.vocab_size, model.vocab[3], model.vocab[259].decode(), model.vocab[276].decode()) == (277, b"\0", "▁", "▁world")
    assert e("<s>hello")[0] == 1
    assert decode(model, [271, 9999]).decode() == "hello"


def test_metaspace_schemes():
    for scheme, want in (("always", [271, 276]), ("first", [271, 276]), ("never", [270, 276])):
        meta = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": scheme, "split": True}
        model = loaders.load_hf_json(sp_json(meta, []))
        assert model.metaspace == Metaspace("▁", scheme, True) and encoder(model)("hello world") == want


def test_tiktoken_files():
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)]
    model = loaders.from_tiktoken(b"\n".join(lines))
    assert model.vocab_size == 257 and encoder(model)("a<|endoftext|>") == [97, 256]
    more = lines + [base64.b64encode(b"ab") + b" 256", base64.b64encode(b"abc") + b" 257"]
    model = loaders.from_tiktoken(b"\n".join(more))
    assert model.merges == ((97, 98, 256), (256, 99, 257)) and encoder(model)("abc") == [257]
    for bad in (lines[:-1] + [base64.b64encode(b"\xff") + b" 300"], lines[:-1] + [base64.b64encode(b"\xff")]):
        with pytest.raises(ValueError):
            loaders.from_tiktoken(b"\n".join(bad))
    config = {"added_tokens_decoder": {"258": {"content": "<x>"}}}
    assert loaders.from_tiktoken_model(b"\n".join(more), config, "o200k").special_tokens() == {"<x>": 258}
    with pytest.raises(ValueError):
        loaders.from_tiktoken_model(b"\n".join(more), {"added_tokens_decoder": {"5": {"content": "<x>"}}}, "kimi")


def test_decode_refuses_unknown_ids():
    model = loaders.load_hf_json(byte_json())
    with pytest.raises(IndexError):
        decode(model, [256])


def test_load_by_path_and_cache(tmp_path):
    (tmp_path / "tokenizer.json").write_text(sp_json())
    assert loaders.load(tmp_path).vocab_size == 277 and loaders.load(tmp_path / "tokenizer.json").kind == "piece"
    with pytest.raises(FileNotFoundError):
        loaders.load("/nowhere/at/all")
    assert loaders.looks_like_repo_id("a/b-c.d") and loaders.looks_like_repo_id("gpt2") and not loaders.looks_like_repo_id("a/b/c") and not loaders.looks_like_repo_id("./x")
    env = {"HF_HUB_CACHE": str(tmp_path / "hub"), "HF_HUB_OFFLINE": "1"}
    there = tmp_path / "hub/models--a--b/snapshots/123"
    there.mkdir(parents=True)
    (there / "f.json").write_text("{}")
    (tmp_path / "hub/models--a--b/refs").mkdir()
    (tmp_path / "hub/models--a--b/refs/main").write_text("123")
    assert loaders.hub_file("a/b", "f.json", env=env) == there / "f.json"
    with pytest.raises(FileNotFoundError):
        loaders.hub_file("a/b", "g.json", env=env)
    assert loaders.hub_token({"HF_TOKEN": " t "}) == "t"


def test_merging_short_and_long_agree():
    rng = random.Random(4)
    for _ in range(300):
        ranks, fresh = {}, 10
        for rank in range(rng.randint(1, 25)):
            pair = rng.randrange(fresh), rng.randrange(fresh)
            if pair not in ranks:
                ranks[pair] = rank, fresh
                fresh += 1
        word = [rng.randrange(6) for _ in range(rng.randint(2, 60))]
        assert merge(word, ranks) == _merge_long(word, ranks)


def test_models_with_changes():
    base = loaders.load_hf_json(byte_json())
    more = base.with_added(AddedToken("<x>", base.vocab_size + 3, special=True))
    assert more.vocab_size == base.vocab_size + 4 and more.vocab[-1] == b"<x>" and more.digest != base.digest
    assert encoder(more)("a<x>b") == [97, more.vocab_size - 1, 98] and len(encoder(base)("<x>")) == 3 and more.special_tokens()["<x>"] == more.vocab_size - 1
    assert encoder(base.with_options(prefix_space=True))("a") == [32, 97]
    for bad in (lambda: base.with_added(AddedToken("", 5)), lambda: base.with_added(AddedToken("a", -1)), lambda: base.with_options(vocab=())):
        with pytest.raises(ValueError):
            bad()


def test_merging_many_words_together():
    """The same as one by one: ranks against the order of ids, pairs that overlap or repeat, empty words, no merges."""
    rng = random.Random(9)
    for _ in range(60):
        ranks = {}
        for rank in range(rng.randint(0, 25)):
            ranks.setdefault((rng.randrange(12), rng.randrange(12)), (rank, rng.randrange(4, 12)))
        words = [[rng.randrange(5) for _ in range(rng.choice((0, 1, 2, 5, 30)))] for _ in range(rng.randint(0, 40))]
        found, sizes = Table(ranks).merge(np.array([x for w in words for x in w], dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64))
        cuts = np.cumsum([0, *sizes])
        assert [found[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [merge(w, ranks) for w in words]


def test_texts_together_equal_texts_one_by_one(monkeypatch):
    monkeypatch.setattr(encoder_module, "TOGETHER", 50)
    rng = random.Random(10)
    texts = [None, "", *("".join(rng.choice(["the ", "<m>", "a\udcffb", "é", "zzz" * 30, " ", "on"]) for _ in range(rng.randint(0, 12))) for _ in range(200))]
    base = queries.small_model()
    for model in (base.with_added(AddedToken("<m>", 330, lstrip=True)), base.with_options(ignore_merges=True, prefix_space=True), queries.piece_model()):
        texts = [t if t is None or model.kind == "byte" else t.replace("\udcff", "") for t in texts]
        own = encoder(model)
        assert encoder(model).packed_all(texts) == [None if t is None else own.packed(t) for t in texts]
    own = encoder(base)
    assert encoder(base).packed_all(texts, False) == [None if t is None else own._joined([own.pieces(t)], own.ordinary) for t in texts]


#: Texts whose ids are known for each of some small models: (case, text, ids), worked out by hand.
KNOWN = (
    ("rank order is list order", "abc", [97, 350]),
    ("rank order is list order", "ab", [300]),
    ("rank order is list order", "bc", [350]),
    ("rank order is id order", "abc", [300, 99]),
    ("whole words first", "abc", [400]),
    ("whole words first", "ab", [300]),
    ("no whole words", "abc", [97, 350]),
    ("added tokens", "a <m> b", [97, 400, 32, 98]),
    ("added tokens", "a \t\n<m>", [97, 400]),
    ("added tokens", "a <r> b", [97, 32, 401, 98]),
    ("added tokens", "<r>\n\n\nb", [401, 98]),
    ("added tokens", "<r> <m>", [401, 400]),
)


@pytest.mark.parametrize(("case", "text", "ids"), KNOWN)
def test_known_texts(case, text, ids):
    assert encoder(queries._known_models()[case])(text) == ids
