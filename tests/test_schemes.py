import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparktok.functions import schemes
from sparktok.functions.pieces import Pieces
from sparktok.operators.encoder import Memo, code

ALPHABET = " \n\r\t\x0b\x85\xa0​\x01\ue000\u3099\u3040\u0301・゠'stSTvLl1Ⅷ½.,!?/()ſéé日本々かナ゛ー漢Ǆǅʰ😀"
CASES = ["", " ", "  a", "a  ", "don't DON'T", "'ſx", "a\r\n\r\n b", "12345 678", "camelCaseHTTPServer", "日本語のテキスト", "x\n\n\n", "foo/bar//\n", " \t\n x", "a 中文b"]


def expected(text: str, scheme: str) -> list[str]:
    pieces = [text] if text else []
    for pattern in schemes.PATTERNS[scheme]:
        compiled, out = regex.compile(pattern, regex.V1), []
        for piece in pieces:
            at = 0
            for m in compiled.finditer(piece):
                out += [piece[at : m.start()], m[0]]
                at = m.end()
            out.append(piece[at:])
        pieces = [p for p in out if p]
    return pieces


@pytest.mark.parametrize("scheme", list(schemes.PATTERNS))
def test_columns_equal_the_published_pattern_and_partition_the_text(spark, scheme):
    rng = random.Random(scheme)
    texts = CASES + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", "text", schemes.pretokens(F.col("text"), scheme).alias("p")).collect()
    for r in rows:
        assert r["p"] == expected(r["text"], scheme), repr(r["text"])
        assert "".join(r["p"]) == r["text"]


def test_null_and_long_runs(spark):
    rows = spark.createDataFrame([(None,), ("a" * 1_000_000,), (" " * 300_000,)], "text string")
    for scheme in schemes.PATTERNS:
        got = rows.select(F.size(schemes.pretokens(F.col("text"), scheme)).alias("n")).collect()
        assert got[0]["n"] in (None, -1) and got[1]["n"] == 1 and got[2]["n"] == 1


def test_names_and_spellings():
    assert schemes.by_name("cl100k") == "gpt4" and schemes.by_name("r50k") == "gpt2"
    assert schemes.by_patterns(next(iter(schemes.OTHER_SPELLINGS))) == "gpt4"
    for name, patterns in schemes.PATTERNS.items():
        assert schemes.by_patterns(patterns) == name
    with pytest.raises(ValueError):
        schemes.by_name("nope")
    with pytest.raises(ValueError):
        schemes.by_patterns(("x+",))


#: Letters, digits, marks, signs, spaces and line ends of several planes, case pairs beyond ASCII, and a lone surrogate.
MIXED = "aZ's'ſLL7٣ \t\n\r\x85 　_-./éßİıǅʰ́中あアΩЖक्\ud800😀𝒜𐒀"


@given(st.text(st.sampled_from(MIXED), max_size=40), st.sampled_from(sorted(schemes.PATTERNS)))
@settings(max_examples=600, deadline=None)
def test_written_out_classes_give_the_published_pieces(text, scheme):
    assert Pieces(scheme)(text) == expected(text, scheme)


@pytest.mark.parametrize("scheme", sorted(schemes.PATTERNS))
def test_written_out_classes_hold_each_character_of_the_plane(scheme):
    pieces = Pieces(scheme)
    for pattern, plain in zip(pieces.whole, pieces.plane, strict=True):
        text = "".join(f"'{c}a{c}{c}7{c}\n{c} " for c in map(chr, range(0x10000)))
        assert plain.findall(text) == pattern.findall(text)


def test_memo_forgets_by_bytes_and_keeps_what_comes_back():
    made = []

    def make(word):
        made.append(word)
        return [len(word)]

    memo = Memo(make, {"given": code([9])}, most=4000)
    for k in range(200):
        assert memo[f"rare{k}"] == code([len(f"rare{k}")])
        assert memo["often"] == code([5]) and memo["given"] == code([9])
        assert len(memo) + len(memo.old) < 60
    assert made.count("often") == 1 and "given" not in made
    assert memo.new(["often", "given", "never"]) == ["never"]
    long = "x" * 1000
    assert memo[long] == code([1000]) and long not in memo
