"""Registered queries of the tokenization operators, and the DuckDB SQL that says the same."""

from __future__ import annotations

import base64
import functools
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize, schemes
from .operators import charsmap, compare, counts, encode, fragments, literals, scan, shape
from .operators import train as training
from .plans.loaders import byte_alphabet, load
from .plans.model import AddedToken, Metaspace, TokenizerModel
from .shared import folder
from .shipping import ship
from .sources import files, packed

Query = Callable[[SparkSession, str], DataFrame]

#: Between documents of a file.
END = "<|endoftext|>"
SEPARATOR, PAD, PREFIX, SUFFIX, MAX_LENGTH = ". ", 0, (1, 2), (3,), 64
FORBIDDEN = ["example.com", "token =", "qqqq", "\n"]
LITERALS = ["the", "then", "<m>", "."]
#: What the small model of these queries is trained on, so that its merges are a matter of rule.
SAMPLE = "the cat and the dog sat on the other mat, then the rain in the plain went on and on; der hund und die katze, le chien et les chats, el perro y los gatos. "
SMALL_SIZE = 256 + 1 + 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(table(spark, sf_dir, "documents"))


@functools.cache
def small_model() -> TokenizerModel:
    """A byte-level model of 60 merges."""
    words = Counter(regex.findall(schemes.PATTERNS["gpt2"][0], SAMPLE))
    return training.train([(w.encode(), n) for w, n in words.items()], SMALL_SIZE, ("<|endoftext|>",)).model()


@functools.cache
def piece_model() -> TokenizerModel:
    """A SentencePiece-style model: special tokens, bytes, letters, and a few merges."""
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", *"abcdefghijklmnopqrstuvwxyz"]
    pairs = [("t", "h"), ("th", "e"), ("▁", "the"), ("e", "r"), ("i", "n"), ("a", "n"), ("o", "n"), ("▁", "d"), ("d", "e"), ("e", "n")]
    pieces += [a + b for a, b in pairs]
    ids = {p: i for i, p in enumerate(pieces)}
    vocab = tuple(bytes([i - 3]) if 3 <= i < 259 else p.encode() for i, p in enumerate(pieces))
    merges = tuple((ids[a], ids[b], ids[a + b]) for a, b in pairs)
    return TokenizerModel("piece", vocab, merges, (AddedToken("</s>", 2, special=True),), metaspace=Metaspace(), extra={"pieces": ids})


def _shown(ids: Column) -> Column:
    """Ids as text: bytes as <hex>, merged tokens as <m id>."""
    return F.array_join(F.transform(ids, lambda i: F.when(i < 256, F.concat(F.lit("<"), F.lower(F.lpad(F.hex(i.cast("long")), 2, "0")), F.lit(">"))).otherwise(F.concat(F.lit("<m"), i.cast("string"), F.lit(">")))), "")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- pretokenizers

_WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS_LINE = _WS.replace(r"\n", "").replace(r"\r", "")


#: A class that leaves another one out, which RE2 doesn't know.
_INTERSECTION = regex.compile(r"\[[^\[\]]*&&\[\^[^\[\]]*\]\]")


def _written_out(found: str) -> str:
    """Such a class as ranges of code points."""
    runs = [m.span() for m in regex.finditer(f"{found}+", "".join(map(chr, range(0x110000))), regex.V1)]
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b - 1:X}}}" for a, b in runs) + "]"


def _re2(scheme: str) -> tuple[str, str]:
    """A scheme without lookahead and possessives: a mark goes where the lookahead would stop a run of white space.

    Returns the class of the white space after which the mark goes, and the pattern.
    """
    pattern = _INTERSECTION.sub(lambda m: _written_out(m[0]), schemes.PATTERNS[scheme][-1])
    pattern = pattern.replace("++", "+").replace("*+", "*").replace("?+", "?").replace("{1,3}+", "{1,3}").replace(r"|\s+(?!\S)", "")
    pattern = pattern.replace(r"[^\s\p{L}", rf"[^{_WS}\x{{E000}}\p{{L}}").replace(r"[^\r\n\p{L}\p{N}]", r"[^\r\n\x{E000}\p{L}\p{N}]").replace(r"\s", f"[{_WS}]")
    return (_WS if scheme == "gpt2" else _WS_LINE), pattern


def _pieces_sql(scheme: str, text: str = "text") -> str:
    before, pattern = _re2(scheme)
    return f"regexp_extract_all(regexp_replace({text}, '([{before}])([^{_WS}])', chr(57344) || '\\1\\2', 'g'), {_quoted(pattern)})"


def _deepseek_sql() -> str:
    """The three splits one after another: marks go around what a pattern finds, and marks part the text."""
    first, second, _ = schemes.PATTERNS["deepseek_v3"]
    before, third = _re2("deepseek_v3")
    stopped = f"regexp_replace(x, '([{before}])([^{_WS}])', chr(57344) || '\\1\\2', 'g')"

    def parted(parts: str, text: str, pattern: str) -> str:
        marked = f"regexp_replace({text}, {_quoted(f'({pattern})')}, chr(57345) || '\\1' || chr(57345), 'g')"
        return f"flatten(list_transform({parts}, lambda x: list_filter(list_transform(string_split({marked}, chr(57345)), lambda y: replace(y, chr(57344), '')), lambda y: y <> '')))"

    return parted(parted(parted("[text]", "x", first), "x", second), stopped, third)


def _pretok(scheme: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return counts.pretoken_counts(docs(spark, sf_dir), scheme=scheme)

    query.__doc__ = f"How often each piece of {scheme} occurs in the documents."
    return query


def _pretok_sql(scheme: str) -> str:
    pieces = _deepseek_sql() if scheme == "deepseek_v3" else _pieces_sql(scheme)
    return f"SELECT pretoken, count(*)::BIGINT AS cnt FROM (SELECT unnest({pieces}) AS pretoken FROM documents) GROUP BY pretoken"


def pretoken_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent pieces."""
    return counts.pretoken_counts(docs(spark, sf_dir)).orderBy(F.desc("cnt"), "pretoken").limit(100)


def tokens_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pieces and bytes by language."""
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(schemes.pretokens(F.col("text")))).alias("pretokens"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def conversation_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and pieces of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.size(schemes.pretokens(F.col("text")))).alias("pretokens"))


def pretok_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document in order."""
    return counts.pretoken_rows(docs(spark, sf_dir), "doc_id")


# ---------------------------------------------------------------- byte-pair encoding


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pretoken_counts(docs(spark, sf_dir))


def bpe_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each distinct piece."""
    return encode.encode_distinct(_words(spark, sf_dir), small_model()).select("pretoken", _shown(F.col("ids")).alias("ids"))


def bpe_encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of each document."""
    return encode.encode(docs(spark, sf_dir).select("doc_id", "text"), small_model()).select("doc_id", F.size("ids").cast("long").alias("tokens"))


def bpe_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by language."""
    return encode.token_totals(encode.count_tokens(docs(spark, sf_dir).select("lang", "text"), small_model()), "tokens", "lang")


def bpe_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents after encoding and decoding through the vocabulary table, as digests."""
    ids = encode.encode(docs(spark, sf_dir).select("doc_id", "text"), small_model()).drop("text")
    return encode.decode_join(ids, small_model().vocab_table(spark), "doc_id").select("doc_id", F.md5("text").alias("md5"))


def bpe_decode_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in an Arrow function."""
    ids = encode.encode(docs(spark, sf_dir).select("doc_id", "text"), small_model()).drop("text")
    return encode.decode_text(ids, small_model()).select("doc_id", F.md5("text").alias("md5"))


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of neighbouring symbols of the pieces under the small model."""
    words = encode.encode(_words(spark, sf_dir), small_model(), "pretoken", "symbols", added=False)
    return counts.pair_counts(words).select(F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.col("cnt").cast("long").alias("cnt"))


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cnt): how many tokens of the documents have each id that occurs, counted by way of distinct pieces."""
    words = encode.encode(_words(spark, sf_dir), small_model(), "pretoken", added=False)
    return words.select(F.explode("ids").alias("id"), "cnt").groupBy("id").agg(F.sum("cnt").alias("cnt"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary table of the small model, and how many tokens of the documents have each id."""
    known = small_model().vocab_table(spark).join(_used(spark, sf_dir), "id", "left")
    return known.select("id", F.lower(F.hex("bytes")).alias("bytes"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges table of the small model, and how many tokens of the documents each merge made that no other took in."""
    known = small_model().merges_table(spark).join(_used(spark, sf_dir).withColumnRenamed("id", "merged"), "merged", "left")
    return known.select("rank", "left", "right", "merged", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest id and one, how many ids the documents use, and the highest of these."""
    known = small_model().vocab_table(spark).join(_used(spark, sf_dir), "id", "left")
    return known.agg((F.max("id") + 1).cast("long").alias("vocab_size"), F.count("cnt").alias("used"), F.max(F.when(F.col("cnt").isNotNull(), F.col("id"))).cast("long").alias("highest"))


def train_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First merges learned from the documents; ties by the order in which byte-level vocabularies write bytes."""
    return _learned(spark, training.train_bpe(docs(spark, sf_dir), 256 + TRAINED))


def train_bpe_raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First merges learned from the benchmark items; ties by ids."""
    return _learned(spark, training.train_bpe(table(spark, sf_dir, "benchmark"), 256 + TRAINED, tie_breaking="raw_token_ids"))


def train_bpe_assembled_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First merges learned from the benchmark items; ties by the bytes of both tokens."""
    return _learned(spark, training.train_bpe(table(spark, sf_dir, "benchmark"), 256 + TRAINED, tie_breaking="assembled_bytes"))


def _rounds(source: str, tie: str, text: str = "text") -> Query:
    """Merges learned from a table whose words stay distributed."""
    return lambda spark, sf_dir: _learned(spark, training.train_bpe(table(spark, sf_dir, source), 256 + TRAINED, tie_breaking=tie, text=text, most_words=0))


#: Merges of the training queries.
TRAINED = 20


def _learned(spark: SparkSession, got: training.Trained) -> DataFrame:
    rows = [(rank, a, b, got.vocab[c].hex()) for rank, (a, b, c) in enumerate(got.merges)]
    return spark.createDataFrame(rows, "rank int, left int, right int, token string")


def byte_order() -> list[int]:
    """Place of each byte among the characters by which byte-level vocabularies write them."""
    characters = {b: c for c, b in byte_alphabet().items()}
    order = sorted(range(256), key=characters.__getitem__)
    return [order.index(b) for b in range(256)]


def _train_sql(source: str, order: str) -> str:
    """Training as a recursion over distinct words: symbols are <id> of three digits, then the token's bytes are put together.

    ``order`` puts the ids and bytes of a pair's symbols (l, r, lb, rb) in the order of ties.
    """
    return f"""
WITH RECURSIVE w AS (SELECT p, count(*) AS n FROM (SELECT unnest({_pieces_sql("gpt2")}) AS p FROM {source}) GROUP BY p),
b AS (SELECT n, array_to_string(list_transform(regexp_extract_all(hex(encode(p)), '..'), lambda x: '<' || lpad(('0x' || x)::INT::VARCHAR, 3, '0') || '>'), '') AS s FROM w),
v0 AS (SELECT map(list_transform(range(256), lambda i: '<' || lpad(i::VARCHAR, 3, '0') || '>'), list_transform(range(256), lambda i: lpad(hex(i), 2, '0'))) AS v),
r(k, words, v, pair) AS (
  SELECT 0, (SELECT list({{'n': n, 's': s}}) FROM b), v, NULL::VARCHAR FROM v0
  UNION ALL
  SELECT k + 1, list_transform(words, lambda x: {{'n': x.n, 's': replace(x.s, best, '<' || (256 + k) || '>')}}), map_concat(v, MAP {{'<' || (256 + k) || '>': v[best[1:5]] || v[best[6:10]]}}), best
  FROM (SELECT k, words, v, (
      SELECT q FROM (
        SELECT q, sum(n) AS n, any_value(q[2:4]::INT) AS l, any_value(q[7:9]::INT) AS r, any_value(v[q[1:5]]) AS lb, any_value(v[q[6:10]]) AS rb FROM (
          SELECT x.n AS n, unnest(list_transform(range(1, length(x.s) // 5), lambda i: x.s[5 * i - 4:5 * i + 5])) AS q FROM (SELECT unnest(words) AS x)
        ) GROUP BY q) ORDER BY n DESC, {order} LIMIT 1) AS best FROM r WHERE k < {TRAINED}))
SELECT (k - 1)::INTEGER AS rank, pair[2:4]::INTEGER AS left, pair[7:9]::INTEGER AS right, lower(v['<' || (255 + k) || '>']) AS token FROM r WHERE k > 0
"""


def _named(ids: Column) -> Column:
    """Ids of the piece model as text: bytes as <HH>, others as <id>."""
    return F.array_join(F.transform(ids, lambda i: F.when((i >= 3) & (i < 259), F.concat(F.lit("<"), F.lpad(F.hex((i - 3).cast("long")), 2, "0"), F.lit(">"))).otherwise(F.concat(F.lit("<"), i.cast("string"), F.lit(">")))), "")


def sp_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the piece model, and a digest of all of them."""
    return encode.encode(docs(spark, sf_dir).select("doc_id", "text"), piece_model()).select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5(_named(F.col("ids"))).alias("md5"))


#: Characters of a fragment in the queries of long texts, so that most documents are cut.
FRAGMENT = 400


def sp_encode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sp_encode``, with documents cut at marks and merged in parts by many tasks."""
    coded = fragments.encode_long(docs(spark, sf_dir).select("doc_id", "text"), piece_model(), "doc_id", target=FRAGMENT)
    return coded.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5(_named(F.col("ids"))).alias("md5"))


def bpe_encode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of each document, and a digest of their bytes, with documents cut where no token crosses."""
    coded = fragments.encode_long(docs(spark, sf_dir).select("doc_id", "text"), small_model(), "doc_id", target=FRAGMENT)
    return encode.decode_text(coded.drop("text"), small_model()).select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5("text").alias("md5"))


def sp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents after encoding and decoding under the piece model, as digests."""
    ids = encode.encode(docs(spark, sf_dir).select("doc_id", "text"), piece_model()).drop("text")
    return encode.decode_text(ids, piece_model()).select("doc_id", F.md5("text").alias("md5"))


def _sp_sql() -> str:
    """Letters and the mark are symbols, all else is bytes; each merge is a replacement, in the order of ranks."""
    model = piece_model()
    pairs = ", ".join(f"({rank}, '<{a}><{b}>', '<{c}>')" for rank, (a, b, c) in enumerate(model.merges))
    symbol = "CASE WHEN c = '▁' THEN '<259>' WHEN c BETWEEN 'a' AND 'z' THEN '<' || (260 + ascii(c) - 97) || '>' ELSE regexp_replace(hex(encode(c)), '(..)', '<\\1>', 'g') END"
    return f"""
WITH RECURSIVE m(rank, pair, merged) AS (VALUES {pairs}),
t AS (SELECT doc_id, replace(text, ' ', '▁') AS t FROM documents),
p AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '▁?[^▁]+|▁'), lambda w, i: {{'i': i, 'w': w}})) AS p FROM (SELECT doc_id, CASE WHEN t = '' OR starts_with(t, '▁') THEN t ELSE '▁' || t END AS t FROM t)),
b AS (SELECT DISTINCT p.w AS w FROM p),
r AS (SELECT w, array_to_string(list_transform(regexp_extract_all(w, '(?s).'), lambda c: {symbol}), '') AS s, 0 AS k FROM b UNION ALL SELECT w, replace(s, pair, merged), k + 1 FROM r JOIN m ON m.rank = r.k),
e AS (SELECT doc_id, string_agg(s, '' ORDER BY p.i) AS s FROM p JOIN r ON r.w = p.w AND r.k = {len(model.merges)} GROUP BY doc_id)
SELECT d.doc_id, (length(coalesce(s, '')) - length(replace(coalesce(s, ''), '<', '')))::BIGINT AS tokens, md5(coalesce(s, '')) AS md5 FROM documents d LEFT JOIN e USING (doc_id)
"""


#: Letters of the documents that become a, b and c, and words that become added tokens, so that the rules of merging show.
LETTERS, TO_LETTERS, WORDS = "the", "abc", {" and ": " <m> ", " of ": " <r> "}
#: For each small model the merges that it comes down to, in order, and the pieces that are tokens whole.
CASES: dict[str, tuple[tuple[str, ...], dict[str, int]]] = {
    "rank order is list order": (("bc", "ab"), {}),
    "rank order is id order": (("ab", "bc"), {}),
    "whole words first": (("bc", "ab"), {"abc": 400, "ab": 300, "bc": 350}),
    "no whole words": (("bc", "ab"), {}),
}


def _known_models() -> dict[str, TokenizerModel]:
    def model(words: dict[bytes, int], merges: tuple[tuple[int, int, int], ...] = (), **more) -> TokenizerModel:
        vocab = [bytes([b]) for b in range(256)] + [b""] * (max(words.values(), default=255) - 255)
        for w, i in words.items():
            vocab[i] = w
        return TokenizerModel("byte", tuple(vocab), merges, **more)

    ab, bc = (97, 98, 300), (98, 99, 350)
    listed = {b"ab": 300, b"bc": 350}
    return {
        "rank order is list order": model(listed, (bc, ab)),
        "rank order is id order": model(listed, (ab, bc)),
        "whole words first": model(listed | {b"abc": 400}, (bc, ab), ignore_merges=True),
        "no whole words": model(listed | {b"abc": 400}, (bc, ab)),
        "added tokens": model({}, added=(AddedToken("<m>", 400, lstrip=True), AddedToken("<r>", 401, rstrip=True))),
    }


def bpe_known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents' pieces, with some letters exchanged, under models that differ in the order of merges and in whole words."""
    lettered = docs(spark, sf_dir).select(F.translate("text", LETTERS, TO_LETTERS).alias("text"))
    words, out = counts.pretoken_counts(lettered).select("pretoken"), None
    for case, model in _known_models().items():
        if case in CASES:
            found = encode.encode(words, model, "pretoken", added=False).select(F.lit(case).alias("case"), "pretoken", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))
            out = found if out is None else out.union(found)
    return out


def bpe_added_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with added tokens in the place of words, of which one takes in the white space before it and one that after it: digests of the ids."""
    text = functools.reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), WORDS.items(), F.col("text"))
    ids = encode.encode(docs(spark, sf_dir).select("doc_id", text.alias("text")), _known_models()["added tokens"])
    return ids.select("doc_id", F.size("ids").cast("long").alias("tokens"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")).alias("md5"))


def _known_sql() -> str:
    """Bytes are <id>; each merge is a replacement, in the order of ranks, unless the piece is a token whole."""
    ids = {"a": "<97>", "b": "<98>", "c": "<99>", "ab": "<300>", "bc": "<350>"}
    rows = []
    for case, (merged, whole) in CASES.items():
        text = functools.reduce(lambda t, m: f"replace({t}, '{ids[m[0]]}{ids[m[1]]}', '{ids[m]}')", merged, "s")
        own = " ".join(f"WHEN {_quoted(w)} THEN '<{i}>'" for w, i in whole.items())
        rows.append(f"SELECT {_quoted(case)} AS \"case\", pretoken, {f'CASE pretoken {own} ELSE {text} END' if own else text} AS s FROM b")
    return f"""
WITH t AS (SELECT translate(text, {_quoted(LETTERS)}, {_quoted(TO_LETTERS)}) AS text FROM documents),
p AS (SELECT DISTINCT unnest({_pieces_sql("gpt2")}) AS pretoken FROM t),
b AS (SELECT pretoken, array_to_string(list_transform(regexp_extract_all(hex(encode(pretoken)), '..'), lambda x: '<' || ('0x' || x)::INT || '>'), '') AS s FROM p),
c AS ({" UNION ALL ".join(rows)})
SELECT "case", pretoken, replace(s[2:-2], '><', ' ') AS ids FROM c
"""


def _overwrite_sql() -> str:
    """White space before <m> and after <r> goes; both become characters of one, all else is bytes."""
    text = functools.reduce(lambda t, e: f"replace({t}, {_quoted(e[0])}, {_quoted(e[1])})", WORDS.items(), "text")
    marked = rf"regexp_replace(regexp_replace({text}, '[{_WS}]*<m>', chr(57345), 'g'), '<r>[{_WS}]*', chr(57346), 'g')"
    one = "CASE x WHEN chr(57345) THEN ['400'] WHEN chr(57346) THEN ['401'] ELSE list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda y: ('0x' || y)::INT::VARCHAR) END"
    return f"WITH i AS (SELECT doc_id, flatten(list_transform(regexp_extract_all({marked}, '(?s).'), lambda x: {one})) AS i FROM documents) SELECT doc_id, len(i)::BIGINT AS tokens, md5(array_to_string(i, ' ')) AS md5 FROM i"


def _merge_values() -> str:
    def name(i: int) -> str:
        return f"<{i:02x}>" if i < 256 else f"<m{i}>"

    return ", ".join(f"({rank}, '{name(a)}{name(b)}', '{name(c)}')" for rank, (a, b, c) in enumerate(small_model().merges))


def _encoded_sql(words: str) -> str:
    """CTEs up to enc(pretoken, ids): each merge is a replacement, in the order of ranks."""
    n = len(small_model().merges)
    return f"""m(rank, pair, merged) AS (VALUES {_merge_values()}),
w AS ({words}),
b AS (SELECT DISTINCT pretoken, regexp_replace(lower(hex(encode(pretoken))), '(..)', '<\\1>', 'g') AS s FROM w),
r AS (SELECT pretoken, s, 0 AS k FROM b UNION ALL SELECT pretoken, replace(s, pair, merged), k + 1 FROM r JOIN m ON m.rank = r.k),
enc AS (SELECT pretoken, s AS ids FROM r WHERE k = {n})"""


def _tokens(ids: str) -> str:
    return f"(length({ids}) - length(replace({ids}, '<', '')))"


# ---------------------------------------------------------------- shapes


def _sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): lengths of each document's pieces, a stand-in for ids that SQL can make too."""
    return docs(spark, sf_dir).select("doc_id", F.transform(schemes.pretokens(F.col("text")), lambda x: F.char_length(x)).alias("ids"))


_IDS_SQL = f"SELECT doc_id, list_transform({_pieces_sql('gpt2')}, lambda x: length(x)) AS ids FROM documents"


def _joined(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: x.cast("string")), " ")


def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows padded and cut to one width, with lengths and masks."""
    rule = shape.Padding(PAD, MAX_LENGTH, True, True, prefix=PREFIX, suffix=SUFFIX)
    return shape.pad(_sample_ids(spark, sf_dir), rule).select("doc_id", _joined("ids").alias("ids"), "length", F.aggregate("mask", F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


def pad_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the last ids kept and the padding before them."""
    rule = shape.Padding(PAD, MAX_LENGTH, True, True, True, True, PREFIX, SUFFIX)
    return shape.pad(_sample_ids(spark, sf_dir), rule).select("doc_id", _joined("ids").alias("ids"), "length")


def wrap_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 32 ids between prefix and suffix."""
    return _sample_ids(spark, sf_dir).select("doc_id", _joined(shape.wrap(F.col("ids"), PREFIX, SUFFIX, 32)).alias("ids"))


def packed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids begin in one buffer."""
    return shape.packed_offsets(_sample_ids(spark, sf_dir), "doc_id")


def _ints(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


_ROOM = MAX_LENGTH - len(PREFIX) - len(SUFFIX)
_ZEROS = f"list_transform(range({MAX_LENGTH} - len(ids)), lambda x: {PAD})"


def _padded_sql(cut: str, order: str, more: str = "") -> str:
    rows = f"SELECT doc_id, {_ints(PREFIX)} || {cut} || {_ints(SUFFIX)} AS ids FROM i"
    return f"WITH i AS ({_IDS_SQL}), w AS ({rows}) SELECT doc_id, array_to_string({order}, ' ') AS ids, len(ids)::BIGINT AS length{more} FROM w"


PAD_SQL = _padded_sql(f"ids[1:{_ROOM}]", f"ids || {_ZEROS}", ", len(ids)::BIGINT AS ones")
PAD_LEFT_SQL = _padded_sql(f"ids[greatest(len(ids) - {_ROOM - 1}, 1):len(ids)]", f"{_ZEROS} || ids")
WRAP_SQL = f"WITH i AS ({_IDS_SQL}) SELECT doc_id, array_to_string({_ints(PREFIX)} || ids[1:32] || {_ints(SUFFIX)}, ' ') AS ids FROM i"
PACKED_SQL = f"WITH i AS ({_IDS_SQL}) SELECT doc_id, len(ids)::BIGINT AS length, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM i"


# ---------------------------------------------------------------- texts


def limit_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of 100 kB in all."""
    cut = scan.limit_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), scan.parse_size("100KB"))
    return cut.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"))


LIMIT_SQL = """
WITH s AS (SELECT doc_id, encode(text) AS b, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM documents)
SELECT doc_id, least(octet_length(b), 100000 - done)::BIGINT AS bytes, sha256(unhex(substring(hex(b), 1, (2 * least(octet_length(b), 100000 - done))::BIGINT))) AS sha FROM s WHERE done < 100000 OR done = 100000 AND octet_length(b) = 0
"""


def doc_split_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each document between separators, empty ones left out."""
    parts = scan.split_docs(F.col("text"), SEPARATOR)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("parts"), F.array_join(F.transform(parts, lambda x: F.char_length(x).cast("string")), " ").alias("lengths"))


def forbid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any document holds each forbidden substring."""
    return scan.forbidden(table(spark, sf_dir, "documents"), FORBIDDEN)


def substr_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the substrings each document holds."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(scan.present(F.col("text"), FORBIDDEN), lambda x: x.cast("string")), ",").alias("patterns"))


def pretok_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents and literals in them, with their places in bytes."""
    return counts.pretoken_spans(docs(spark, sf_dir), "doc_id", added=tuple(LITERALS))


def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document whose ids differ once a literal is replaced in all texts, found by fingerprints of ranges.

    Runs a job when it is called.
    """
    whole = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text")
    found = compare.first_difference(whole, whole.withColumn("text", F.replace("text", F.lit(FORBIDDEN[0]), F.lit("-"))), lambda df: encode.encode(df, small_model()), keys=64)
    texts = encode.decode_text(encode.decode_text(found, small_model(), "left_ids", "a"), small_model(), "right_ids", "b")
    return texts.select("n", F.md5("a").alias("left_md5"), F.md5("b").alias("right_md5"))


#: A small character map: letters, signs of two bytes, white space, and what becomes nothing.
MAPPED = {"T": "t", "é": "e", "ß": "ss", "ü": "ue", "\n": " ", ",": "", "x": "×"}


def sp_precompiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the documents under a character map."""
    mapped = charsmap.precompiled(docs(spark, sf_dir).select("doc_id", "text"), charsmap.build(MAPPED))
    return mapped.select("doc_id", F.md5("text").alias("md5"))


def added_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the documents between and at literals."""
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(scan.split_added(F.col("text"), LITERALS), "|")).alias("md5"))


#: Bytes of all words that the driver takes as literals.
MOST_LITERAL_BYTES = 16 << 20


def _benchmark_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The distinct words of the benchmark items; more than MOST_LITERAL_BYTES are refused."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("word")).where("word <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > MOST_LITERAL_BYTES:
        raise ValueError(f"{size} bytes of literals")
    return sorted(r["word"] for r in words.collect())


def literal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each word of the benchmark items, anywhere; all words in one pass."""
    words = _benchmark_words(spark, sf_dir)
    names = spark.createDataFrame(list(enumerate(words)), "pattern int, word string")
    return literals.literal_counts(table(spark, sf_dir, "documents"), words).join(names, "pattern").select("word", "docs")


def literal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at the words of the benchmark items, leftmost and longest first: number and digest of the parts."""
    parts = literals.literal_parts(table(spark, sf_dir, "documents").select("doc_id", "text"), _benchmark_words(spark, sf_dir))
    return parts.select("doc_id", F.size("parts").cast("long").alias("parts"), F.md5(F.array_join("parts", "|")).alias("md5"))


def _normalizer(step: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", step(F.concat(F.lit("  "), F.col("text"), F.lit(" \t"))).alias("text"))


_SPACED = "'  ' || text || ' ' || chr(9)"


def _normalizer_sql(expression: str) -> str:
    return f"WITH t AS (SELECT conv_id, turn, {_SPACED} AS t FROM conversations) SELECT conv_id, turn, {expression} AS text FROM t"


def jsonl_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A string field of JSON objects, one for each turn of the conversations."""
    lines = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    return files.json_field(lines, "value", "text").groupBy("text").agg(F.count("*").alias("cnt"))


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as a Parquet source: how many, and how many bytes."""
    return files.ParquetSource(f"{sf_dir}/documents.parquet", "text").read(spark, ordered=False).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in buffers in memory, one for each remainder of their ids, parted by a separator; more than MOST_LITERAL_BYTES are refused."""
    items = table(spark, sf_dir, "benchmark")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_LITERAL_BYTES:
        raise ValueError(f"{size} bytes of buffers")
    buffers = items.groupBy(F.col("item_id") % 7).agg(F.array_join(F.collect_list("text"), END).alias("buffer"))
    return _counted(files.BytesSource([r["buffer"] for r in buffers.collect()], END).read(spark))


def packed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written as packed ids and read again: their places in the order of ids, and digests of the decoded texts.

    Writes when it is called.
    """
    path = folder(spark, "-packed")
    packed.write_packed(encode.encode(docs(spark, sf_dir).select("doc_id", "text"), small_model()), path)
    found = packed.read_packed(spark, path).withColumnRenamed("key", "doc_id")
    return encode.decode_text(found, small_model()).select("doc_id", "place", F.md5("text").alias("md5"))


def _counted(texts: DataFrame) -> DataFrame:
    return texts.groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("cnt"))


def scan_text_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as plain text with a separator, and read again."""
    path = folder(spark, "")
    table(spark, sf_dir, "documents").select("text").write.option("lineSep", END).text(path)
    return _counted(files.TextSource(path, END).read(spark, ordered=False))


def _write_frames(spark: SparkSession, texts: DataFrame, ending: str) -> list[str]:
    """Texts of a table as Zstandard files of many small frames, one file for each task; their paths."""
    ship(spark)
    path = folder(spark, "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, name = fs.FileSystem.from_uri(path)
        folder.create_dir(name)
        number = TaskContext.get().partitionId()
        with folder.open_output_stream(f"{name}/{number:05d}{ending}", compression=None) as file:
            for batch in batches:
                whole = "".join(t + END for t in batch.column("text").to_pylist()).encode()
                for at in range(0, len(whole), FRAME_BYTES):
                    file.write(zstandard.ZstdCompressor().compress(whole[at : at + FRAME_BYTES]))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{number:05d}{ending}"])], names=["path"])

    return sorted(r["path"] for r in texts.select("text").mapInArrow(work, "path string").collect())


#: Unpacked bytes of a frame of the query's files; most documents go over several.
FRAME_BYTES = 50_000


def scan_text_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Zstandard files of many frames, which cut documents, and read frame by frame."""
    return _counted(files.TextSource(_write_frames(spark, docs(spark, sf_dir), ".txt.zst"), END).read(spark, ordered=False))


def scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents in folders of which each holds twice as many as the one after it, as their paths are listed; written when called."""
    path = folder(spark, "")
    rows = table(spark, sf_dir, "documents").where("text <> ''").select(F.floor(F.log2(F.col("doc_id") + F.lit(1))).cast("int").alias("folder"), "doc_id", "text")
    rows.repartitionByRange("folder", "doc_id").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder").option("lineSep", END).text(path)
    most = rows.agg(F.max("folder")).first()[0]
    return files.TextSource([f"{path}/folder={k}" for k in reversed(range(most + 1))], END).read(spark).select("doc_id", F.md5("text").alias("md5"))


def scan_text_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, compressed."""
    path = folder(spark, "")
    table(spark, sf_dir, "documents").select("text").write.option("lineSep", END).option("compression", "gzip").text(path)
    return _counted(files.TextSource(path, END).read(spark, ordered=False))


def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items written as one file, and read as one document."""
    path = folder(spark, "")
    table(spark, sf_dir, "benchmark").orderBy("item_id").coalesce(1).select("text").write.option("lineSep", END).text(path)
    return _counted(files.resolve(path).read(spark))


def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines, and read by the ending of the folder's name."""
    path = folder(spark, ".jsonl")
    docs(spark, sf_dir).select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    return _counted(files.resolve(path).read(spark, ordered=False))


def load_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens learned from the benchmark items written as a list by rank, and merges found again from that list; runs jobs when called."""
    tokens = training.train_bpe(table(spark, sf_dir, "benchmark"), 256 + TRAINED, tie_breaking="raw_token_ids").vocab
    with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as file:
        file.write("".join(f"{base64.b64encode(t).decode()} {rank}\n" for rank, t in enumerate(tokens)))
        file.flush()
        model = load(file.name)
    return model.merges_table(spark).join(model.vocab_table(spark).select(F.col("id").alias("merged"), F.lower(F.hex("bytes")).alias("token")), "merged").select("rank", "left", "right", "token")


_NORMALIZERS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "add_prefix_space": (normalize.add_prefix_space, "CASE WHEN t <> '' AND NOT starts_with(t, ' ') THEN ' ' || t ELSE t END"),
    "sp_prepend": (normalize.prepend, "CASE WHEN t <> '' THEN '▁' || t ELSE t END"),
    "sp_replace": (normalize.replace, "replace(t, ' ', '▁')"),
    "sp_collapse": (normalize.collapse_spaces, "regexp_replace(t, ' {2,}', '▁', 'g')"),
    "sp_strip": (normalize.strip, rf"regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g')"),
    "sp_metaspace": (normalize.metaspace, "CASE WHEN t <> '' AND NOT starts_with(replace(t, ' ', '▁'), '▁') THEN '▁' || replace(t, ' ', '▁') ELSE replace(t, ' ', '▁') END"),
    "nfc": (normalize.nfc, "nfc_normalize(t)"),
}


def queries() -> dict[str, Query]:
    named = {f"pretok_{s}" if s != "gpt2" else "pretoken_counts_gpt2": _pretok(s) for s in schemes.PATTERNS}
    found = (
        tokens_per_lang, conversation_token_counts, pretok_rows, bpe_encode_words, bpe_encode_docs, bpe_token_totals, bpe_decode_roundtrip, bpe_decode_udf, pair_counts, vocab, merges, vocab_size,
        train_bpe, train_bpe_raw_ids, train_bpe_assembled_bytes, sp_encode, sp_decode, bpe_known_words, pad_truncate, pad_left, wrap_truncate, packed_offsets, limit_bytes, doc_split_sep, forbid_scan, substr_present, added_token_split, literal_counts, literal_split, jsonl_field_extract, scan_parquet, scan_bytes, scan_text, scan_text_sep, scan_text_gz, scan_text_zst, scan_order, scan_jsonl, load_tiktoken, bpe_added_overwrite, sp_encode_long, bpe_encode_long, packed_sink, pretok_spans, first_difference, sp_precompiled,
    )
    named |= {"train_rounds": _rounds("documents", "huggingface"), "train_rounds_raw_ids": _rounds("pages", "raw_token_ids", "html"), "train_rounds_bytes": _rounds("conversations", "assembled_bytes")}
    return named | {"pretoken_topk_gpt2": pretoken_topk} | {f.__name__: f for f in found} | {k: _normalizer(step) for k, (step, _) in _NORMALIZERS.items()}


def oracle_sql() -> dict[str, str]:
    gpt2, model = _pieces_sql("gpt2"), small_model()
    words = f"SELECT unnest({gpt2}) AS pretoken FROM documents"
    by_doc = f"SELECT doc_id, lang, unnest({gpt2}) AS pretoken FROM documents"
    names = ", ".join(f"({i}, '{b.hex()}')" for i, b in model.vocab_dict().items())
    used = f"WITH RECURSIVE {_encoded_sql(words)}, t AS (SELECT pretoken, unnest(regexp_extract_all(ids, '<m?[0-9a-f]+>')) AS t FROM enc), u AS (SELECT CASE WHEN t[2] = 'm' THEN t[3:-2]::INT ELSE ('0x' || t[2:-2])::INT END AS id, count(*) AS cnt FROM w JOIN t USING (pretoken) GROUP BY 1)"
    flags = " UNION ALL ".join(f"SELECT {i} AS pattern, coalesce(bool_or(contains(text, {_quoted(p)})), false) AS found FROM documents" for i, p in enumerate(FORBIDDEN))
    words_sql = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\r\f\x{0B}]+')) AS word FROM benchmark)"
    held = ", ".join(f"CASE WHEN contains(text, {_quoted(p)}) THEN '{i}' END" for i, p in enumerate(FORBIDDEN))
    by_character = ", ".join(f"CASE WHEN {x} < 256 THEN {_ints(byte_order())}[{x} + 1] ELSE {x} END" for x in "lr")
    quoted = ", ".join(map(_quoted, LITERALS))
    literal = "|".join(["<m>", "then", "the", r"\."])
    out = {f"pretok_{s}" if s != "gpt2" else "pretoken_counts_gpt2": _pretok_sql(s) for s in schemes.PATTERNS}
    out |= {
        "pretoken_topk_gpt2": f"SELECT pretoken, count(*)::BIGINT AS cnt FROM ({words}) GROUP BY pretoken ORDER BY cnt DESC, pretoken LIMIT 100",
        "tokens_per_lang": f"SELECT lang, count(*)::BIGINT AS docs, sum(len({gpt2}))::BIGINT AS pretokens, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang",
        "conversation_token_counts": f"SELECT conv_id, count(*)::BIGINT AS turns, sum(len({gpt2}))::BIGINT AS pretokens FROM conversations GROUP BY conv_id",
        "pretok_rows": f"SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, unnest(p) AS pretoken FROM (SELECT doc_id, {gpt2} AS p FROM documents)",
        "bpe_encode_words": f"WITH RECURSIVE {_encoded_sql(words)} SELECT pretoken, ids FROM enc",
        "bpe_encode_docs": f"WITH RECURSIVE {_encoded_sql(by_doc)} SELECT d.doc_id, coalesce(sum({_tokens('ids')}), 0)::BIGINT AS tokens FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN enc ON enc.pretoken = w.pretoken GROUP BY d.doc_id",
        "bpe_token_totals": f"WITH RECURSIVE {_encoded_sql(by_doc)} SELECT w.lang, count(DISTINCT w.doc_id)::BIGINT AS docs, sum({_tokens('ids')})::BIGINT AS tokens FROM w JOIN enc ON enc.pretoken = w.pretoken GROUP BY w.lang",
        "bpe_decode_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "bpe_decode_udf": "SELECT doc_id, md5(text) AS md5 FROM documents",
        "train_bpe": _train_sql("documents", by_character),
        "train_rounds": _train_sql("documents", by_character),
        "train_rounds_raw_ids": _train_sql("(SELECT html AS text FROM pages)", "l, r"),
        "train_rounds_bytes": _train_sql("conversations", "lb, rb"),
        "train_bpe_raw_ids": _train_sql("benchmark", "l, r"),
        "train_bpe_assembled_bytes": _train_sql("benchmark", "lb, rb"),
        "sp_encode": _sp_sql(),
        "sp_encode_long": _sp_sql(),
        "bpe_encode_long": f"WITH RECURSIVE {_encoded_sql(by_doc)}, n AS (SELECT w.doc_id, sum({_tokens('ids')}) AS n FROM w JOIN enc ON enc.pretoken = w.pretoken GROUP BY w.doc_id) SELECT d.doc_id, coalesce(n, 0)::BIGINT AS tokens, md5(d.text) AS md5 FROM documents d LEFT JOIN n USING (doc_id)",
        "sp_decode": "SELECT doc_id, md5(CASE WHEN starts_with(text, ' ') THEN substring(text, 2) ELSE text END) AS md5 FROM documents",
        "bpe_known_words": _known_sql(),
        "bpe_added_overwrite": _overwrite_sql(),
        "pair_counts": f"WITH RECURSIVE {_encoded_sql(words)}, n AS (SELECT pretoken, count(*) AS n FROM w GROUP BY pretoken), s AS (SELECT list_transform(regexp_extract_all(ids, '<(m?)([0-9a-f]+)>', 0), lambda x: CASE WHEN x[2] = 'm' THEN x[3:-2]::BIGINT ELSE ('0x' || x[2:-2])::BIGINT END) AS s, n FROM enc JOIN n USING (pretoken)) SELECT l AS left, r AS right, sum(n)::BIGINT AS cnt FROM (SELECT unnest(s[1:-2]) AS l, unnest(s[2:]) AS r, n FROM s WHERE len(s) > 1) GROUP BY l, r",
        "vocab": f"{used} SELECT id::INTEGER AS id, bytes, coalesce(cnt, 0)::BIGINT AS cnt FROM (VALUES {names}) v(id, bytes) LEFT JOIN u USING (id)",
        "merges": f"{used} SELECT rank::INTEGER AS rank, l::INTEGER AS left, r::INTEGER AS right, v.id::INTEGER AS merged, coalesce(cnt, 0)::BIGINT AS cnt FROM (VALUES {', '.join(f'({k}, {a}, {b}, {c})' for k, (a, b, c) in enumerate(model.merges))}) v(rank, l, r, id) LEFT JOIN u USING (id)",
        "vocab_size": f"{used} SELECT (SELECT max(id) + 1 FROM (VALUES {names}) v(id, bytes))::BIGINT AS vocab_size, count(*)::BIGINT AS used, max(id)::BIGINT AS highest FROM u",
        "pad_truncate": PAD_SQL, "pad_left": PAD_LEFT_SQL, "wrap_truncate": WRAP_SQL, "packed_offsets": PACKED_SQL, "limit_bytes": LIMIT_SQL,
        "doc_split_sep": f"WITH p AS (SELECT doc_id, list_filter(string_split(text, {_quoted(SEPARATOR)}), lambda x: x <> '') AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS parts, array_to_string(list_transform(p, lambda x: length(x)), ' ') AS lengths FROM p",
        "forbid_scan": flags,
        "substr_present": f"SELECT doc_id, concat_ws(',', {held}) AS patterns FROM documents",
        "added_token_split": f"SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '({literal})', chr(57345) || '\\1' || chr(57345), 'g'), chr(57345)), lambda x: x <> ''), '|')) AS md5 FROM documents",
        "literal_counts": f"WITH {words_sql} SELECT word, count(*)::BIGINT AS docs FROM w JOIN documents d ON contains(d.text, w.word) GROUP BY word",
        "literal_split": rf"""WITH {words_sql}, p AS (SELECT '(' || string_agg(regexp_replace(word, '([!-/:-@\[-`{{-~])', '\\\1', 'g'), '|' ORDER BY octet_length(encode(word)) DESC, word) || ')' AS p FROM w),
            s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, p, chr(57345) || '\1' || chr(57345), 'g'), chr(57345)), lambda x: x <> '') AS s FROM documents, p) SELECT doc_id, len(s)::BIGINT AS parts, md5(array_to_string(s, '|')) AS md5 FROM s""",
        "jsonl_field_extract": "SELECT text, count(*)::BIGINT AS cnt FROM conversations GROUP BY text",
        "scan_parquet": "SELECT count(*)::BIGINT AS docs, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents",
        "scan_text": f"SELECT md5(string_agg(text || {_quoted(END)}, '' ORDER BY item_id)) AS md5, 1::BIGINT AS cnt FROM benchmark",
        "scan_text_sep": "SELECT md5(text) AS md5, count(*)::BIGINT AS cnt FROM documents WHERE text <> '' GROUP BY ALL",
        "scan_text_gz": "SELECT md5(text) AS md5, count(*)::BIGINT AS cnt FROM documents WHERE text <> '' GROUP BY ALL",
        "scan_text_zst": "SELECT md5(text) AS md5, count(*)::BIGINT AS cnt FROM documents WHERE text <> '' GROUP BY ALL",
        "scan_order": "SELECT row_number() OVER (ORDER BY floor(log2(doc_id + 1)) DESC, doc_id) - 1 AS doc_id, md5(text) AS md5 FROM documents WHERE text <> ''",
        "scan_jsonl": "SELECT md5(text) AS md5, count(*)::BIGINT AS cnt FROM documents GROUP BY ALL",
        "load_tiktoken": _train_sql("benchmark", "l, r"),
        "pretok_spans": f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '({literal})', chr(57345) || '\\1' || chr(57345), 'g'), chr(57345)), lambda x: x <> '') AS s FROM documents),
            p AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN x IN ({quoted}) THEN [x] ELSE {_pieces_sql("gpt2", "x")} END)) AS p FROM s),
            f AS (SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, unnest(p) AS pretoken FROM p), n AS (SELECT *, octet_length(encode(pretoken)) AS n FROM f)
            SELECT doc_id, pos, (sum(n) OVER w - n)::BIGINT AS byte_start, (sum(n) OVER w)::BIGINT AS byte_end, pretoken, pretoken IN ({quoted}) AS added FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
        "first_difference": f"SELECT doc_id AS n, md5(text) AS left_md5, md5(replace(text, {_quoted(FORBIDDEN[0])}, '-')) AS right_md5 FROM documents WHERE contains(text, {_quoted(FORBIDDEN[0])}) ORDER BY doc_id LIMIT 1",
        "sp_precompiled": "SELECT doc_id, md5(" + functools.reduce(lambda t, e: f"replace({t}, {_quoted(e[0])}, {_quoted(e[1])})", MAPPED.items(), "text") + ") AS md5 FROM documents",
        "packed_sink": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, md5(coalesce(text, '')) AS md5 FROM documents",
        "scan_bytes": "SELECT md5(text) AS md5, count(*)::BIGINT AS cnt FROM benchmark WHERE text <> '' GROUP BY ALL",
    }
    return out | {k: _normalizer_sql(sql) for k, (_, sql) in _NORMALIZERS.items()}
