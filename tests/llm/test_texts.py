"""Quality rules, personal data, secrets: against plain Python."""

import base64
import collections
import gzip
import random
import re
import time
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from sparktok.llm import pii, quality, secrets

from .conftest import table

WORD = r"[^\x20\x09-\x0D]+"


def test_quality_counts(spark, edge_rows):
    rng = random.Random(3)
    rows = edge_rows + [(100 + k, "".join(rng.choice("ab# \n") for _ in range(rng.randint(0, 80)))) for k in range(300)]
    rows += [(900, "a a a"), (901, "a a a a"), (902, "p q r s p q r"), (903, "x\ny\nx\n \n x\n")]
    got = collections.Counter(tuple(r[:6]) for r in quality.score(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = collections.Counter()
    for i, text in rows:
        t = text or ""
        w = re.findall(WORD, t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        want[i, len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(cover)] += 1
    assert got == want


def test_quality_verdicts(spark):
    good = "The cat sat on the mat and the dog was with it. " * 2 + " ".join(f"word{k} of thing{k}" for k in range(40))
    rows = [(1, good), (2, "a b c"), (3, "buy now cheap " * 40), (4, good.replace(" ", "## ")), (5, " ".join(f"zz{k}qq" for k in range(80)))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.score(table(spark, rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (False, False)}
    assert quality.score(table(spark, [])).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_pii_base_kinds(spark, edge_rows):
    rng = random.Random(5)
    rows = edge_rows + [(1000 + k, "".join(rng.choice("0123456789 -.@+%ab()é") if rng.random() < 0.9 else "4111111111111111 " for _ in range(rng.randint(1, 60)))) for k in range(1500)]
    rows += [(3000, "a@b.c%d@e.f.g@h.i 999.1.2.3.4 0001.2.3.4 1.2.3.4.5.6.7.8"), (3001, "a@b" + ".c" * 20000), (3002, " ".join(map(str, range(20000)))), (3003, "1.2.3.4 " * 3000)]
    found = pii.find(table(spark, rows)).select("doc_id", *(F.expr(f"transform({k}, x -> array(x.start, x.end))").alias(k) for k in BASE)).collect()
    got, want = collections.Counter(), collections.Counter()
    for r in found:
        got[r["doc_id"], *(tuple(map(tuple, r[k])) for k in BASE)] += 1
    for i, t in rows:
        want[i, *(tuple((m.start(), m.end()) for m in re.finditer(p, t or "") if passes(k, m[0])) for k, p in BASE.items())] += 1
    assert got == want


def test_pii_added_kinds(spark):
    text = "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32, DE00370400440532013000. SSN 123-45-6789; id 123-45-6789 call (212) 555-1234, +1 (212) 555-1234 and 212-555-9999x"
    r = pii.find(table(spark, [(1, text)])).first()
    assert [text[s["start"] : s["end"]] for s in r["iban"]] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert text.index("123-45") in [s["start"] for s in r["ssn"]]
    assert [text[s["start"] : s["end"]] for s in r["local_phone"]] == ["(212) 555-1234"] and len(r["phone"]) == 1
    assert r["iban"][0]["score"] == 1.0


SECRET = 'password = "hunter2hunter2'


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


@pytest.mark.parametrize(
    ("text", "depth"),
    [
        (SECRET, 0), ("x " + urllib.parse.quote(SECRET) + " y", 1), ("".join(f"\\u{ord(c):04x}" for c in SECRET), 1), (b64(SECRET), 1), (b64(b64("zz " + SECRET)), 2),
        (b64(zlib.compress(SECRET.encode())), 1), (b64(gzip.compress(SECRET.encode())), 1), (urllib.parse.quote(b64(SECRET) + "=="), 1), ("pre " + b64(urllib.parse.quote(b64("é " + SECRET))) + " post", 2),
    ],
)
def test_layers_are_unwrapped_and_mapped(text, depth):
    base, spans = secrets.find(text)
    assert len(spans) == 1 and spans[0][0] == "assign" and spans[0][3] == depth and bool(base) == (depth == 0)
    _, a, b, _ = spans[0]
    assert "hunter2" not in secrets.redact(text, spans) and "[assign]" in secrets.redact(text, spans) and 0 <= a < b <= len(text)


@pytest.mark.parametrize("token", [b64(SECRET), b64(zlib.compress(SECRET.encode())), b64(gzip.compress(SECRET.encode())), b64(b64("zz " + SECRET))])
def test_repeated_tokens_are_found_at_every_place(token):
    text = f"a {token} b {token}\nc {token}"
    spans = secrets.find(text)[1]
    assert len(spans) == 3 and [text[: s[1]].count(token) for s in spans] == [0, 1, 2]
    assert token not in (left := secrets.redact(text, spans)) and left.count("[assign]") == 3 and len(secrets.find(left)[1]) == 0
    assert [s[3] for s in secrets.find(f"{token} %41 \\u0041")[1]] == [spans[0][3]]


OTHER = "".join(f"line {k} of {k * k}\n" for k in range(99))


@pytest.mark.parametrize(
    "text",
    [
        "https://h/x/" + b64(SECRET), "blob_" + b64(SECRET), "some-thing_" + b64(SECRET), b64(SECRET)[:-1] + "_and/more", "x/y/" + b64(zlib.compress(SECRET.encode())), "a_" + b64(gzip.compress(SECRET.encode())) + "_b", b64(b"\xff\xfe" + SECRET.encode() + b" \xff"),
        "".join(f"%{c:02x}" for c in b"\xff" + SECRET.encode() + b"\xc3"), "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET) + "\\udc00",
        b64(gzip.compress(OTHER.encode()) + gzip.compress(SECRET.encode())), b64(gzip.compress((OTHER + SECRET + OTHER * 99).encode())[:-9]), b64(zlib.compress(b"a " * (secrets.LARGEST // 2 + 999) + SECRET.encode())),
    ],
)
def test_parts_are_unwrapped_as_far_as_they_go(text):
    spans = secrets.find(text)[1]
    assert {s[0] for s in spans} == {"assign"} and not any("hunter2" in x.text for x in secrets.layers(secrets.redact(text, spans)))


def test_pieces_overlap_and_reach_the_end():
    data = bytes(range(256)) * 40000
    got = list(secrets.pieces(zlib.compress(data), 1 << 20, 100))
    assert len(got) > 5 and got[0] + b"".join(p[100:] for p in got[1:]) == data and list(secrets.pieces(b"none")) == []


def is_text(data):
    try:
        return data.decode() is not None
    except ValueError:
        return False


def plain_unpacked(data, depth=0):
    yield data
    for unpack in (zlib.decompress, gzip.decompress):
        try:
            if depth < 5:
                yield from plain_unpacked(unpack(data), depth + 1)
        except (ValueError, OSError, EOFError, zlib.error):
            pass


def plain_layers(text, depth=0):
    """All that a text holds, decoded by other means: each encoding tried on each run of its characters, recursively."""
    yield text
    if depth > 6:
        return
    found = set()
    if "%" in text:
        found.add(urllib.parse.unquote(text))
    if "\\" in text:
        pairs = re.sub(r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})", lambda m: (bytes.fromhex(m[1]) + bytes.fromhex(m[2])).decode("utf-16-be"), text)
        found.add(re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2}))", lambda m: chr(int(m[1] or m[2], 16)), pairs))
    for run in re.findall(r"[A-Za-z0-9+/_-]{16,}", text):
        for part in {run, *re.split(r"[/_-]", run)}:
            data = base64.urlsafe_b64decode(part.replace("+", "-").replace("/", "_") + "=" * (-len(part) % 4)) if len(part) % 4 != 1 else b""
            found |= {x.decode() for x in plain_unpacked(data) if is_text(x)}
    for block in re.findall(r"(?:[A-Za-z0-9+/_-]{76}\n)+[A-Za-z0-9+/_-]*", text):
        found |= {x.decode() for x in plain_unpacked(base64.urlsafe_b64decode(block.replace("\n", "").replace("+", "-").replace("/", "_") + "===")) if is_text(x)}
    for inner in found - {text, ""}:
        yield from plain_layers(inner, depth + 1)


def holds_secret(text):
    return any(secrets.scan(x) for x in plain_layers(text))


WRAP = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "quoted": urllib.parse.quote,
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "bytes": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "url-safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "twice": lambda t: base64.b64encode(zlib.compress(gzip.compress(zlib.compress(t.encode()), mtime=0))).decode(),
    "lines": lambda t: base64.encodebytes(gzip.compress(t.encode(), mtime=0)).decode().rstrip("\n"),
}


@pytest.mark.parametrize("seed", range(40))
def test_nested_layers_hold_no_secret_that_is_not_found(seed):
    """Secrets wrapped one to four times, several and some of them repeated in a text: each place is found and blotted out."""
    rng = random.Random(seed)
    kinds = {"assign": lambda: f"{rng.choice(('password', 'API_KEY', 'token'))}{rng.choice((' = ', ': ', '='))}{''.join(rng.choices('abcdefXYZ0123456789', k=rng.randint(8, 20)))}", "access": lambda: "AKIA" + "".join(rng.choices("ABCDEFGH0123456789", k=16)), "hex": lambda: "".join(rng.choices("0123456789abcdef", k=40))}
    wrapped = []
    for _ in range(3):
        text = kinds[rng.choice(list(kinds))]()
        for _ in range(rng.randint(1, 4)):
            text = WRAP[rng.choice(list(WRAP))](f"{rng.choice(('', 'note '))}{text}{rng.choice(('', ' end'))}" if rng.random() < 0.5 else text)
        wrapped.append(text)
    parts, places = [], []
    for text in rng.sample(wrapped * 2, 6):
        parts.append(f"{rng.choice(('Some words here', 'key', '<<', '%zz', 'a/b'))} ")
        places.append((sum(map(len, parts)), text))
        parts += [text, rng.choice((" ", "\n", " ; "))]
    whole = "".join(parts)
    assert all(whole[a : a + len(t)] == t for a, t in places) and all(holds_secret(t) for _, t in places)
    spans = secrets.find(whole)[1]
    assert all(any(a <= s[1] and s[2] <= a + len(t) for s in spans) for a, t in places)
    assert not holds_secret(secrets.redact(whole, spans))


def test_cycles_end_and_broken_layers_stay():
    for text in ("%25" * 50, "%2525252541", "A" * 500, b64(b"\x78\x9c broken"), "\\ud800\\u0041", "%ff%fe", ""):
        secrets.find(text)


def test_streams_inside_streams_and_wrapped_lines():
    inner = (OTHER + SECRET + OTHER).encode()
    packers = (zlib.compress, gzip.compress, lambda d: zlib.compress(d[: len(d) // 2]) + zlib.compress(d[len(d) // 2 :]))
    for one in packers:
        for two in packers:
            for three in (lambda d: d, *packers):
                for text in (b64(three(two(one(inner)))), base64.encodebytes(three(two(one(inner)))).decode(), "key: " + base64.encodebytes(three(two(one(inner)))).decode().replace("\n", "\r\n  ")):
                    spans = secrets.find(text)[1]
                    assert [s[0] for s in spans] == ["assign"] and not any("hunter2" in x.text for x in secrets.layers(secrets.redact(text, spans)))
    large = zlib.compress(zlib.compress(b"a " * 999 + bytes(random.Random(1).choices(b"abcdef \n", k=700_000)) + SECRET.encode()))
    assert any(SECRET.encode() in p for p in secrets.pieces(large, 1 << 16, 64))
    lines = base64.encodebytes((OTHER + SECRET + " and " + SECRET).encode()).decode()
    spans = secrets.find(f"see\n{lines}\nend")[1]
    assert len(spans) == 2 and spans[0][2] <= spans[1][1] + 4 and not any("hunter2" in x.text for x in secrets.layers(secrets.redact(lines, secrets.find(lines)[1])))
    assert len(secrets.find("a first line of internationalization\npassword = hunter2hunter2\nand more")[1]) == 1


def test_a_stream_that_holds_itself_ends(monkeypatch):
    """Every stream is taken to hold the same stream again."""
    loop = zlib.compress(b"x")
    monkeypatch.setattr(secrets, "_inflated", lambda feed, taken=None: iter([loop]))
    assert list(secrets.pieces(loop)) == [loop, loop]


@pytest.mark.parametrize("text", ["/H4sI" * 200_000, "/H4sIA" * 166_000, "eJ/" * 330_000, "eJw/" * 250_000, "x_eNqrVkrLz1eyUkpKLFKqBQAdegQ0" * 30_000, "A" * 1_000_000, "a\nbcdefghijklmnopqrst" * 50_000])
def test_a_million_hostile_characters_take_seconds(text):
    began = time.process_time()
    secrets.find(text)
    assert time.process_time() - began < 8


def test_base_secrets_and_digests(spark, edge_rows):
    rng = random.Random(6)
    bits = ["token=", "API_key : '", "apikey=", "AKIA", "secret", ": ", "0123456789abcdef" * 2, "Zz9+/", "abc", " ", '"', "=", "\n"]
    rows = edge_rows + [(500 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for k in range(400)]
    patterns = {"assign": re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    got = collections.Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in secrets.find_all(table(spark, rows)).collect())
    want = collections.Counter()
    for i, t in rows:
        found = [(k, m.start(), m.end()) for k, p in patterns.items() for m in p.finditer(t or "") if least[k](m)]
        want[i, tuple(sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))] += 1
    assert got == want and secrets.find_all(table(spark, [])).count() == 0


def test_redacted_tables_keep_their_columns(spark):
    rows = secrets.redact_all(table(spark, [(1, f"a {SECRET} b"), (2, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["a [assign] b", None] and rows[0]["rid"] == "r"


def test_pii_equals_its_sql(spark, edge_rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from sparktok.llm import queries

    rng = random.Random(12)
    bits = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "(212) 555-1234", "+1 (212) 555-1234", "4111 1111 1111 1111", "10.0.0.256", "1.2.3.4.5", "me@x.org", "me@x", " ssn ", " call ", " bank", ", ", " ", "é", "x", "-", "7"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    rows = [(k, t) for k, t in enumerate([*texts, None, "", *(t for _, t in edge_rows)])]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.op5_pii(spark, str(tmp_path))
    names, result = sorted(df.columns), con.execute(queries.OP5_SQL)
    at = [[d[0] for d in result.description].index(n) for n in names]
    got = sorted([str(r[n]) for n in names] for r in df.collect())
    assert got == sorted([str(r[i]) for i in at] for r in result.fetchall()) and sum("iban" in str(r) for r in got) > 20
