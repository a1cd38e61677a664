"""The registered queries ``opN_<name>`` and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.files import spread
from . import decontam, hard_negatives, langid, lm, mixing, ngram_join, packing, pii, prefix_trie, quality, secrets, sharding, substr_dedup
from .scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    """Vocabulary file of the packing query: a public tokenizer installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of at most 2048 tokens."""
    with Scratch(spark) as scratch:
        return scratch.keep(packing.digests(table(spark, sf_dir, "documents"), scratch, tokenizer_path()).withColumn("length", F.col("length").cast("long")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the unigram base and the recurrent model."""
    with Scratch(spark) as scratch:
        return scratch.keep(lm.score(table(spark, sf_dir, "documents"), scratch))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).withColumn("held_out", langid.held_out())
        return scratch.keep(found.select("doc_id", "held_out", "lang_pred", "score", "rejected"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the threshold table."""
    return quality.score(table(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_RULES = " AND ".join(
    f"(CASE WHEN {below} > 0 THEN {top}::DOUBLE / {below} ELSE 0 END) {sign} {bound}"
    for _, top, below, least, most in quality.THRESHOLDS
    for sign, bound in ((">=", least), ("<=", most))
    if bound is not None
)
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': array_to_string(w[i:i + 2], ' ')}})) AS s FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY doc_id, s.g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
    FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_RULES} AS kept FROM b
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document, and the score of each span in hundredths."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.BASE), F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"), pii.joined((*pii.BASE, *pii.MORE)).alias("spans"), pii.scores((*pii.BASE, *pii.MORE)).alias("scores"))


def _spans_sql(kind: str, pattern: str, keep: str) -> str:
    """Rows (doc_id, kind, m, a, b) of a pattern's matches that pass; places are summed from matches and what lies between."""
    return f"""SELECT doc_id, '{kind}' AS kind, m, a::INTEGER AS a, (a + length(m))::INTEGER AS b, t FROM (
    SELECT doc_id, t, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS a
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)) WHERE {keep}"""


def _op5_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT > 4 THEN 2 * reverse({digits})[i]::INT - 9 ELSE 2 * reverse({digits})[i]::INT END)) % 10 = 0"
    number = "list_transform(string_split(substring(replace(m, ' ', ''), 5) || substring(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce([0::BIGINT] || {number}, lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1"
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS HUGEINT), 999) > 255)) = 0"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    }

    def context(k: pii.Kind) -> str:
        near = "(^|[^a-z])(" + "|".join(k.context) + ")($|[^a-z])"
        before = f"lower(substring(t, greatest(a - {pii.CONTEXT_BEFORE}, 0) + 1, a - greatest(a - {pii.CONTEXT_BEFORE}, 0)))"
        return f"(regexp_matches({before}, '{near}') OR regexp_matches(lower(substring(t, b + 1, {pii.CONTEXT_AFTER})), '{near}'))"

    def score(k: pii.Kind) -> str:
        checked = pii.CHECKSUM_BONUS if k.name in ("card", "iban") else 0
        near = f" + CASE WHEN {context(k)} THEN {round(100 * pii.CONTEXT_BONUS)} ELSE 0 END" if k.context else ""
        return f"least(100, {round(100 * (k.base + checked))}{near})"

    parts = [_spans_sql(k, p, keep) for k, (p, keep) in base.items()]
    free = "NOT regexp_matches((CASE WHEN a > 0 THEN substring(t, a, 1) ELSE '' END) || chr(10) || substring(t, b + 1, 1), '[A-Za-z0-9+-]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.a < x.b AND x.a < b.b)"
    more = [f"SELECT doc_id, kind, a, b, {score(k)} AS score FROM ({_spans_sql(k.name, k.pattern, mod97 if k.name == 'iban' else 'true')}) x WHERE {free}{'' if k.name == 'iban' else ' AND ' + context(k)}" for k in pii.MORE]
    scored = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {score(k)}" for k in pii.BASE) + " END"
    order = ", ".join(f"'{k.name}'" for k in (*pii.BASE, *pii.MORE))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}' AND NOT added)::BIGINT AS n_{k}" for k in base)
    in_order = f"',' ORDER BY list_position([{order}], kind), a"
    joined = f"string_agg(kind || ':' || a || ':' || b, {in_order})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({' UNION ALL '.join(f'({p})' for p in parts)}),
s AS (SELECT doc_id, kind, a, b, {scored} AS score, false AS added FROM b UNION ALL SELECT *, true FROM ({' UNION ALL '.join(f'({p})' for p in more)}))
SELECT d.doc_id, {counts}, sha256(coalesce({joined} FILTER (NOT added), '')) AS base_sha256, coalesce({joined}, '') AS spans, coalesce(string_agg(score::INTEGER::VARCHAR, {in_order}), '') AS scores FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


OP5_SQL = _op5_sql()


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, with 24 shards and with one more, and its shard once bytes are evened out.

    The map's versions stay in a folder of this call's own in the shared one:
    the first, by which rows are placed, and the one evened out.
    """
    with Scratch(spark) as scratch:
        out = sharding.shard(table(spark, sf_dir, "documents"), scratch, f"{scratch.root}-slot-map")
        return scratch.keep(out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes", "balanced_shard"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whether it holds a passage of a benchmark item, and of which."""
    with Scratch(spark) as scratch:
        return scratch.keep(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard similarity of 0.85 of 4-word shingles."""
    with Scratch(spark) as scratch:
        return scratch.keep(ngram_join.join(table(spark, sf_dir, "documents"), scratch).select("doc_id", "n_shingles", "component_id"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.o)::BIGINT AS component_id FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every document and in what is encoded in it."""
    found = secrets.find_all(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left and removed, and a digest of what is kept, of every document."""
    with Scratch(spark) as scratch:
        out = substr_dedup.drop_repeats(table(spark, sf_dir, "documents"), scratch)
        return scratch.keep(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {'i': i, 'g': array_to_string(w[i:i + 19], ' ')})) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s.i AS i, row_number() OVER (PARTITION BY s.g ORDER BY doc_id, s.i) AS place FROM s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM k WHERE place > 1),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
x AS (SELECT t.doc_id, count(r.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.j) FILTER (r.j IS NULL), '') AS kept FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.j = r.j GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of other labels inside the score window of each anchor and positive."""
    with Scratch(spark) as scratch:
        return scratch.keep(hard_negatives.mine(table(spark, sf_dir, "embeddings"), scratch))


OP11_SQL = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, v.vec_id AS b, a.label = v.label AS same, list_inner_product(a.v, v.v)::BIGINT AS s FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b AS p, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.p AS positive_id, (row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with its subtree's leaves and savings."""
    with Scratch(spark) as scratch:
        return scratch.keep(prefix_trie.nodes(table(spark, sf_dir, "conversations"), scratch))


OP12_SQL = f"""
WITH d AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT *, md5(length(r) || ':' || r || t) AS m FROM d),
o AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, m[1:15], m[17:31]) AS own FROM m GROUP BY conv_id),
c AS (SELECT *, (xor(list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::UBIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8)::UBIGINT[], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % {prefix_trie.HEADS})::BIGINT AS h FROM o),
p AS (SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS turns FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % {prefix_trie.GROUP}),
s AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM p),
g AS (SELECT turns[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends FROM s GROUP BY k, depth),
w AS (SELECT k[1:depth - 1] AS k, count(*) AS n FROM g WHERE depth > 0 GROUP BY 1),
a AS (SELECT g.*, coalesce(w.n, 0) AS n_children FROM g LEFT JOIN w ON w.k = g.k),
b AS (SELECT k[1:j] AS k, sum(leaf) AS leaves, sum(save) AS saved FROM (SELECT k, unnest(range(depth + 1)) AS j, (n_children = 0)::INT AS leaf, CASE WHEN depth > 0 THEN (n - 1) * length(k[depth].t) ELSE 0 END AS save FROM a) GROUP BY 1)
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN b ON b.k = a.k LEFT JOIN g q ON a.depth > 0 AND q.k = a.k[1:a.depth - 1]
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of sources by weight, and the words that it gives."""
    with Scratch(spark) as scratch:
        out = mixing.mix(table(spark, sf_dir, "documents"), scratch)
        return scratch.keep(out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies"))


def queries() -> dict[str, Query]:
    found = (op1_best_fit_packing, op2_lm_scoring, op3_language_id, op4_quality_rules, op5_pii, op6_sharding, op7_decontamination, op8_ngram_join, op9_secret_scan, op10_substring_dedup, op11_hard_negatives, op12_prefix_trie, op13_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None for the others: DuckDB has no tokenizer, no CRC-32, no decoding worklist and no training."""
    return {"op4_quality_rules": OP4_SQL, "op5_pii": OP5_SQL, "op8_ngram_join": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
