"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchflow.llm import languages, licenses, lines, mixing, near_vectors, packing, phrases, quality, sharding, simhash, substrings, token_counts, tries
from pitchflow.llm.tables import documents, shared_path, word_count


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = sharding.assign_shards(sized, "doc_id", "size", 24, map_path=shared_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), "doc_id", "text", tokenizer_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir), "doc_id", "text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), "text", tokenizer_path())


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), "doc_id", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mixing.repetitions(sized, "doc_id", "source", "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(documents(spark, sf_dir), "doc_id", "text")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_id(documents(spark, sf_dir), "doc_id", "text", "lang")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tries.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return tries.prefix_trie(tries.rebuilt(turns))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), "text", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_virtual_slots, op2_packing, op3_license_scan, op4_token_counts, op5_near_vectors, op6_quality_rules, op7_simhash, op8_line_dedup, op9_mixing, op10_substring_dedup, op11_language_id, op12_prefix_trie, op13_phrases)}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
_W = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_W}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT line) AS nd FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_W}') GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n - l.nd, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(l.n, 0) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 3 AND word_chars / n_words <= 10 AND n_symbols / word_chars <= 0.1
    AND n_stop / n_words >= 0.05 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM b""",
    "op8_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT r, doc_id, i, unnest(list_distinct(regexp_extract_all(ls[i], '{_W}'))) AS token FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT token, row_number() OVER (ORDER BY count(*), token) AS k FROM u GROUP BY token),
l0 AS (SELECT r, i, list(k ORDER BY k) AS w FROM u JOIN f USING (token) GROUP BY r, i),
l AS (SELECT d.r, d.doc_id, d.i, coalesce(w, []) AS w FROM (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i FROM d) d LEFT JOIN l0 USING (r, i)),
s AS (SELECT w, len(w) AS n, min((doc_id, i)) AS first FROM l WHERE len(w) > 0 GROUP BY w),
x AS (SELECT w, n, first, unnest(w[1:n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1]) AS token FROM s),
near AS (SELECT DISTINCT a.w FROM x a JOIN x b ON a.token = b.token AND b.first < a.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
k AS (SELECT l.r, l.i, s.w IS NOT NULL AND ((l.doc_id, l.i) > s.first OR near.w IS NOT NULL) AS gone FROM l LEFT JOIN s USING (w) LEFT JOIN near USING (w)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM k GROUP BY r),
t AS (SELECT k.r, string_agg(d.ls[k.i], chr(10) ORDER BY k.i) AS kept FROM k JOIN d USING (r) WHERE NOT gone GROUP BY k.r)
SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.kept, '')) END AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN t USING (r)""",
    "op9_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
o AS (SELECT *, left_size * weight < 3 * source_size * left_weight AS is_open FROM f),
z AS (SELECT min_by(left_size, 3 * source_size / weight) AS ls, min_by(left_weight, 3 * source_size / weight) AS lw FROM o WHERE is_open),
t AS (
  SELECT source, source_size, CASE WHEN is_open THEN CAST(ls AS DOUBLE) * weight / CAST(lw AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM o LEFT JOIN z ON TRUE),
r AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op12_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn ASC NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
z AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS BIGINT)) % 4 AS h FROM t),
r AS (
  SELECT z.conv_id, list_concat(coalesce(b.ts[1:z.h], []), z.ts[z.h + 1:]) AS s FROM z LEFT JOIN t b ON b.conv_id = z.conv_id - z.conv_id % 20),
m AS (SELECT conv_id, len(s) AS len, d, s[1:d] AS node, s FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends,
    coalesce(len(regexp_extract_all(node[d][2], '{_W}')), 0) AS words FROM m GROUP BY node, d),
c AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.node = c.node AND c.node IS NOT NULL),
u AS (SELECT node[1:e] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM k) GROUP BY ALL)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN u ON k.node = u.node LEFT JOIN n p ON k.d > 0 AND p.node = k.node[1:k.d - 1]""",
    "op13_phrases": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS ps FROM documents),
p AS (SELECT r, i, lang, regexp_extract_all(ps[i], '[^\x20\x09]+') AS ws FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM d)),
g AS (SELECT lang, ws[i:i + k - 1] AS ids, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, ids, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, ids, k, f AS a FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT DISTINCT s.lang, s.ids[t.i:t.i + t.m - 1] AS ids, s.a FROM c s, (SELECT i, m FROM (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4]) AS m)) t WHERE t.m < s.k AND t.i + t.m - 1 <= s.k),
k AS (SELECT c.* FROM c LEFT JOIN x ON c.lang = x.lang AND c.ids = x.ids AND c.a = x.a WHERE x.lang IS NULL),
u AS (SELECT *, unnest(range(1, k)) AS c FROM k),
s AS (
  SELECT u.lang, u.ids, u.a, n.n, u.c, l.f AS l, r.f AS r, CAST(1000 * CAST(u.a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM u JOIN n USING (lang) JOIN f l ON l.lang = u.lang AND l.ids = u.ids[1:u.c] JOIN f r ON r.lang = u.lang AND r.ids = u.ids[u.c + 1:u.k]),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ids ORDER BY score, c) AS o FROM s) WHERE o = 1),
z AS (SELECT lang, array_to_string(ids, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000""",
}
