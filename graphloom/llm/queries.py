"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langmix, licenses, linestore, neardup, packing, quality, secrets, segment, tokenbin


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.report(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.report(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.report(_table(spark, sf_dir, "documents"))


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), shards=16)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linestore.report(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.scan(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_sampled_pieces": op2_sampled_pieces,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_mixture": op4_language_mixture,
    "op5_bin_packing": op5_bin_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS width, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, width, array_to_string(w[p : p + width - 1], ' ') AS k FROM bw),
widths AS (SELECT DISTINCT width FROM win),
dw AS (SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS p, w FROM d, widths WHERE len(w) >= width),
dk AS (SELECT doc_id, width, p, array_to_string(w[p : p + width - 1], ' ') AS k FROM dw),
hit AS (SELECT doc_id, item_id, p, dk.width FROM dk JOIN win ON dk.k = win.k AND dk.width = win.width),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + width)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id),
spans AS (SELECT doc_id, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS hit_spans FROM (SELECT doc_id, min(q) - 1 AS lo, max(q) AS hi FROM (
  SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS run FROM (SELECT DISTINCT doc_id, unnest(range(p, p + width)) AS q FROM hit)) GROUP BY doc_id, run) GROUP BY doc_id),
dword AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
bword AS (SELECT item_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM b),
pairs AS (SELECT doc_id, item_id, size, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM dword JOIN bword USING (word)),
runs AS (SELECT doc_id, item_id, size, count(*) AS n, min(p) - 1 AS p, min(q) - 1 AS q FROM pairs GROUP BY doc_id, item_id, size, p - q, run),
best AS (SELECT * FROM runs WHERE n > 1 OR size = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p, item_id, q) = 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(best.n, 0)::BIGINT AS longest_match, best.p AS match_word, best.item_id::VARCHAR AS match_item, best.q AS match_item_word, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id) LEFT JOIN best USING (doc_id)
"""

_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT doc_id, line, p, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_SPACE_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
often AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM win JOIN often USING (doc_id, k)) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
o AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) AS own FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(own::INT)::DOUBLE AS x FROM o WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(n) AS n, sum(x) AS x, count(*)::DOUBLE AS h, sum(n * n) AS nn, sum(x * x / n) AS xx, least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS m FROM h),
v AS (SELECT m, (xx - x * x / n - (h - 1) * m * (1 - m)) / nullif(n - nn / n, 0) AS between FROM s),
z AS (SELECT m, least(greatest(CASE WHEN between > 0 THEN m * (1 - m) / between - 1 ELSE 1e6 END, 1), 1e6) AS weight FROM v),
bad AS (SELECT source FROM h, z WHERE (m * weight + x) / (weight + n) > 0.75)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT own AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM o
"""

ORACLES = {"op3_decontaminate": _OP3, "op6_near_duplicates": _OP6, "op7_line_dedup": _OP7, "op10_quality_rules": _OP10}
