"""One query per operator, over whole tables, and oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlake.llm import (
    curriculum, exact_dedup, packing, piece_sampling, prefix_trie, quality_rules, secret_scan, simhash, substring_dedup, token_files,
    warc, weak_labels, whitening,
)
from commentlake.llm.common import table


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write(table(spark, d, "pages"), folder)
    return warc.read(spark, folder, with_payload=False).drop("url", "payload")


def op2_piece_sampling(spark: SparkSession, d: str) -> DataFrame:
    return piece_sampling.round_trip(table(spark, d, "documents"))


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    at = quality_rules.judged(table(spark, d, "documents"))
    return at.select("row.doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op4_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write(table(spark, d, "documents"), folder)
    return token_files.read_checksums(spark, manifest, folder)


def op5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, d, "documents"))).drop("ids")


def op6_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    at = exact_dedup.deduplicated(table(spark, d, "documents"))
    return at.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, d, "documents"))


def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    repository = F.concat_ws("/", "source", "lang")
    at = secret_scan.scan(docs, repository=repository, carried=F.struct("doc_id"))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["c"]["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.judged(at).select(
        "carried.doc_id", *map(count, secret_scan.BASE),
        F.sha2(F.encode(secret_scan.listed(spans, base_only=True), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.listed(spans, base_only=False).alias("spans"),
    )


def op9_simhash(spark: SparkSession, d: str) -> DataFrame:
    at = simhash.grouped(table(spark, d, "documents"))
    bits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return at.select("doc_id", bits.alias("fingerprint"), "component_id")


def op10_weak_labels(spark: SparkSession, d: str) -> DataFrame:
    return weak_labels.judged(table(spark, d, "documents"))


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    numbered = prefix_trie.turns(table(spark, d, "conversations"))
    return prefix_trie.trie(prefix_trie.rebuilt(numbered)).drop("path")


def op12_curriculum(spark: SparkSession, d: str) -> DataFrame:
    at = curriculum.mixed(table(spark, d, "documents"))
    return at.select("doc_id", "size", "source_size", "target", "taken")


def op13_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whitened(table(spark, d, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_piece_sampling, op3_quality_rules, op4_token_files, op5_packing, op6_exact_dedup, op7_substring_dedup,
    op8_secret_scan, op9_simhash, op10_weak_labels, op11_prefix_trie, op12_curriculum, op13_whitening,
)}

_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_SPACE = r"[\x20\x09-\x0D]"

_OP3 = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
triples AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM docs WHERE len(words) > 2)),
twice AS (SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measures AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: list_contains([{_STOP}], lower(x)))) AS n_stop,
    coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS max_word_chars
  FROM docs LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS d FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars / d BETWEEN 2 AND 16 AND n_symbols / d <= 0.2
    AND n_stop / d >= 0.01 AND n_dup_lines / greatest(n_lines, 1) <= 0.4 AND max_word_chars <= 1000 AS kept
FROM judged"""

# DuckDB has no SHA-1 in base 32, but its hexadecimal digits can be regrouped.
_OP1 = """
WITH pages AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
hashed AS (SELECT page_id, p, octet_length(p) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM pages),
bits AS (
  SELECT *, list_aggregate([lpad(bin(('0x' || substr(h, k, 2))::INT), 8, '0') FOR k IN range(1, 40, 2)], 'string_agg', '') AS b FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      16 * substr(b, k, 1)::INT + 8 * substr(b, k + 1, 1)::INT + 4 * substr(b, k + 2, 1)::INT
      + 2 * substr(b, k + 3, 1)::INT + substr(b, k + 4, 1)::INT), 1) FOR k IN range(1, 160, 5)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)"""

# DuckDB has no CRC-32: each character goes in, then eight shifts (-1) follow.
_OP11 = r"""
WITH RECURSIVE numbered AS (
  SELECT conv_id, role AS r, text AS t, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')]),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
lines AS (
  SELECT heads.conv_id, i, r, t, words FROM heads JOIN numbered n ON n.conv_id = heads.conv_id - ((heads.conv_id % 20) + 20) % 20 AND i <= h
  UNION ALL SELECT heads.conv_id, i, r, t, words FROM heads JOIN numbered n ON n.conv_id = heads.conv_id AND i > h),
placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, words,
    octet_length(encode(r))::VARCHAR || ':' || octet_length(encode(t))::VARCHAR || ':' || r || t AS turn FROM lines),
paths AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS path, '' AS parent, 0::BIGINT AS words FROM heads
  UNION ALL SELECT p.conv_id, p.depth, sha256(paths.path || p.turn), paths.path, p.words
  FROM paths JOIN placed p ON p.conv_id = paths.conv_id AND p.depth = paths.depth + 1),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
first AS (
  SELECT paths.*, n, min(paths.conv_id) OVER (PARTITION BY path) AS node, n > paths.depth AS goes_on FROM paths JOIN lengths USING (conv_id)),
own AS (
  SELECT *, conv_id = node AS owner, max(goes_on) OVER (PARTITION BY path) AS grows FROM first),
up AS (
  SELECT *, sum(CASE WHEN owner THEN 0 ELSE words END) OVER w AS saved,
    sum(CASE WHEN owner AND NOT grows THEN 1 ELSE 0 END) OVER w AS leaves,
    coalesce(lead(owner) OVER (PARTITION BY conv_id ORDER BY depth), false) AS new_child,
    lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above
  FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(above) AS parent_conv_id, count(*) AS n_convs,
  sum(new_child::INT)::BIGINT AS n_children, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens,
  sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
FROM up GROUP BY path"""

_OP12 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, sha256(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + place % 3]::BIGINT AS weight FROM sources),
-- A level of words per weight: the largest prefix by room per weight is cut.
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, place) AS k FROM weighed),
cuts AS (
  SELECT c.n, (3 * (SELECT sum(source_size) FROM weighed) - 4 * coalesce(sum(source_size) FILTER (k <= c.n), 0))::BIGINT AS rest,
    coalesce(sum(weight) FILTER (k > c.n), 0)::BIGINT AS free
  FROM ranked, (SELECT unnest(range(0, (SELECT count(*) + 1 FROM ranked))) AS n) c GROUP BY c.n),
level AS (
  SELECT * FROM cuts WHERE NOT EXISTS (
    SELECT * FROM ranked WHERE k > cuts.n AND rest::HUGEINT * weight >= 4::HUGEINT * source_size * free) ORDER BY n LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN k <= n THEN 2.0::DOUBLE * source_size ELSE (weight * rest)::DOUBLE / (2 * free)::DOUBLE END AS target
  FROM ranked, level),
drawn AS (
  SELECT *, substr(sha256('42:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 16) AS draw FROM docs),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS words, coalesce(sum(size) OVER (
    PARTITION BY goals.source ORDER BY draw, doc_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM drawn JOIN goals ON drawn.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (greatest(0, least(size, words - before)) + greatest(0, least(size, words - before - source_size)))::BIGINT AS taken
FROM placed"""

ORACLES = {"op1_warc": _OP1, "op3_quality_rules": _OP3, "op6_exact_dedup": _OP6, "op11_prefix_trie": _OP11, "op12_curriculum": _OP12}
