"""The named queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm import (bpe, caps, divergence, license_scan, lines, neighbours, quality, resampling, simhash, surrogate,
                          templates, token_files, warc)
from keepwell.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the ranks of the 50k multilingual vocabulary, and the way back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share, dropped from all but the last."""
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k) GROUP BY doc_id
"""

def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_a_shingle=4)
    return found.select(F.col("id").alias("doc_id"), simhash.unsigned_hex("fp").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views and of their combination for every document, and whether it is kept."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its values changed or not."""
    return templates.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, lengths and checksums of all documents, from the token files that were written."""
    files = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_documents(spark, files.folder)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page in WARC files that were converted from ARC files."""
    folder, files = warc.archive(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_warc(spark, folder, files)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every embedding."""
    found = caps.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
    ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.x = e.vec_id)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = e.vec_id
"""

def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of its personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate.replace_entities(docs, key=b"a key that a deployment keeps to itself")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and what terms each has more of."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
terms AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM terms GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w)::HUGEINT AS p,
         1 + (1000000000 * (total + 5)) // (sum(total) OVER w + 5 * count(*) OVER w)::HUGEINT AS q
  FROM cells WINDOW w AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms_over AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms_over)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark, and the tenth of the documents that is drawn."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


# CRC-32 bit by bit makes the table of 256 entries; a word's bytes then go through it.
OP12_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, 0 AS k FROM documents UNION ALL SELECT item_id, coalesce(text, ''), 1 FROM benchmark),
lists AS (
  SELECT doc_id, k, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM docs),
words AS (SELECT doc_id, k, unnest(ws) AS w FROM lists),
crc_table AS (
  SELECT list(v ORDER BY i) AS c FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
hexes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM words)),
bytes AS (
  SELECT w, list_concat([4294967295::UBIGINT], list_transform(range(length(x) // 2),
    lambda i: ('0x' || substr(x, (2 * i + 1)::INTEGER, 2))::UBIGINT)) AS b FROM hexes),
buckets AS (
  SELECT w, xor(list_reduce(b, lambda a, e: xor(a >> 8, c[(xor(a, e) & 255)::INTEGER + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM bytes, crc_table),
counts AS (SELECT bucket, count(*) FILTER (WHERE k = 0) AS s, count(*) FILTER (WHERE k = 1) AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain FROM counts, totals),
sums AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE k = 0 GROUP BY doc_id),
weights AS (
  SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0
         ELSE ((total - ((total % n) + n) % n) // n)::BIGINT END AS weight
  FROM (SELECT doc_id FROM documents) LEFT JOIN sums USING (doc_id)),
scored AS (
  SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM weights),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n_all FROM scored WHERE n >= 20)
SELECT doc_id, n AS n_features, weight, score, r AS rank, n AS n_words
FROM scored LEFT JOIN (SELECT doc_id, r FROM ranked WHERE r <= 10 * n_all // 100) USING (doc_id)
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product found for every twentieth embedding."""
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


# DuckDB has no SHA-1; the twin of the digest is in the tests.
QUERIES = {"op1_bpe": op1_bpe, "op2_lines": op2_lines, "op3_caps": op3_caps, "op4_simhash": op4_simhash,
           "op5_token_files": op5_token_files, "op6_licenses": op6_licenses, "op7_quality": op7_quality,
           "op8_surrogates": op8_surrogates, "op9_warc": op9_warc, "op10_templates": op10_templates,
           "op11_divergence": op11_divergence, "op12_resampling": op12_resampling, "op13_neighbours": op13_neighbours}
ORACLE_SQL: dict[str, str] = {"op2_lines": OP2_SQL, "op3_caps": OP3_SQL, "op11_divergence": OP11_SQL, "op12_resampling": OP12_SQL}
