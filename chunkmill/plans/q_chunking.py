"""Queries for the chunking operators (C1-C10) and the flagship summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import DEFAULT_SEPARATORS
from ..operators.chunking import (
    DEFAULT_OVERLAP, DEFAULT_SIZE, encode_metadata, explode_chunks, measured_chunks,
    measured_windows, paragraph_chunks, recursive_chunks, semantic_chunks, split_sentences, window_chunks, sparse_unit, token_buckets, bucket_counts,
)
from ..operators.chunking import adjacent_distances
from ..operators.grouped import grouped_percentile
from .duck_recursive import chunk_rows_sql, measured_rows_sql
from .fixtures import FIXED_TIME, doc_files, strip_sql, table
from .registry import query

MARK = "chr(57344)"
WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
  SELECT doc_id, filename, lang, chunk_text,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index,
         CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks
  FROM (
    SELECT doc_id, filename, lang, k, {strip_sql(f'substring(text, CAST(k * {step} + 1 AS BIGINT), {size})')} AS chunk_text
    FROM (SELECT doc_id, lang, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, text,
                 unnest(range(0, greatest(1, CAST(ceil((length(text) - {overlap}) / {step}.0) AS BIGINT)))) AS k
          FROM documents)
  ) WHERE chunk_text <> ''"""


def lang_summary(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", window_chunks("text", DEFAULT_SIZE, DEFAULT_OVERLAP))
    rows = explode_chunks(d, "chunks", "filename", keep=["lang"])
    return rows.groupBy("lang").agg(
        F.count_distinct("filename").alias("documents"),
        F.count(F.lit(1)).alias("chunks"),
        F.round(F.avg(F.length("chunk_text")), 4).alias("avg_chunk_chars"),
    )


query("lang_chunk_summary", "C2+C8 -> groupBy(lang)", f"""
SELECT lang, count(DISTINCT filename) AS documents, count(*) AS chunks, round(avg(length(chunk_text)), 4) AS avg_chunk_chars
FROM ({_windows_sql(DEFAULT_SIZE, DEFAULT_OVERLAP)}) GROUP BY lang""")(lang_summary)


@query("chunk_window", "C2", f"SELECT filename, chunk_index, total_chunks, chunk_text FROM ({_windows_sql(512, 50)})")
def chunk_window(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", window_chunks("text", 512, 50))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


@query("chunk_recursive", "C1", chunk_rows_sql(DEFAULT_SIZE, DEFAULT_OVERLAP, DEFAULT_SEPARATORS))
def chunk_recursive(spark, sf):
    """Recursive splitter on every document (defaults 512 / 50); also checked in the tests against
    a brute-force splitter."""
    d = doc_files(spark, sf).withColumn("chunks", recursive_chunks("text", DEFAULT_SIZE, DEFAULT_OVERLAP))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


@query("chunk_recursive_ui", "C1 (UI defaults 1000 / 100)", chunk_rows_sql(1000, 100, DEFAULT_SEPARATORS))
def chunk_recursive_ui(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", recursive_chunks("text", 1000, 100))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


NON_WS = "[^" + WS[1:]


@query("chunk_recursive_words", "C1 by words (P3)", measured_rows_sql(
    lambda x: f"len(regexp_extract_all({x}, '{NON_WS}+'))", 100, 20, DEFAULT_SEPARATORS))
def chunk_recursive_words(spark, sf):
    """The recursive splitter measuring words: chunks of up to 100, up to 20 carried over (brute force in the tests)."""
    d = doc_files(spark, sf).withColumn("chunks", measured_chunks("text", 100, 20, "words"))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


@query("chunk_window_words", "C2 by words (P3)", f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(k AS INTEGER) AS chunk_index,
       CAST(nk AS INTEGER) AS total_chunks, {strip_sql("array_to_string(u[k * 80 + 1 : k * 80 + 100], '')")} AS chunk_text
FROM (SELECT doc_id, u, nk, unnest(range(0, nk)) AS k
      FROM (SELECT doc_id, u, greatest(CAST(ceil((len(u) - 20) / 80.0) AS BIGINT), CASE WHEN len(u) > 0 THEN 1 ELSE 0 END) AS nk
            FROM (SELECT doc_id, regexp_extract_all({strip_sql('text')}, '{NON_WS}+{WS}*') AS u FROM documents)))""")
def chunk_window_words(spark, sf):
    """Windows of 100 words, every 80."""
    d = doc_files(spark, sf).withColumn("chunks", measured_windows("text", 100, 20, "words"))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


SENT_SQL = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, s[i] AS sentence
FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(text, '([.?!]){WS}+', '\\1' || {MARK}, 'g'), {MARK}) AS s
            FROM documents))"""


@query("split_sentences", "C3", SENT_SQL)
def q_split_sentences(spark, sf):
    d = table(spark, sf, "documents")
    # outer form: a plain posexplode would push an inferred size filter (a second split) to the scan
    return (d.select("doc_id", F.posexplode_outer(split_sentences("text")).alias("sentence_index", "sentence"))
            .where(F.col("sentence").isNotNull()).withColumn("sentence_index", F.col("sentence_index").cast("int")))


EMBED_SQL = f"""
SELECT doc_id, sentence_index, CAST(len(bk) AS INTEGER) AS n_tokens, b, count(*) AS cnt
FROM (SELECT doc_id, sentence_index, bk, unnest(bk) AS b
      FROM (SELECT doc_id, sentence_index,
                   list_transform(list_filter(string_split_regex(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''),
                                  lambda w: (CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64)) AS bk
            FROM ({SENT_SQL}))) GROUP BY doc_id, sentence_index, bk, b"""


@query("embed_sentences", "C4", f"""
SELECT doc_id, sentence_index, CAST(len(toks) AS INTEGER) AS n_tokens,
       array_to_string(list_transform(range(0, 64), lambda b: len(list_filter(bk, lambda x: x = b))), ',') AS bucket_counts
FROM (SELECT doc_id, sentence_index, toks,
             list_transform(toks, lambda w: (CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64)) AS bk
      FROM (SELECT doc_id, sentence_index,
                   list_filter(string_split_regex(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') AS toks
            FROM ({SENT_SQL})))""")
def embed_sentences(spark, sf):
    s = q_split_sentences(spark, sf)
    # the unit vector is hashed_embedding(sentence); the counts are its exact integer form
    s = s.withColumn("bk", token_buckets("sentence", 64))
    counts = F.transform(bucket_counts("bk", 64), lambda c: c.cast("int"))
    return s.select("doc_id", "sentence_index", F.size("bk").cast("int").alias("n_tokens"),
                    F.array_join(counts, ",").alias("bucket_counts"))


@query("embed_sentences_unit", "C4 (the unit vector, sparse)", f"""
SELECT doc_id, sentence_index, n_tokens, CAST(b AS INTEGER) AS bucket,
       round(cnt / sqrt(CAST(sum(cnt * cnt) OVER (PARTITION BY doc_id, sentence_index) AS DOUBLE)), 9) AS weight
FROM ({EMBED_SQL})""")
def embed_sentences_unit(spark, sf):
    """The non-zero components of every sentence's unit vector as rows."""
    s = q_split_sentences(spark, sf)
    s = s.select("doc_id", "sentence_index", token_buckets("sentence", 64).alias("bk"))
    s = s.select("doc_id", "sentence_index", F.size("bk").cast("int").alias("n_tokens"), sparse_unit("bk").alias("v"))
    s = s.select("doc_id", "sentence_index", "n_tokens", F.explode_outer("v").alias("c")).where(F.col("c").isNotNull())
    return s.select("doc_id", "sentence_index", "n_tokens", F.col("c.bucket").cast("int").alias("bucket"), F.round("c.weight", 9).alias("weight"))


def _emb_distances(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return adjacent_distances(e, "label", "vec_id", "v").select("vec_id", "label", F.round("distance", 6).alias("distance"))


DIST_SQL = """
SELECT vec_id, label,
       round(1 - list_dot_product(pv, v) / (sqrt(list_dot_product(pv, pv)) * sqrt(list_dot_product(v, v))), 6) AS distance
FROM (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS pv
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""


@query("adjacent_distance", "C5", DIST_SQL)
def adjacent_distance(spark, sf):
    return _emb_distances(spark, sf)


@query("percentile_breakpoints", "C6", f"""
SELECT d.vec_id, d.label, d.distance, round(t.threshold, 6) AS threshold, coalesce(d.distance > t.threshold, false) AS is_break
FROM ({DIST_SQL}) d LEFT JOIN (SELECT label, quantile_cont(distance, 0.5) AS threshold FROM ({DIST_SQL}) GROUP BY label) t
  ON d.label = t.label""")
def percentile_breakpoints(spark, sf):
    d = _emb_distances(spark, sf)
    thr = grouped_percentile(d, "label", "distance", 0.5)
    return d.join(thr, "label", "left").select(
        "vec_id", "label", "distance", F.round("threshold", 6).alias("threshold"),
        F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).alias("is_break"))


SEMANTIC_SQL = f"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.?!]){WS}+', '\\1' || {MARK}, 'g'), {MARK}) AS s FROM documents),
b AS (
  SELECT doc_id, s, len(s) AS n,
         list_transform(s, lambda x: list_transform(
             list_filter(string_split_regex(lower(x), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''),
             lambda w: CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64)) AS bk
  FROM s),
c AS (
  SELECT doc_id, s, n,
         list_transform(range(1, n + 1), lambda i: list_transform(range(0, 64), lambda k:
             CAST(len(list_filter(flatten(bk[greatest(i - 1, 1):least(i + 1, n)]), lambda x: x = k)) AS DOUBLE))) AS cnt
  FROM b),
u AS (
  SELECT doc_id, s, n,
         list_transform(cnt, lambda v: CASE WHEN sqrt(list_dot_product(v, v)) > 0
                                            THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))
                                            ELSE list_transform(v, lambda x: 0.0) END) AS u
  FROM c),
d AS (
  SELECT doc_id, s, n,
         list_transform(range(1, n), lambda i: round(1.0 - CASE
             WHEN sqrt(list_dot_product(u[i], u[i])) > 0 AND sqrt(list_dot_product(u[i + 1], u[i + 1])) > 0
             THEN list_dot_product(u[i], u[i + 1]) / (sqrt(list_dot_product(u[i], u[i])) * sqrt(list_dot_product(u[i + 1], u[i + 1])))
             ELSE 0.0 END, 9)) AS dist
  FROM u),
t AS (
  SELECT doc_id, s, n, dist, srt, m, 0.5 * (m - 1) AS pos, CAST(floor(0.5 * (m - 1)) AS BIGINT) AS lo
  FROM (SELECT *, list_sort(dist) AS srt, len(dist) AS m FROM d)),
k AS (
  SELECT doc_id, s, n,
         list_filter(range(0, n - 1), lambda i: dist[i + 1] > srt[lo + 1] + (pos - lo) * (srt[least(lo + 2, m)] - srt[lo + 1])) AS brk
  FROM t),
g AS (
  SELECT doc_id, CASE WHEN n <= 1 THEN s ELSE list_transform(range(0, len(brk) + 1), lambda j: array_to_string(
             s[(CASE WHEN j = 0 THEN 0 ELSE brk[j] + 1 END) + 1 : (CASE WHEN j < len(brk) THEN brk[j + 1] ELSE n - 1 END) + 1], ' '))
         END AS chunks
  FROM k)
SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(i - 1 AS INTEGER) AS chunk_index,
       CAST(len(chunks) AS INTEGER) AS total_chunks, chunks[i] AS chunk_text
FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM g)"""


@query("chunk_semantic", "C7", SEMANTIC_SQL)
def chunk_semantic(spark, sf):
    """Semantic splitting with the built-in hashed embedder (also checked in the tests against a
    plain-Python version of the same steps)."""
    d = doc_files(spark, sf).withColumn("chunks", semantic_chunks(F.col("text")))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


@query("chunk_metadata", "C8", f"""
SELECT filename, chunk_index, total_chunks, filename AS source, '.txt' AS file_type FROM ({_windows_sql(512, 50)})""")
def chunk_metadata(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", window_chunks("text", 512, 50))
    r = explode_chunks(d, file_type=".txt")
    return r.select("filename", "chunk_index", "total_chunks", F.col("metadata.source").alias("source"),
                    F.col("metadata.file_type").alias("file_type"))


@query("encode_metadata", "C9", f"""
SELECT filename, chunk_index,
       CAST(to_json({{'source': filename, 'chunk_index': chunk_index, 'total_chunks': total_chunks, 'file_type': '.txt',
                 'processed_at': '{FIXED_TIME}'}}) AS VARCHAR) AS metadata
FROM ({_windows_sql(512, 50)})""")
def q_encode_metadata(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", window_chunks("text", 512, 50))
    r = explode_chunks(d, file_type=".txt", processed_at=FIXED_TIME)
    return r.select("filename", "chunk_index", encode_metadata("metadata").alias("metadata"))


@query("chunk_paragraph", "C10 (paragraphs)", f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(i - 1 AS INTEGER) AS chunk_index,
       CAST(len(p) AS INTEGER) AS total_chunks, p[i] AS chunk_text
FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i
      FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n+'), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p
            FROM documents))""")
def chunk_paragraph(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", paragraph_chunks(F.col("text")))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")


@query("chunk_tokens", "C10 (every 512 tokens)", f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, CAST(k AS INTEGER) AS chunk_index,
       CAST(nk AS INTEGER) AS total_chunks, array_to_string(t[k * 512 + 1 : k * 512 + 512], ' ') AS chunk_text
FROM (SELECT doc_id, t, nk, unnest(range(0, nk)) AS k
      FROM (SELECT doc_id, t, greatest(CAST(ceil(len(t) / 512.0) AS BIGINT), 1) AS nk
            FROM (SELECT doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> '') AS t FROM documents)))""")
def chunk_tokens(spark, sf):
    d = doc_files(spark, sf).withColumn("chunks", paragraph_chunks(F.col("text"), tokens=512))
    return explode_chunks(d).select("filename", "chunk_index", "total_chunks", "chunk_text")
