"""Streaming queries (X1, X2): same results as the batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.ingest import progress_done, stream_details, stream_ingest, stream_progress
from .fixtures import windows_sql
from .registry import query

WINDOWS = windows_sql("SELECT doc_id AS ord, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, text FROM documents", 512, 50)


@query("stream_ingest", "X1", f"""
SELECT row_number() OVER (ORDER BY ord, chunk_index) AS id, filename, chunk_index, chunk_text FROM ({WINDOWS})""")
def q_stream_ingest(spark, sf):
    store = scratch_path(spark, "stream-store")
    out = stream_ingest(spark, f"{sf.rstrip('/')}/documents.parquet", store, size=512, overlap=50, ordered=True)
    return out.select("id", "filename", "chunk_index", "chunk_text")


@query("stream_ingest_details", "X1, I4: a row for every file that arrived, also blank, empty and repeated ones", f"""
WITH f AS (
  SELECT doc_id * 10 AS ord, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS name, text FROM documents
  UNION ALL SELECT doc_id * 10 + 1, 'doc_' || CAST(doc_id * 10 + 1 AS VARCHAR) || '.txt',
                   CASE WHEN doc_id % 2 = 0 THEN NULL ELSE '  ' END FROM documents WHERE lang = 'de'),
n AS (SELECT 'doc_' || CAST(ord AS VARCHAR) || '.txt' AS filename, ord AS input_order, text FROM f),
c AS (SELECT ord, count(*) AS chunks FROM ({windows_sql("SELECT input_order AS ord, filename, text FROM n", 512, 50)}) GROUP BY ord)
SELECT input_order, filename, chunks IS NOT NULL AS success,
       CASE WHEN chunks IS NOT NULL THEN 'Successfully processed ' || filename || ': ' || CAST(chunks AS VARCHAR) || ' chunks'
            WHEN text IS NULL THEN 'Could not extract text from ' || filename ELSE 'File ' || filename || ' is empty' END AS message,
       CAST(coalesce(chunks, 0) AS INTEGER) AS chunks
FROM n LEFT JOIN c ON ord = input_order""")
def q_stream_details(spark, sf):
    docs = spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet")
    own = F.struct((F.col("doc_id") * 10).alias("doc_id"), "text")
    blank = F.struct((F.col("doc_id") * 10 + 1).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("  ")).alias("text"))
    files = scratch_path(spark, "stream-files")
    # one pass: a file per split of the table, not one more for its blank rows
    docs.select(F.inline(F.when(F.col("lang") == "de", F.array(own, blank)).otherwise(F.array(own)))).write.parquet(files)
    store = scratch_path(spark, "stream-store")
    stream_ingest(spark, files, store, max_files_per_trigger=2, size=512, overlap=50)
    return stream_details(spark, store)


@query("stream_progress", "X2", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def q_stream_progress(spark, sf):
    return stream_progress(spark, f"{sf.rstrip('/')}/events.parquet", "event_type", scratch_path(spark, "progress"))


@query("stream_progress_done", "X2, P5", "SELECT count(*) AS done, count(*) AS total, CAST(1.0 AS DOUBLE) AS share FROM events")
def q_stream_progress_done(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    counts = stream_progress(spark, path, "event_type", scratch_path(spark, "progress"))
    return progress_done(counts, spark.read.parquet(path).count())
