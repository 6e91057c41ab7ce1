"""Queries for the chunk store (T1-T7) and the ingestion job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.store import (append_chunks, chunk_count, chunk_view, delete_documents, document_count,
                               document_exists, ingest, ingest_summary, processed_files, store_stats,
                               upload_status, validate_text)
from ..operators.chunking import encode_metadata, explode_chunks, window_chunks
from ..operators.merge import import_merge
from ..session import scratch_path
from ..sources import log_store
from ..sources.store_io import read_store
from .fixtures import FIXED_TIME, NON_WS_SQL, chunk_store, doc_files, store_sql, table, windows_sql
from .registry import query

A, B, C = store_sql("A"), store_sql("B"), store_sql("C")

# ---------------------------------------------------------------------------------------------- T


@query("append_chunks", "T1", f"""
WITH a AS ({A}), b AS ({B})
SELECT id, filename, chunk_index FROM a
UNION ALL
SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY filename, chunk_index) AS id, filename, chunk_index FROM b""")
def q_append(spark, sf):
    a, b = chunk_store(spark, sf, "A"), chunk_store(spark, sf, "B")
    out = append_chunks(a, b.drop("id", "created_at"), created_at=F.lit(FIXED_TIME))
    return out.select("id", "filename", "chunk_index")


@query("document_count", "T2", f"SELECT count(DISTINCT filename) AS documents FROM ({C})")
def q_doc_count(spark, sf):
    return document_count(chunk_store(spark, sf, "C"))


@query("chunk_count", "T3", f"SELECT count(*) AS chunks FROM ({C})")
def q_chunk_count(spark, sf):
    return chunk_count(chunk_store(spark, sf, "C"))


@query("processed_files", "T4", f"SELECT DISTINCT filename FROM ({A})")
def q_processed(spark, sf):
    return processed_files(chunk_store(spark, sf, "A"))


@query("document_exists", "T5", f"""
WITH a AS ({A}), r AS (SELECT DISTINCT filename FROM ({B}))
SELECT filename, filename IN (SELECT filename FROM a) AS "exists" FROM r""")
def q_exists(spark, sf):
    req = chunk_store(spark, sf, "B").select("filename").distinct()
    return document_exists(req, chunk_store(spark, sf, "A"))


@query("delete_document", "T6", f"""
SELECT id, filename, chunk_index FROM ({C}) WHERE filename NOT IN (SELECT filename FROM ({B}))""")
def q_delete(spark, sf):
    remaining, _ = delete_documents(chunk_store(spark, sf, "C"), chunk_store(spark, sf, "B").select("filename"))
    return remaining.select("id", "filename", "chunk_index")


@query("delete_document_count", "T6 (count)", f"""
SELECT count(*) AS deleted FROM ({C}) WHERE filename IN (SELECT filename FROM ({B}))""")
def q_delete_count(spark, sf):
    _, deleted = delete_documents(chunk_store(spark, sf, "C"), chunk_store(spark, sf, "B").select("filename"))
    return deleted


@query("chunk_view", "T7", f"SELECT id, chunk_text AS content, filename AS source, chunk_index, metadata FROM ({C})")
def q_view(spark, sf):
    return chunk_view(chunk_store(spark, sf, "C"))


# ---------------------------------------------------------------------------------------------- I
# The batch: every document uploaded twice (the second copy repeats each name) plus three files
# whose text is missing, empty or blank. The target store is A (languages en and fr).

SECOND = 1 << 40
BATCH_SQL = f"""
SELECT doc_id AS input_order, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, text FROM documents
UNION ALL SELECT doc_id + {SECOND}, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt', text FROM documents
UNION ALL SELECT * FROM (VALUES (-1, 'empty_1.txt', ''), (-2, 'null_1.txt', NULL),
                                (-3, 'blank_1.txt', ' ' || chr(10) || chr(9) || ' ')) t(input_order, filename, text)"""

VALID_SQL = f"""
SELECT *, CASE WHEN text IS NULL OR length(text) = 0 THEN 'Could not extract text from ' || filename
               WHEN NOT regexp_matches(text, '{NON_WS_SQL}') THEN 'File ' || filename || ' is empty' END AS bad
FROM ({BATCH_SQL})"""


def batch(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    first = d.select(F.col("doc_id").alias("input_order"), name.alias("filename"), "text")
    again = d.select((F.col("doc_id") + SECOND).alias("input_order"), name.alias("filename"), "text")
    odd = spark.createDataFrame([(-1, "empty_1.txt", ""), (-2, "null_1.txt", None), (-3, "blank_1.txt", " \n\t ")],
                                "input_order long, filename string, text string")
    return first.unionByName(again).unionByName(odd).withColumn("file_type", F.lit(".txt"))


def _ingest(spark, sf, overwrite=False, build_store=False):
    return ingest(batch(spark, sf), chunk_store(spark, sf, "A"), overwrite=overwrite, splitter="window",
                  created_at=F.lit(FIXED_TIME), processed_at=FIXED_TIME, build_store=build_store, size=512, overlap=50)


DETAILS_SQL = f"""
WITH a AS ({A}), v AS ({VALID_SQL}),
ok AS (SELECT input_order, filename, text,
              input_order = min(input_order) OVER (PARTITION BY filename)
              AND filename NOT IN (SELECT filename FROM a) AS okf
       FROM v WHERE bad IS NULL),
cnt AS (SELECT ord AS input_order, count(*) AS n FROM ({windows_sql("SELECT input_order AS ord, filename, text FROM ok WHERE okf", 512, 50)}) GROUP BY ord)
SELECT ok.input_order, ok.filename, okf AS success,
       CASE WHEN okf THEN 'Successfully processed ' || ok.filename || ': ' || CAST(cnt.n AS VARCHAR) || ' chunks'
            ELSE 'File ' || ok.filename || ' already processed (use overwrite=True to reprocess)' END AS message,
       CAST(CASE WHEN okf THEN cnt.n ELSE 0 END AS INTEGER) AS chunks
FROM ok LEFT JOIN cnt ON ok.input_order = cnt.input_order
UNION ALL
SELECT input_order, filename, false, bad, 0 FROM v WHERE bad IS NOT NULL"""


@query("validate_text", "I1", f"SELECT input_order, filename, bad IS NULL AS valid, bad AS message FROM ({VALID_SQL})")
def q_validate(spark, sf):
    return validate_text(batch(spark, sf)).select("input_order", "filename", "valid", "message")


@query("skip_processed", "I2", f"SELECT input_order, filename, message FROM ({DETAILS_SQL}) WHERE message LIKE '%already processed%'")
def q_skip(spark, sf):
    details, _ = _ingest(spark, sf)
    return details.where(F.col("message").contains("already processed")).select("input_order", "filename", "message")


@query("ingest_details", "I4", DETAILS_SQL)
def q_details(spark, sf):
    details, _ = _ingest(spark, sf)
    return details


@query("ingest_summary", "I5", f"""
SELECT count(*) AS total_files, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
       CAST(coalesce(sum(chunks) FILTER (WHERE success), 0) AS BIGINT) AS total_chunks
FROM ({DETAILS_SQL})""")
def q_summary(spark, sf):
    details, _ = _ingest(spark, sf)
    return ingest_summary(details)


@query("ingest_store", "I2+T1 (store after a batch)", f"""
WITH a AS ({A}), d AS ({DETAILS_SQL}),
ok AS (SELECT b.input_order AS ord, b.filename, b.text FROM ({BATCH_SQL}) b JOIN d ON b.input_order = d.input_order WHERE d.success),
n AS ({windows_sql("SELECT * FROM ok", 512, 50)})
SELECT id, filename, chunk_index, chunk_text FROM a
UNION ALL
SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY ord, chunk_index), filename, chunk_index, chunk_text FROM n""")
def q_ingest_store(spark, sf):
    _, store = _ingest(spark, sf, build_store=True)
    return store.select("id", "filename", "chunk_index", "chunk_text")


@query("overwrite_documents", "I3", f"""
WITH a AS ({A}), v AS ({VALID_SQL}),
win AS (SELECT input_order AS ord, filename, text FROM
        (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY input_order DESC) AS rn FROM v WHERE bad IS NULL) WHERE rn = 1),
n AS ({windows_sql("SELECT * FROM win", 512, 50)})
SELECT id, filename, chunk_index, chunk_text FROM a WHERE filename NOT IN (SELECT filename FROM win)
UNION ALL
SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY ord, chunk_index), filename, chunk_index, chunk_text FROM n""")
def q_overwrite(spark, sf):
    _, store = _ingest(spark, sf, overwrite=True, build_store=True)
    return store.select("id", "filename", "chunk_index", "chunk_text")


@query("upload_status", "I6", f"""
WITH d AS ({DETAILS_SQL}),
f AS (SELECT filename, arg_min(success, input_order) AS success, arg_min(chunks, input_order) AS chunks FROM d GROUP BY filename),
u AS (SELECT input_order AS upload_order, filename AS name, '/uploads/' || filename AS path FROM ({BATCH_SQL})
      UNION ALL SELECT -10, 'never_processed.txt', '/uploads/never_processed.txt')
SELECT upload_order, name, path,
       CASE WHEN f.filename IS NULL THEN 'Uploaded' WHEN f.success THEN 'Processed' ELSE 'Failed' END AS status,
       CAST(coalesce(f.chunks, 0) AS INTEGER) AS chunks
FROM u LEFT JOIN f ON u.name = f.filename""")
def q_upload(spark, sf):
    details, _ = _ingest(spark, sf)
    b = batch(spark, sf)
    uploads = b.select(F.col("input_order").alias("upload_order"), F.col("filename").alias("name"),
                       F.concat(F.lit("/uploads/"), F.col("filename")).alias("path"))
    extra = spark.createDataFrame([(-10, "never_processed.txt", "/uploads/never_processed.txt")],
                                  "upload_order long, name string, path string")
    return upload_status(uploads.unionByName(extra), details)


@query("store_stats", "I7", f"""
SELECT count(DISTINCT filename) AS total_documents, count(*) AS total_chunks,
       round(coalesce(sum(octet_length(encode(chunk_text)) + coalesce(octet_length(encode(metadata)), 0)), 0) / 1048576.0, 2) AS size_mb
FROM ({C})""")
def q_stats(spark, sf):
    return store_stats(chunk_store(spark, sf, "C"))


# ---------------------------------------------------------------------------------------------- log-structured store


def _log_of(spark, *stores):
    """A log-structured store of the given rows, one commit each: the first with its own ids, the others appended."""
    root = scratch_path(spark, "log-store")
    state = log_store.publish(spark, root, stores[0])
    for rows in stores[1:]:
        state = log_store.append(spark, root, rows, state)
    return root, state


@query("log_append", "T1, S10 on the log-structured store", f"""
WITH a AS ({A}), b AS ({B})
SELECT id, filename, chunk_index, chunk_text, metadata FROM a
UNION ALL
SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY filename, chunk_index) AS id, filename, chunk_index, chunk_text, metadata FROM b""")
def q_log_append(spark, sf):
    root, _ = _log_of(spark, chunk_store(spark, sf, "A").drop("row_no"), chunk_store(spark, sf, "B").drop("id", "created_at", "row_no"))
    return read_store(spark, root, ["id", "filename", "chunk_index", "chunk_text", "metadata"])


GONE_SQL = f"SELECT filename FROM ({B}) WHERE filename LIKE '%3.txt'"


def _with_deletes(spark, sf):
    root, _ = _log_of(spark, chunk_store(spark, sf, "C").drop("row_no"))
    gone = chunk_store(spark, sf, "B").where("filename LIKE '%3.txt'").select("filename")
    return root, *log_store.delete(spark, root, gone)


@query("log_delete", "T6 on pending bitmaps", f"SELECT id, filename, chunk_index, chunk_text FROM ({C}) WHERE filename NOT IN ({GONE_SQL})")
def q_log_delete(spark, sf):
    root, _, _ = _with_deletes(spark, sf)
    return read_store(spark, root, ["id", "filename", "chunk_index", "chunk_text"])


@query("log_compact", "T6 after a compaction", f"""
SELECT id, filename, chunk_index, chunk_text FROM ({C}) WHERE filename NOT IN ({GONE_SQL})""")
def q_log_compact(spark, sf):
    root, _, _ = _with_deletes(spark, sf)
    return log_store.read(spark, log_store.compact(spark, root, share=0.0)).select("id", "filename", "chunk_index", "chunk_text")


@query("log_page", "B1 over pending deletes", f"""
SELECT id, filename, chunk_index, CASE WHEN length(chunk_text) > 100 THEN substring(chunk_text, 1, 100) || '...' ELSE chunk_text END AS preview
FROM (SELECT *, row_number() OVER (ORDER BY filename, chunk_index) AS rn FROM ({C}) WHERE filename NOT IN ({GONE_SQL}))
WHERE rn > 500 AND rn <= 1000""")
def q_log_page(spark, sf):
    _, state, _ = _with_deletes(spark, sf)
    return log_store.page(spark, state, 2, 500)


@query("log_import_merge", "M1 into a store with pending deletes", f"""
WITH t AS (SELECT * FROM ({C}) WHERE filename NOT IN ({GONE_SQL})), b AS ({B})
SELECT id, filename, chunk_index FROM t
UNION ALL
SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY id), filename, chunk_index FROM b WHERE filename NOT IN (SELECT filename FROM t)""")
def q_log_import(spark, sf):
    root, _, _ = _with_deletes(spark, sf)
    return import_merge(read_store(spark, root), chunk_store(spark, sf, "B")).select("id", "filename", "chunk_index")


@query("log_overwrite", "I3 in one commit on the log-structured store", f"""
WITH n AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, doc_id AS ord, text FROM documents WHERE lang = 'fr'),
w AS ({windows_sql("SELECT ord, filename, text FROM n", 300, 30)})
SELECT filename, chunk_index, chunk_text FROM ({A}) WHERE filename NOT IN (SELECT filename FROM n)
UNION ALL SELECT filename, chunk_index, chunk_text FROM w""")
def q_log_overwrite(spark, sf):
    root, state = _log_of(spark, chunk_store(spark, sf, "A").drop("row_no"))
    docs = doc_files(spark, sf).where("lang = 'fr'").withColumn("chunks", window_chunks("text", 300, 30))
    rows = explode_chunks(docs, keep=["doc_id"]).withColumn("metadata", encode_metadata("metadata")).withColumnRenamed("doc_id", "doc")
    state = log_store.replace_documents(spark, root, rows, docs.select("filename"), state)
    return log_store.read(spark, state).select("filename", "chunk_index", "chunk_text")
