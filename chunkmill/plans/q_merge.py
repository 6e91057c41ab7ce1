"""Queries for importing and merging stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.merge import (import_as_new_store, import_counts, import_merge, import_replace, list_stores,
                               merge_dedup_content, merge_renumbered, merge_stores, merge_totals, metadata_or_empty, missing_stores,
                               store_catalogue, store_sources)
from .fixtures import chunk_store, store_sql, stores_union, stores_union_sql, table
from .registry import query

A, B = store_sql("A"), store_sql("B")
U = stores_union_sql()


def registry(spark, sf):
    return stores_union(spark, sf).select(F.col("store_rank").cast("long").alias("ordinal"), "store").distinct()


@query("import_merge", "M1", f"""
WITH a AS ({A}), b AS ({B})
SELECT id, filename, chunk_index, chunk_text FROM a
UNION ALL
SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY id), filename, chunk_index, chunk_text
FROM b WHERE filename NOT IN (SELECT filename FROM a)""")
def q_import_merge(spark, sf):
    out = import_merge(chunk_store(spark, sf, "A"), chunk_store(spark, sf, "B"))
    return out.select("id", "filename", "chunk_index", "chunk_text")


@query("import_replace", "M2", f"""
SELECT row_number() OVER (ORDER BY id) AS id, filename, chunk_index, chunk_text FROM ({B})""")
def q_import_replace(spark, sf):
    out = import_replace(chunk_store(spark, sf, "A"), chunk_store(spark, sf, "B"))
    return out.select("id", "filename", "chunk_index", "chunk_text")


@query("import_counts", "M3", f"""
WITH a AS ({A}), b AS ({B}),
c AS (SELECT count(*) FILTER (WHERE filename NOT IN (SELECT filename FROM a)) AS imported,
             count(*) FILTER (WHERE filename IN (SELECT filename FROM a)) AS skipped FROM b)
SELECT imported, skipped,
       'Successfully imported ' || CAST(imported AS VARCHAR) || ' chunks' ||
       CASE WHEN skipped > 0 THEN ' (skipped ' || CAST(skipped AS VARCHAR) || ' duplicate chunks)' ELSE '' END AS message
FROM c""")
def q_import_counts(spark, sf):
    return import_counts(chunk_store(spark, sf, "A"), chunk_store(spark, sf, "B"))


META_LITERALS = [(-1, None), (-2, ""), (-3, "not json"), (-4, '{"a": [1, 2], "b": {"c": null}}'), (-5, "[1,2]"),
                 (-6, '"str"'), (-7, '{"a":1} x'), (-8, "{'a': 1}")]


@query("metadata_or_empty", "M4", """
WITH m AS (SELECT event_id, props FROM events
           UNION ALL SELECT * FROM (VALUES (-1, NULL), (-2, ''), (-3, 'not json'), (-4, '{"a": [1, 2], "b": {"c": null}}'),
                                           (-5, '[1,2]'), (-6, '"str"'), (-7, '{"a":1} x'), (-8, '{''a'': 1}')) t(event_id, props))
SELECT event_id, CASE WHEN props IS NOT NULL AND props <> '' AND json_valid(props) THEN CAST(json(props) AS VARCHAR) ELSE '{}' END AS meta
FROM m""")
def q_metadata(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "props")
    lit = spark.createDataFrame(META_LITERALS, "event_id long, props string")
    return ev.unionByName(lit).select("event_id", F.to_json(metadata_or_empty("props")).alias("meta"))


@query("merge_stores", "M5", f"""
SELECT store, filename, chunk_index, chunk_text FROM (
  SELECT *, min(store_rank) OVER (PARTITION BY filename) AS best FROM ({U})) WHERE store_rank = best""")
def q_merge(spark, sf):
    return merge_stores(stores_union(spark, sf)).select("store", "filename", "chunk_index", "chunk_text")


BAD_META = "CASE WHEN chunk_index % 3 = 1 THEN substring(metadata, 1, 20) WHEN chunk_index % 3 = 2 THEN NULL ELSE metadata END"


@query("merge_renumbered", "M5 (new ids, clean metadata)", f"""
WITH u AS ({U}), best AS (SELECT filename, min(store_rank) AS store_rank FROM u GROUP BY filename),
k AS (SELECT u.* FROM u JOIN best USING (filename, store_rank))
SELECT row_number() OVER (ORDER BY store_rank, id) AS id, id AS old_id, store, filename, chunk_index,
       CASE WHEN chunk_index % 3 = 0 THEN metadata ELSE '{{}}' END AS metadata
FROM k""")
def q_merge_renumbered(spark, sf):
    stores = stores_union(spark, sf).withColumn("metadata", F.expr(BAD_META))  # two of three chunks hold damaged metadata
    return merge_renumbered(stores).select("id", "old_id", "store", "filename", "chunk_index", "metadata")


@query("merge_totals", "M5 (totals)", f"""
SELECT documents, chunks, 'Successfully merged ' || CAST(documents AS VARCHAR) || ' documents (' || CAST(chunks AS VARCHAR) || ' chunks)' AS message
FROM (SELECT count(DISTINCT filename) AS documents, count(*) AS chunks FROM (
  SELECT *, min(store_rank) OVER (PARTITION BY filename) AS best FROM ({U})) WHERE store_rank = best)""")
def q_merge_totals(spark, sf):
    return merge_totals(merge_stores(stores_union(spark, sf)))


@query("merge_dedup_content", "M6", f"""
SELECT store AS original_db, id, filename, chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_text ORDER BY store_rank, id) AS rn FROM ({U})) WHERE rn = 1""")
def q_dedup(spark, sf):
    return merge_dedup_content(stores_union(spark, sf)).select("original_db", "id", "filename", "chunk_index")


@query("list_stores", "M7", f"""
SELECT -1 AS ordinal, 'wissensbasis' AS store UNION ALL SELECT DISTINCT CAST(store_rank AS BIGINT), store FROM ({U})""")
def q_list_stores(spark, sf):
    return list_stores(registry(spark, sf))


@query("store_catalogue", "M8", f"""
SELECT store, count(*) AS chunks, CAST(sum(octet_length(encode(chunk_text))) AS BIGINT) AS bytes, count(DISTINCT filename) AS sources
FROM ({U}) GROUP BY store""")
def q_catalogue(spark, sf):
    return store_catalogue(stores_union(spark, sf))


@query("store_sources", "M8 I7", f"""
SELECT store, filename AS source, count(*) AS chunks FROM ({U}) GROUP BY store, filename""")
def q_sources(spark, sf):
    return store_sources(stores_union(spark, sf))


@query("missing_stores", "M9", f"""
SELECT store FROM (VALUES ('A'), ('C'), ('Z')) r(store) WHERE store NOT IN (SELECT store FROM ({U}))""")
def q_missing(spark, sf):
    req = spark.createDataFrame([("A",), ("C",), ("Z",)], "store string")
    return missing_stores(req, registry(spark, sf))


@query("import_as_new_store", "M10", f"""
SELECT 'D' AS store, true AS ok,
       'Success: Database ''D'' imported!' || chr(10) || chr(10) || 'Documents: ' || CAST(count(DISTINCT filename) AS VARCHAR)
       || chr(10) || 'Chunks: ' || CAST(count(*) AS VARCHAR) AS message,
       count(DISTINCT filename) AS documents, count(*) AS chunks
FROM ({A})""")
def q_import_new(spark, sf):
    _, rep = import_as_new_store(stores_union(spark, sf), registry(spark, sf), "A", "D")
    return rep
