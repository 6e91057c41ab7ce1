"""Document folders to a chunk store: the file-level ingestion job.

``list files -> route by suffix (S1) -> extract per format (S2-S5, S9) -> validate (I1) -> skip or
replace stored names (I2/I3) -> chunk (C1/C2/C7) -> metadata (C8) -> append one folder (T1) -> commit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import MSG_NOT_FOUND
from ..operators.chunking import chunk_with, encode_metadata, explode_chunks
from ..operators.store import empty_store, ingest_details, ingest_summary, validate_text, verdicts, with_rows
from ..functions.text import decode_lenient, fill, normalize_newlines
from ..session import cut_lineage, range_partitioned, scratch_path
from ..sources import log_store
from ..sources.extract import (csv_file_to_text, flatten_json_to_text, html_to_text, notebook_to_text,
                               route_by_extension, suffix)
from ..sources.store_io import current_version, read_store


def _norm_path(c):
    return F.regexp_replace(c, "^file:/+", "/")


def extract_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``input_order, path, filename, file_type, loader, text`` for every file under ``path``;
    ``text`` is null when the format is unsupported (pdf, docx, xlsx need an upstream codec) or
    the content cannot be read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(_norm_path(F.col("path")).alias("path"), "content"))
    files = files.select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), suffix("path", lower=False).alias("file_type"),
        route_by_extension("path").alias("loader"), "content")
    # bytes that are not UTF-8 are dropped from texts; a JSON file or notebook that holds any fails alone
    lenient, raw = decode_lenient(F.col("content")), F.try_validate_utf8(F.col("content").cast("string"))
    text = (F.when(F.col("loader") == "text", normalize_newlines(lenient))
            .when(F.col("loader") == "html", html_to_text(normalize_newlines(lenient)))
            .when(F.col("loader") == "notebook", notebook_to_text(raw))
            .when(F.col("loader") == "csv", csv_file_to_text(lenient)))
    base = files.select("path", "filename", "file_type", "loader", text.alias("text"), raw.alias("_raw"))
    keep = ["path", "filename", "file_type", "loader"]
    js = base.where(F.col("loader") == "json")
    js_text = flatten_json_to_text(js.select("path", "_raw"), "path", "_raw")
    out = base.where(F.col("loader").isNull() | (F.col("loader") != "json")).drop("_raw")
    out = out.unionByName(js.select(*keep).join(js_text, "path", "left"))
    return out.withColumn("input_order", F.col("path"))


def requested_files(spark: SparkSession, path: str, requested: DataFrame, most_paths: int = 10_000) -> DataFrame:
    """``extract_files`` of those requested paths that exist under ``path``: the folder is listed without reading any
    content, then only the requested files are opened (up to ``most_paths`` by name, more by a join)."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
              .select(_norm_path(F.col("path")).alias("path")))
    found = listed.join(requested.select(_norm_path(F.col("path")).alias("path")).distinct(), "path", "left_semi")
    paths = [r["path"] for r in found.limit(most_paths + 1).collect()]
    if not paths:
        return extract_files(spark, path).limit(0)
    if len(paths) <= most_paths:
        return extract_files(spark, paths)
    return extract_files(spark, path).join(found, "path", "left_semi")


def process_documents(spark: SparkSession, path: str, store_root: str | None = None, overwrite: bool = False,
                      splitter: str = "recursive", requested: DataFrame | None = None, ordered: bool = False,
                      **split_kw) -> tuple[DataFrame, DataFrame]:
    """Process every file under ``path``, or the ``requested`` ones (``input_order, path``; a path that doesn't exist
    gets its own failure row), into the log-structured store at ``store_root``. Returns ``(details, summary)``;
    ``details`` has one row per file.

    Texts are extracted once, into a scratch table; verdicts come from its narrow columns and the store's side
    table of names; accepted texts are split once and written once, as one new folder of the store. What
    is read and written of the store depends on the batch and on the number of stored documents' names, never on
    stored chunks. Ids follow the order in which the folder is written; ``ordered`` puts the texts in input
    order first (one more shuffle). Files count as processed in path order, or in ``input_order``."""
    files = requested_files(spark, path, requested) if requested is not None else extract_files(spark, path)
    texts = scratch_path(spark, "extracted")
    validate_text(files).select(F.monotonically_increasing_id().alias("key"), "path", "filename", "file_type", "message",
                                F.when(F.col("valid"), F.col("text")).alias("text")).write.parquet(texts)
    docs = spark.read.parquet(texts)
    narrow = docs.select("key", "path", "filename", "message")
    if requested is not None:
        asked = requested.select("input_order", _norm_path(F.col("path")).alias("path"))
        narrow = asked.join(narrow.drop("filename"), "path", "left").withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
        narrow = narrow.withColumn("message", F.when(F.col("key").isNull(), fill(MSG_NOT_FOUND, "path")).otherwise(F.col("message")))
    else:
        narrow = narrow.withColumn("input_order", F.col("path"))
    base = stored = None
    if store_root:
        base = log_store.manifest(spark, store_root)
        if base is None and current_version(spark, store_root):
            base = log_store.publish(spark, store_root, read_store(spark, store_root).drop("row_no"))  # a store of versions
        base = base or log_store.Manifest(store_root.rstrip("/"))
        stored = log_store.filenames(spark, base)
    else:
        stored = empty_store(spark).select("filename")
    verdict = cut_lineage(verdicts(narrow, stored, overwrite).select("input_order", "key", "filename", "message", "ok", "insert"))
    picked = with_rows(docs, "key", verdict.where("ok").select("key"))
    if ordered:
        first = verdict.where("ok").groupBy("key").agg(F.min("input_order").alias("_order"))
        picked = range_partitioned(picked.join(first, "key"), ["_order"])
    chunked = chunk_with(picked, "text", splitter, **split_kw)
    if not store_root:
        details = ingest_details(verdict, chunked.select("key", F.size("chunks").alias("chunks")), "key")
        return details, ingest_summary(details)
    rows = explode_chunks(chunked, "chunks", "filename", file_type=F.col("file_type"), keep=["key"])
    rows = rows.withColumn("metadata", encode_metadata("metadata")).withColumnRenamed("key", "doc")
    if overwrite:
        inserted = verdict.where("insert")
        superseded = verdict.where("ok").select("key").join(inserted.select("key"), "key", "left_anti").withColumnRenamed("key", "doc")
        state = log_store.replace_documents(spark, store_root, rows, inserted.select("filename"), base, superseded)
    else:
        state = log_store.append(spark, store_root, rows, base)
    counts = log_store.batch_documents(spark, state).groupBy(F.col("doc").cast("long").alias("key")).agg(F.sum("chunks").alias("chunks"))
    details = ingest_details(verdict, counts, "key")
    return details, ingest_summary(details)
