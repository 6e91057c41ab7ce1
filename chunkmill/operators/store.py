"""Chunk-store operators (T1-T7) and the ingestion job.

A store is a DataFrame ``id LONG, filename STRING, chunk_index INT, chunk_text STRING,
metadata STRING, created_at TIMESTAMP``; it lives as Parquet (see ``sources.store_io``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..fixed import MSG_ALREADY, MSG_EMPTY, MSG_NO_TEXT, MSG_PROCESSED, UPLOAD_STATUS
from ..functions.ordering import with_row_index
from ..functions.text import fill, has_text
from ..session import cut_lineage
from .chunking import chunk_with, encode_metadata, explode_chunks

MOST_KEY_WORDS = 1 << 20  # words of 64 keys that may be broadcast: some 30 MB

STORE_COLUMNS = ["id", "filename", "chunk_index", "chunk_text", "metadata", "created_at"]


def empty_store(spark) -> DataFrame:
    return spark.createDataFrame([], "id long, filename string, chunk_index int, chunk_text string, "
                                     "metadata string, created_at timestamp")


def append_chunks(store: DataFrame, chunks: DataFrame, order=("filename", "chunk_index"), created_at=None,
                  ids_from: DataFrame | None = None, clean=None) -> DataFrame:
    """Append chunk rows with new ids ``max(id) + 1, +2, ...`` in ``order`` and a creation time.

    ``ids_from`` is the store before any deletion (ids are never reused, like an autoincrement
    key). The offset is a scalar subquery; the ordinal comes from a range-partitioned index, never
    from a single-task ``row_number``. ``clean`` is applied to the numbered rows (before, it would run twice: a range
    partition evaluates its input for the sample of its keys, too)."""
    base = (ids_from if ids_from is not None else store).select(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    numbered = with_row_index(chunks, list(order), "_rn", start=1)
    if clean is not None:
        numbered = clean(numbered)
    new = numbered.select(
        (F.col("_rn") + base).cast("long").alias("id"), "filename", F.col("chunk_index").cast("int").alias("chunk_index"),
        "chunk_text", F.col("metadata").cast("string").alias("metadata"),
        (created_at if created_at is not None else F.current_timestamp()).cast("timestamp").alias("created_at"),
    )
    return store.select(*STORE_COLUMNS).unionByName(new)


def document_count(store: DataFrame) -> DataFrame:
    """Number of distinct filenames."""
    return store.agg(F.count_distinct("filename").alias("documents"))


def chunk_count(store: DataFrame) -> DataFrame:
    """Number of chunks."""
    return store.agg(F.count(F.lit(1)).alias("chunks"))


def processed_files(store: DataFrame) -> DataFrame:
    """T4: distinct filenames (as rows: the list can be as large as the store)."""
    return store.select("filename").distinct()


def document_exists(requests: DataFrame, store: DataFrame, key: str = "filename") -> DataFrame:
    """T5: every request row with ``exists`` (its name has chunks in the store)."""
    names = store.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return (requests.join(names, requests[key] == names["_k"], "left")
            .withColumn("exists", F.coalesce(F.col("_hit"), F.lit(False))).drop("_k", "_hit"))


def delete_documents(store: DataFrame, names: DataFrame, key: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(store without the named files, one-row count of deleted chunks)."""
    names = names.select(key).distinct()
    remaining = store.join(names, key, "left_anti")
    deleted = store.join(names, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return remaining, deleted


def chunk_view(store: DataFrame) -> DataFrame:
    """Reader view ``id, content, source, chunk_index, metadata`` (ordered by id on demand)."""
    return store.select("id", F.col("chunk_text").alias("content"), F.col("filename").alias("source"),
                        "chunk_index", "metadata")


# ----------------------------------------------------------------------------------------------
# Ingestion
# ----------------------------------------------------------------------------------------------

def validate_text(files: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """``valid`` flag and failure ``message`` per file (null/empty text, then blank text)."""
    t = F.col(text)
    msg = (F.when(t.isNull() | (F.length(t) == 0), fill(MSG_NO_TEXT, filename))
           .when(~has_text(t), fill(MSG_EMPTY, filename)))
    return files.withColumn("message", msg).withColumn("valid", F.col("message").isNull())


def verdicts(files: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """I2-I4 on narrow rows ``input_order, filename, message`` (null message: a valid file): adds ``ok`` (the file counts as
    processed) and ``insert`` (its chunks go into the store). ``stored`` holds the store's file names.

    Without ``overwrite`` a name already stored, or produced by an earlier valid file of the batch, is
    rejected (I2); with ``overwrite`` every valid file succeeds and the last valid file of a name is the
    one that stays (I3). Names are combined map-side, so a hot name is one row per task."""
    valid = F.col("message").isNull()
    pick = F.max if overwrite else F.min
    best = files.where(valid).groupBy("filename").agg(pick("input_order").alias("_win"))
    out = files.join(best, "filename", "left")
    first = valid & (F.col("input_order") == F.col("_win"))
    if overwrite:
        return out.withColumns({"ok": valid, "insert": first}).drop("_win")
    known = stored.select("filename").distinct().withColumn("_stored", F.lit(True))
    out = out.join(known, "filename", "left").withColumn("ok", first & F.col("_stored").isNull())
    return out.withColumn("insert", F.col("ok")).drop("_win", "_stored")


def with_rows(df: DataFrame, key: str, wanted: DataFrame, by: tuple = (), most_words: int = MOST_KEY_WORDS) -> DataFrame:
    """Rows of ``df`` whose integral ``key`` (within the columns ``by``) is in ``wanted``.

    The wanted keys become a bitmap of 64 keys a word. Up to ``most_words`` words it is broadcast, so the rows, which carry
    the texts, are not shuffled; beyond that the rows are joined with the keys by a shuffle."""
    if not isinstance(df.schema[key].dataType, (LongType, IntegerType)):
        return df.join(wanted.select(*by, key).distinct(), [*by, key], "left_semi")
    k = F.col(key).cast("long")
    words = wanted.groupBy(*by, F.shiftright(k, 6).alias("_word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({key} & 63 as int)))").alias("_bits"))
    words = cut_lineage(words)
    if words.count() > most_words:
        return df.join(wanted.select(*by, key).distinct(), [*by, key], "left_semi")
    hit = F.expr(f"(shiftright(_bits, cast({key} & 63 as int)) & 1) = 1")
    return df.withColumn("_word", F.shiftright(k, 6)).join(F.broadcast(words), [*by, "_word"]).where(hit).select(*df.columns)


def ingest_details(verdict: DataFrame, counts: DataFrame, key: str = "input_order") -> DataFrame:
    """I4: ``input_order, filename, success, message, chunks`` from verdicts and the chunk counts ``key, chunks`` of processed files."""
    j = verdict.join(counts.select(key, F.col("chunks").alias("_n")), key, "left")
    n = F.coalesce("_n", F.lit(0)).cast("int")
    msg = F.when(F.col("ok"), fill(MSG_PROCESSED, "filename", n)).otherwise(F.coalesce("message", fill(MSG_ALREADY, "filename")))
    return j.select("input_order", "filename", F.col("ok").alias("success"), msg.alias("message"),
                    F.when(F.col("ok"), n).otherwise(F.lit(0)).alias("chunks"))


def ingest(files: DataFrame, store: DataFrame, overwrite: bool = False, splitter: str = "recursive",
           created_at=None, processed_at=None, build_store: bool = True, **split_kw) -> tuple[DataFrame, DataFrame | None]:
    """Process a batch ``input_order, filename, text, file_type`` into ``store``.

    Returns ``(details, new_store)``; with ``build_store=False`` only the details are planned (the
    new store needs a numbering pass). The verdict on every file is reached over narrow rows
    (name, order, message) and kept; texts are then fetched for accepted files only, split once,
    and details and store rows both come from those chunks."""
    checked = validate_text(files).select("input_order", "filename", "message")
    verdict = cut_lineage(verdicts(checked, store.select("filename"), overwrite))
    accepted = with_rows(files, "input_order", verdict.where("ok").select("input_order"))
    chunked = chunk_with(accepted, "text", splitter, **split_kw)
    if not build_store:
        return ingest_details(verdict, chunked.select("input_order", F.size("chunks").alias("chunks"))), None
    rows = explode_chunks(chunked, "chunks", "filename", file_type=F.col("file_type"), processed_at=processed_at,
                          keep=["input_order"])
    rows = cut_lineage(rows.withColumn("metadata", encode_metadata("metadata")))
    details = ingest_details(verdict, rows.groupBy("input_order").agg(F.count(F.lit(1)).alias("chunks")))
    kept = store
    if overwrite:
        rows = with_rows(rows, "input_order", verdict.where("insert").select("input_order"))
        kept = store.join(verdict.where("insert").select("filename").distinct(), "filename", "left_anti")
    # ids in insertion order: files in input order, chunks in order
    return details, append_chunks(kept, rows, order=("input_order", "chunk_index"), created_at=created_at,
                                  ids_from=store)


def ingest_summary(details: DataFrame) -> DataFrame:
    """Totals of a batch."""
    return details.agg(F.count(F.lit(1)).alias("total_files"),
                       F.count_if("success").alias("successful"),
                       F.count_if(~F.col("success")).alias("failed"),
                       F.coalesce(F.sum(F.when(F.col("success"), F.col("chunks"))), F.lit(0)).alias("total_chunks"))


def upload_status(uploads: DataFrame, details: DataFrame) -> DataFrame:
    """Upload list ``upload_order, name, path`` with status and chunks from the first detail
    of the same name; unmatched uploads stay ``Uploaded`` with 0 chunks."""
    first = details.groupBy("filename").agg(F.min(F.struct("input_order", "success", "chunks")).alias("d"))
    j = uploads.join(first, uploads["name"] == first["filename"], "left")
    return j.select("upload_order", "name", "path",
                    F.when(F.col("d").isNull(), F.lit(UPLOAD_STATUS[0]))
                    .when(F.col("d.success"), F.lit(UPLOAD_STATUS[1])).otherwise(F.lit(UPLOAD_STATUS[2])).alias("status"),
                    F.coalesce(F.col("d.chunks"), F.lit(0)).cast("int").alias("chunks"))


def store_stats(store: DataFrame) -> DataFrame:
    """Documents, chunks and size in MB (UTF-8 bytes of text and metadata, 2 decimals).
    The file list is ``processed_files`` (rows), not an array in one row."""
    return store.agg(
        F.count_distinct("filename").alias("total_documents"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.round(F.coalesce(F.sum(F.octet_length("chunk_text") + F.coalesce(F.octet_length("metadata"), F.lit(0))),
                           F.lit(0)) / 1048576.0, 2).alias("size_mb"))
