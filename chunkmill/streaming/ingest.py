"""Streaming forms of ingestion (X1) and progress counting."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..fixed import MSG_ALREADY, MSG_EMPTY, MSG_NO_TEXT, MSG_PROCESSED
from ..operators.chunking import chunk_with, encode_metadata, explode_chunks
from ..operators.store import with_rows
from ..functions.text import fill, has_text
from ..session import range_partitioned, scratch_path
from ..sources import log_store
from ..sources.store_io import path_missing

COMPACT_EVERY = 10  # batches between two compactions of the store


def stream_path(path: str) -> str:
    """The file stream source watches folders or globs; a single table file is watched through a
    glob that matches just that file."""
    if path.endswith(".parquet") and "*" not in path and "[" not in path:
        return path[:-1] + "[" + path[-1] + "]"
    return path


# ---------------------------------------------------------------------------------------------- X1

_VERDICT = "input_order long, filename string, verdict string, path string, row long"


def _first_of_a_name(key, frames, state: GroupState):
    """The rule for one name, row by row; ``file_arrivals`` and ``batch_verdicts`` do the same without a Python call per name and
    are tested against it. The first valid file (by input order) of the first batch that has one is
    accepted; the state keeps that the name is taken. Holds one row, however many files share the name."""
    taken, best = state.exists, None
    cols = ["input_order", "filename", "verdict", "path", "row"]
    for pdf in frames:
        valid = pdf["verdict"] == "ok"
        if not taken and valid.any():
            i = pdf.loc[valid, "input_order"].idxmin()
            if best is None or pdf.at[i, "input_order"] < best["input_order"].iloc[0]:
                best, loser = pdf.loc[[i]], best
                pdf = pdf.drop(index=i)
                if loser is not None:
                    pdf = pd.concat([pdf, loser])
        yield pdf.assign(verdict=pdf["verdict"].where(pdf["verdict"] != "ok", "already"))[cols]
    if best is not None:
        state.update((True,))
        yield best[cols]


def file_arrivals(files: DataFrame) -> DataFrame:
    """A stream of the rows ``input_order, filename, verdict, path, row`` of ``files`` (``ok`` for any valid file) and, with ``fresh``
    set, a row for every name that has a valid file for the first time. The names are keyed state: a native
    deduplication over narrow rows. Both come from one source, so a batch holds a fresh name with its files."""
    fresh = files.where("verdict = 'ok'").select("filename").dropDuplicates(["filename"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _VERDICT.split(", ")) if c not in ("filename", "verdict")]
    fresh = fresh.select("filename", F.lit("ok").alias("verdict"), *none, F.lit(True).alias("fresh"))
    return files.withColumn("fresh", F.lit(False)).unionByName(fresh)


def batch_verdicts(arrivals: DataFrame) -> DataFrame:
    """``input_order, filename, verdict, path, row`` of one batch of ``file_arrivals``: the first valid file (by input order, missing ones
    last) of a fresh name is accepted, other valid files are ``already``. Names are combined map-side, so a hot name is one row a task."""
    place = F.struct(F.col("input_order").isNull(), "input_order", "path", "row")
    first = arrivals.where("verdict = 'ok'").groupBy("filename").agg(F.max("fresh").alias("fresh"), F.min(F.when(~F.col("fresh"), place)).alias("_f"))
    first = first.where("fresh").select(F.col("_f.path").alias("path"), F.col("_f.row").alias("row"), F.lit(True).alias("_first"))
    rows = arrivals.where("NOT fresh").join(first, ["path", "row"], "left")
    verdict = F.when((F.col("verdict") == "ok") & F.col("_first").isNull(), "already").otherwise(F.col("verdict"))
    return rows.select("input_order", "filename", verdict.alias("verdict"), "path", "row")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if path_missing(e):  # nothing written yet; any other failure must not look like an empty table
            return None
        raise


def ingest_batch(verdicts: DataFrame, batch_id: int, store_root: str, read_files, splitter: str = "window", processed_at: str | None = None,
                 stream: str = "stream", compact_every: int = COMPACT_EVERY, ordered: bool = False, **split_kw) -> None:
    """One micro-batch: its verdicts are written to the detail sink, the texts of accepted files are read (``read_files(paths)``:
    ``path, row, input_order, filename, text, file_type``), split and appended to the store as one folder.

    Both sinks take a replayed batch once: details are overwritten by batch, and the store's commit carries the
    batch's number. A batch reads its own source files, its verdicts and the store's log, so its reads don't grow
    with the batches before it; every ``compact_every`` batches small folders are merged."""
    spark = verdicts.sparkSession
    details = f"{store_root.rstrip('/')}/details/batch_id={batch_id}"
    verdicts.write.mode("overwrite").parquet(details)
    accepted = spark.read.schema(_VERDICT).parquet(details).where("verdict = 'ok'")
    paths = [r["path"] for r in accepted.select("path").distinct().collect()]  # at most the files of one trigger
    if paths:
        picked = with_rows(read_files(paths), "row", accepted.select("path", "row"), by=("path",))
        if ordered:
            picked = range_partitioned(picked, ["input_order"])
        elif len(paths) < spark.sparkContext.defaultParallelism:
            # a trigger of few files is split by all cores
            picked = picked.repartition(spark.sparkContext.defaultParallelism, "path", "row")
        rows = explode_chunks(chunk_with(picked, "text", splitter, **split_kw), "chunks", "filename", file_type=F.col("file_type"),
                              processed_at=processed_at, keep=["input_order"])
        rows = rows.withColumn("metadata", encode_metadata("metadata")).withColumnRenamed("input_order", "doc")
        log_store.append(spark, store_root, rows, txn=(stream, batch_id))
    if compact_every and batch_id % compact_every == compact_every - 1 and log_store.manifest(spark, store_root) is not None:
        log_store.compact(spark, store_root)


def stream_ingest(spark: SparkSession, source_path: str, store_root: str, checkpoint: str | None = None,
                  max_files_per_trigger: int | None = None, **kw) -> DataFrame:
    """New document files arrive as a stream (``doc_id, text`` Parquet). Names already seen live in the stream's keyed
    state; every trigger runs ``ingest_batch``. Runs until the files present are processed (``availableNow``) and returns
    the store (with ``batch_id``, the commit that wrote a row's folder); ``stream_details`` has one row per file."""
    schema = spark.read.parquet(source_path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]
    verdict = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_text").when(~has_text("text"), "empty").otherwise("ok")
    files = reader.parquet(stream_path(source_path)).select(F.col("doc_id").cast("long").alias("input_order"), name.alias("filename"),
                                                            verdict.alias("verdict"), *place)

    def read_files(paths):
        return spark.read.schema(schema).parquet(*paths).select(*place, F.col("doc_id").cast("long").alias("input_order"),
                                                                name.alias("filename"), "text", F.lit(".txt").alias("file_type"))

    arrivals = f"{store_root.rstrip('/')}/arrivals"

    def batch(df, number):
        df.write.mode("overwrite").parquet(f"{arrivals}/batch_id={number}")  # the stateful part runs once
        arrived = spark.read.schema(df.schema).parquet(f"{arrivals}/batch_id={number}")
        ingest_batch(batch_verdicts(arrived), number, store_root, read_files, **kw)

    ckpt = checkpoint or scratch_path(spark, "stream-ingest-ckpt")
    q = (file_arrivals(files).writeStream.outputMode("append").foreachBatch(batch)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    state = log_store.manifest(spark, store_root) or log_store.Manifest(store_root.rstrip("/"))
    return log_store.read(spark, state, batch_id=True)


def stream_details(spark: SparkSession, store_root: str) -> DataFrame:
    """I4 of a stream: ``input_order, filename, success, message, chunks`` of every file that arrived."""
    details = _table(spark, f"{store_root.rstrip('/')}/details")
    state = log_store.manifest(spark, store_root)
    if state is None:
        n = details.withColumn("n", F.lit(0))
    else:
        counts = log_store.documents(spark, state).groupBy("filename").agg(F.sum("chunks").alias("n"))
        n = details.join(counts, "filename", "left")
    ok, chunks = F.col("verdict") == "ok", F.coalesce("n", F.lit(0)).cast("int")
    msg = (F.when(ok, fill(MSG_PROCESSED, "filename", chunks)).when(F.col("verdict") == "already", fill(MSG_ALREADY, "filename"))
           .when(F.col("verdict") == "empty", fill(MSG_EMPTY, "filename")).otherwise(fill(MSG_NO_TEXT, "filename")))
    return n.select("input_order", "filename", ok.alias("success"), msg.alias("message"),
                    F.when(ok, chunks).otherwise(F.lit(0)).alias("chunks"))


# ---------------------------------------------------------------------------------------------- X2

_PROGRESS = "status string, n long"


def progress_batch(changed: DataFrame, batch_id: int, table: str) -> None:
    """Merge the changed counts of one trigger into the table of counts: a new version ``batch_id=<n>`` (overwritten by a
    replay) of one row per status."""
    spark = changed.sparkSession
    before = _table(spark, f"{table}/batch_id={batch_id - 1}") if batch_id else None
    rows = changed.select(F.col("status"), F.col("n"), F.lit(1).alias("_new"))
    if before is not None:
        rows = rows.unionByName(before.select("status", "n", F.lit(0).alias("_new")))
    merged = rows.groupBy("status").agg(F.max_by("n", "_new").alias("n"))
    merged.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def read_progress(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the counts: ``status, n``."""
    rows = _table(spark, table)
    if rows is None:
        return spark.createDataFrame([], _PROGRESS)
    newest = rows.select("batch_id").agg(F.max("batch_id")).first()[0]  # answered from folder names and footers
    return rows.where(F.col("batch_id") == newest).select("status", "n")


def progress_done(progress: DataFrame, total: int) -> DataFrame:
    """P5: ``done, total`` and the share that is done."""
    done = F.coalesce(F.sum("n"), F.lit(0))
    return progress.agg(done.alias("done"), F.lit(total).cast("long").alias("total"),
                        F.when(F.lit(total) > 0, F.round(done / F.lit(total), 4)).otherwise(F.lit(1.0)).alias("share"))


def stream_progress(spark: SparkSession, source_path: str, status_col: str, table: str, checkpoint: str | None = None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Running count per status over a stream. Counts live in the stream's state; each trigger merges the counts that
    changed (update mode) into ``table`` in the shared folder, which others may read while the stream runs
    and which a restart continues. Here the stream runs until the input is drained."""
    schema = spark.read.parquet(source_path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = reader.parquet(stream_path(source_path)).groupBy(F.col(status_col).cast("string").alias("status")).agg(
        F.count(F.lit(1)).alias("n"))
    ckpt = checkpoint or scratch_path(spark, "stream-progress-ckpt")
    table = table.rstrip("/")
    q = (counts.writeStream.outputMode("update").foreachBatch(lambda df, bid: progress_batch(df, bid, table))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_progress(spark, table)
