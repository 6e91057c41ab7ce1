"""Import and merge of chunk stores (M1-M10) and the store registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import (DEFAULT_STORE, MSG_IMPORTED, MSG_MERGED, MSG_NAME_TAKEN, MSG_NEED_NAME, MSG_NEED_TWO,
                     MSG_NEW_STORE, MSG_SKIPPED)
from ..functions.text import fill
from ..functions.jsonx import strict_json
from ..functions.ordering import with_row_index
from ..session import cut_lineage
from .store import STORE_COLUMNS, append_chunks


def metadata_or_empty(col) -> "F.Column":
    """M4: JSON text -> JSON value; null, empty or malformed text -> ``{}`` (as a variant)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.when(F.length(c) > 0, strict_json(c)), F.parse_json(F.lit("{}")))


def _clean_metadata(df: DataFrame) -> DataFrame:
    ok = strict_json("metadata").isNotNull() & (F.length("metadata") > 0)
    return df.withColumn("metadata", F.when(ok, F.col("metadata")).otherwise(F.lit("{}")))


def import_merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """M1: add the source chunks whose filename the target does not hold; new ids follow the
    target's maximum in source id order; bad metadata becomes ``{}``."""
    new = source.join(target.select("filename").distinct(), "filename", "left_anti")
    return append_chunks(target, new, order=("id",), clean=_clean_metadata)


def import_replace(target: DataFrame, source: DataFrame) -> DataFrame:
    """M2: the target becomes the source (re-numbered); an empty source is refused and the
    target is returned unchanged. The emptiness test is one bounded action."""
    if source.isEmpty():
        return target
    empty = target.limit(0)
    return append_chunks(empty, source, order=("id",), clean=_clean_metadata)


def import_counts(target: DataFrame, source: DataFrame) -> DataFrame:
    """M3: imported and skipped chunk counts of a merge import, and the message."""
    names = target.select("filename").distinct().withColumn("_dup", F.lit(True))
    c = source.join(names, "filename", "left").agg(
        F.count_if(F.col("_dup").isNull()).alias("imported"), F.count_if(F.col("_dup")).alias("skipped"))
    msg = F.concat(fill(MSG_IMPORTED, "imported"),
                   F.when(F.col("skipped") > 0, fill(MSG_SKIPPED, "skipped")).otherwise(F.lit("")))
    return c.withColumn("message", msg)


def merge_stores(stores: DataFrame) -> DataFrame:
    """M5: rows of all stores (``store_rank`` = list order); per filename only the first store that
    holds it contributes, with all its chunks. ``min`` per filename is combined map-side; the join
    back is split by AQE when one filename is hot."""
    best = stores.groupBy("filename").agg(F.min("store_rank").alias("_best"))
    return stores.join(best, "filename").where(F.col("store_rank") == F.col("_best")).drop("_best")


def merge_id_map(stores: DataFrame) -> DataFrame:
    """M5: ``store_rank, old_id, id`` of every chunk that a merge keeps: one dense ordinal in (store, old id) order, so ids of
    several stores no longer collide. Narrow rows only: the names decide, no text is read."""
    kept = merge_stores(stores.select("store_rank", "filename", F.col("id").alias("old_id")))
    return with_row_index(kept.select("store_rank", "old_id"), ["store_rank", "old_id"], "id", start=1)


def merge_renumbered(stores: DataFrame) -> DataFrame:
    """M5 as a new store: the chunks that a merge keeps, with ids from ``merge_id_map`` (``old_id`` is kept) and metadata
    that isn't JSON replaced by ``{}``. Texts are joined once, on the unique key (store_rank, id)."""
    renamed = stores.withColumnRenamed("id", "old_id")
    return _clean_metadata(renamed.join(merge_id_map(stores), ["store_rank", "old_id"]))


def publish_merge(spark, stores: DataFrame, root: str) -> DataFrame:
    """M5: merge into the log-structured store at ``root``: what the target already holds comes first (as one more store),
    the merge becomes its next version, in one commit. Returns the totals of the merged store."""
    from ..sources import log_store

    base = log_store.manifest(spark, root)
    stores = stores.select("store_rank", *STORE_COLUMNS)
    if base is not None:
        target = log_store.read(spark, base).withColumn("store_rank", F.lit(-1))
        kept = merge_stores(stores.join(log_store.filenames(spark, base), "filename", "left_anti"))
        first = target.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        ids = merge_id_map(kept)
        new = _clean_metadata(kept.withColumnRenamed("id", "old_id").join(ids, ["store_rank", "old_id"]))
        merged = target.select(*STORE_COLUMNS).unionByName(new.withColumn("id", F.col("id") + first).select(*STORE_COLUMNS))
    else:
        merged = merge_renumbered(stores).select(*STORE_COLUMNS)
    state = log_store.publish(spark, root, merged, base)
    return merge_totals(log_store.read(spark, state))


def merge_totals(merged: DataFrame) -> DataFrame:
    t = merged.agg(F.count_distinct("filename").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    return t.withColumn("message", fill(MSG_MERGED, "documents", "chunks"))


def merge_dedup_content(stores: DataFrame) -> DataFrame:
    """M6: merge keeping one chunk per identical text: the first by (store_rank, id); the store it
    came from is kept as ``original_db``. A text repeated in a third of all rows is combined
    map-side before the shuffle; ``(store_rank, id)`` is unique, so the join has no hot key."""
    digest = F.unhex(F.sha2("chunk_text", 256))  # the text itself is neither grouped, sorted nor joined on
    best = stores.groupBy(digest.alias("_d")).agg(F.min(F.struct("store_rank", "id")).alias("_b"))
    # kept as narrow rows: the optimizer puts the join below the union of the stores and would group once for each of them
    best = cut_lineage(best.select(F.col("_b.store_rank").alias("store_rank"), F.col("_b.id").alias("id")))
    return stores.join(best, ["store_rank", "id"], "left_semi").withColumnRenamed("store", "original_db")


def list_stores(registry: DataFrame, default: str = DEFAULT_STORE) -> DataFrame:
    """M7: registry names (``ordinal, store``) with the default store first when absent."""
    spark = registry.sparkSession
    head = spark.createDataFrame([(-1, default)], "ordinal long, store string")
    return head.join(registry.select("store"), "store", "left_anti").unionByName(registry.select("ordinal", "store"))


def active_store(registry: DataFrame, active: str | None, default: str = DEFAULT_STORE) -> DataFrame:
    """M7: the active name if registered (or the default), else the default."""
    names = list_stores(registry, default).where(F.col("store") == F.lit(active))
    return names.select(F.col("store").alias("active")).unionByName(
        registry.sparkSession.createDataFrame([(default,)], "active string")).agg(F.first("active").alias("active"))


def store_catalogue(stores: DataFrame) -> DataFrame:
    """M8: per store: chunks, text bytes and number of sources."""
    return stores.groupBy("store").agg(F.count(F.lit(1)).alias("chunks"),
                                       F.sum(F.octet_length("chunk_text")).alias("bytes"),
                                       F.count_distinct("filename").alias("sources"))


def store_sources(stores: DataFrame) -> DataFrame:
    """The sources of every store as rows ``store, source, chunks`` (the list can be as long as the store)."""
    return stores.groupBy("store", F.col("filename").alias("source")).agg(F.count(F.lit(1)).alias("chunks"))


def missing_stores(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """M9: requested names that are not registered. Fewer than two requests is an error."""
    if requested.limit(2).count() < 2:
        raise ValueError(MSG_NEED_TWO)
    return requested.join(registry.select("store"), "store", "left_anti")


def import_as_new_store(stores: DataFrame, registry: DataFrame, source: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Copy store ``source`` under ``name`` unless the name is blank or taken.

    Returns (stores with the copy, one-row report ``store, ok, message, documents, chunks``)."""
    spark = stores.sparkSession
    name = (name or "").strip()
    taken = name == "" or not registry.where(F.col("store") == name).isEmpty() or name == DEFAULT_STORE
    if taken:
        msg = MSG_NEED_NAME if name == "" else MSG_NAME_TAKEN.format(name)
        rep = spark.createDataFrame([(name, False, msg, 0, 0)],
                                    "store string, ok boolean, message string, documents long, chunks long")
        return stores, rep
    copy = stores.where(F.col("store") == source).withColumn("store", F.lit(name))
    d = copy.agg(F.count_distinct("filename").alias("documents"), F.count(F.lit(1)).alias("chunks"))
    rep = d.select(F.lit(name).alias("store"), F.lit(True).alias("ok"),
                   fill(MSG_NEW_STORE, F.lit(name), "documents", "chunks").alias("message"),
                   "documents", "chunks")
    return stores.unionByName(copy), rep
