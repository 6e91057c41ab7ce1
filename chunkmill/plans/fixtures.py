"""Inputs derived from the driver tables.

Documents become files named ``doc_<doc_id>.txt``. Three chunk stores overlap by language and
use different window sizes, so which store wins a merge is visible in the result:

* ``A``: languages en and fr, windows of 512 / overlap 50
* ``B``: languages fr, de and es, windows of 400 / overlap 40
* ``C``: every document, windows of 1000 / overlap 100

Each builder has a DuckDB twin in ``store_sql`` so the oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from ..functions.text import STRIP_PATTERN
from ..operators.chunking import encode_metadata, explode_chunks, window_chunks
from ..session import scratch_path

FIXED_TIME = "2024-01-01T00:00:00"
STORES = {
    "A": (["en", "fr"], 512, 50),
    "B": (["fr", "de", "es"], 400, 40),
    "C": (None, 1000, 100),
}
STORE_ORDER = ["A", "B", "C"]


def spread(df: DataFrame) -> DataFrame:
    """Fixture tables are single row groups, which one task would read: deal them over the cores.
    (No operator does this; large inputs have one split per block.)"""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; spread over the cores when the file is a single row group."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def doc_files(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``dealt=False`` for a reader that deals the rows out itself."""
    d = table(spark, sf_dir, "documents") if dealt else spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return d.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                    "text", "lang", "source")


_MATERIALIZED: dict = {}


def chunk_store(spark: SparkSession, sf_dir: str, which: str, materialize: bool = True) -> DataFrame:
    """Store rows ``id, filename, chunk_index, chunk_text, metadata, created_at``.

    Stores are tables: the first use in an application writes the derived store to the shared
    scratch folder (clustered by filename) and later uses scan it, as store operators scan stored
    stores in production. ``materialize=False`` returns the derivation itself."""
    if not materialize:
        return _derive_store(spark, sf_dir, which)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), which)
    path = _MATERIALIZED.get(key)
    if path is None:
        path = scratch_path(spark, f"store-{which}")
        number_rows(_derive_store(spark, sf_dir, which, clustered=True), "row_no").write.mode("overwrite").parquet(path)
        _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def _derive_store(spark: SparkSession, sf_dir: str, which: str, clustered: bool = False) -> DataFrame:
    """``clustered``: in (filename, chunk_index) order over the partitions and in each. The documents are range partitioned
    by name before they are split: a range partition of the chunks would split every text twice, for its sample of the keys, too."""
    langs, size, overlap = STORES[which]
    d = doc_files(spark, sf_dir, dealt=not clustered)
    if langs is not None:
        d = d.where(F.col("lang").isin(langs))
    if clustered:
        d = d.select("doc_id", "filename", "text").repartitionByRange("filename")
    d = d.withColumn("chunks", window_chunks("text", size, overlap))
    rows = explode_chunks(d, "chunks", "filename", file_type=".txt", processed_at=FIXED_TIME, keep=["doc_id"])
    rows = rows.select(
        (F.col("doc_id") * (1 << 32) + F.col("chunk_index") + 1).alias("id"),
        "filename", "chunk_index", "chunk_text",
        encode_metadata("metadata").alias("metadata"),
        F.lit(FIXED_TIME).cast("timestamp").alias("created_at"),
    )
    return rows.sortWithinPartitions("filename", "chunk_index") if clustered else rows


def stores_union(spark: SparkSession, sf_dir: str, names=STORE_ORDER) -> DataFrame:
    """All stores with ``store`` and ``store_rank`` (list order) columns."""
    out = None
    for rank, n in enumerate(names):
        s = chunk_store(spark, sf_dir, n).withColumn("store", F.lit(n)).withColumn("store_rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    return out


# ----------------------------------------------------------------------------------------------
# DuckDB twins
# ----------------------------------------------------------------------------------------------

STRIP_SQL = STRIP_PATTERN  # RE2 reads the same class


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP_SQL}', '', 'g')"


def store_sql(which: str) -> str:
    """A SELECT producing the same rows as ``chunk_store(which)``."""
    langs, size, overlap = STORES[which]
    step = size - overlap
    where = "" if langs is None else "WHERE lang IN (" + ", ".join(f"'{x}'" for x in langs) + ")"
    return f"""
SELECT doc_id * 4294967296 + chunk_index + 1 AS id, filename, chunk_index, chunk_text,
       CAST(to_json({{'source': filename, 'chunk_index': chunk_index, 'total_chunks': total_chunks,
                 'file_type': '.txt', 'processed_at': '{FIXED_TIME}'}}) AS VARCHAR) AS metadata,
       TIMESTAMP '{FIXED_TIME.replace('T', ' ')}' AS created_at
FROM (
  SELECT doc_id, filename, chunk_text,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index,
         CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks
  FROM (
    SELECT doc_id, filename, k, {strip_sql(f'substring(text, CAST(k * {step} + 1 AS BIGINT), {size})')} AS chunk_text
    FROM (
      SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, text,
             unnest(range(0, greatest(1, CAST(ceil((length(text) - {overlap}) / {step}.0) AS BIGINT)))) AS k
      FROM documents {where}
    )
  ) WHERE chunk_text <> ''
)"""


def stores_union_sql(names=STORE_ORDER) -> str:
    parts = [f"SELECT *, '{n}' AS store, {r} AS store_rank FROM ({store_sql(n)})" for r, n in enumerate(names)]
    return "\nUNION ALL\n".join(parts)


def windows_sql(src: str, size: int, overlap: int) -> str:
    """Chunk rows (``ord, filename, chunk_index, total_chunks, chunk_text``) of C2 windows over a
    relation ``src`` with columns ``ord, filename, text``."""
    step = size - overlap
    return f"""
  SELECT ord, filename, chunk_text,
         CAST(row_number() OVER (PARTITION BY ord ORDER BY k) - 1 AS INTEGER) AS chunk_index,
         CAST(count(*) OVER (PARTITION BY ord) AS INTEGER) AS total_chunks
  FROM (
    SELECT ord, filename, k, {strip_sql(f'substring(text, CAST(k * {step} + 1 AS BIGINT), {size})')} AS chunk_text
    FROM (SELECT ord, filename, text,
                 unnest(range(0, greatest(1, CAST(ceil((length(text) - {overlap}) / {step}.0) AS BIGINT)))) AS k
          FROM ({src}))
  ) WHERE chunk_text <> ''"""


NON_WS_SQL = "[^" + STRIP_PATTERN[2:STRIP_PATTERN.index("]") + 1]
