"""Chunk-store storage and the JSON / JSONL / text sinks.

A store is a Parquet table. Updates never overwrite the folder being read: each version is a new
folder, and the newest folder with a commit marker is the current one.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import strict_json
from ..functions.text import has_text, let, ustrip
from ..functions.ordering import with_row_index, with_running_total
from ..session import range_partitioned

STORE_READ_COLUMNS = ["id", "filename", "chunk_index", "chunk_text", "metadata", "created_at"]


# ---------------------------------------------------------------------------------------------- store

def path_missing(error: AnalysisException) -> bool:
    """The read failed because the path does not exist (any other failure is a failure)."""
    return error.getCondition() == "PATH_NOT_FOUND"


def current_version(spark: SparkSession, root: str) -> str | None:
    """Newest committed version of a store, None when there is none yet. Versions are named
    ``v-<number>-<id>``; after a version's data job commits, a one-row marker dataset
    ``committed/v-<number>`` is written, so a listed version is always complete and no pointer is
    ever rewritten in place. A store that cannot be read raises: it is not an empty one."""
    from . import log_store

    state = log_store.manifest(spark, root)
    if state is not None:
        return log_version(state)
    try:
        markers = spark.read.text(f"{root.rstrip('/')}/committed/v-*")
    except AnalysisException as e:
        if path_missing(e):
            return None
        raise
    return markers.agg(F.max("value")).first()[0]


def log_version(state) -> str:
    """The version name of a state of a log-structured store."""
    return f"v-{state.commit:013d}-log"


def write_store(store: DataFrame, root: str, buckets: int | None = None, base: str | None = "current") -> str:
    """Write a new version of the store under ``root`` and commit it with its marker.

    ``base`` is the version that ``store`` was derived from (None: there was none). The new version
    takes the number after it, and its marker must not exist yet: of two writers that read the
    same version, the second fails instead of dropping the first one's rows.

    Rows are clustered by filename (range partitioned, sorted) so ``WHERE filename = ...`` skips
    files and row groups by min/max statistics, which replaces the original filename index. Each row
    also gets ``row_no``, its dense position in (filename, chunk_index) order, so any viewer page
    is a range filter on ``row_no`` that Parquet statistics push down to a row group or two."""
    spark = store.sparkSession
    base = current_version(spark, root) if base == "current" else base
    number = f"v-{int(base.split('-')[1]) + 1 if base else 1:013d}"
    version = f"{number}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{version}"
    indexed_store(store, buckets).write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("errorifexists").text(
        f"{root.rstrip('/')}/committed/{number}")
    return path


def update_store(spark: SparkSession, root: str, change) -> str:
    """Publish ``change(store)`` (an import, merge or edit) as the next version of the store: the whole store is written.
    Appends and deletes of a log-structured store (``log_store``) write only what they change."""
    from . import log_store

    state = log_store.manifest(spark, root)
    if state is not None:
        return log_version(log_store.publish(spark, root, change(log_store.read(spark, state)), state))
    base = current_version(spark, root)
    if base is None:
        raise ValueError(f"no store at {root}")
    return write_store(change(spark.read.parquet(f"{root.rstrip('/')}/{base}")), root, base=base)


def indexed_store(store: DataFrame, buckets: int | None = None) -> DataFrame:
    """The store in (filename, chunk_index) order with a dense ``row_no`` (distributed ordinal: the
    output stays range partitioned and sorted, ready to be written)."""
    base = store.drop("row_no") if "row_no" in store.columns else store
    return with_row_index(base, ["filename", "chunk_index"], "row_no", num_partitions=buckets)


def store_exists(spark: SparkSession, root: str) -> bool:
    return current_version(spark, root) is not None


def read_store(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """The newest committed state of a store: of a log-structured store (``log_store``) the live chunks,
    of a versioned one its newest version (with ``row_no``), or the ``columns`` asked for (pruned in
    the Parquet scan); a plain Parquet folder is read as it is."""
    from . import log_store

    state = log_store.manifest(spark, root)
    if state is not None:
        df = log_store.read(spark, state)
    else:
        version = current_version(spark, root)
        path = f"{root.rstrip('/')}/{version}" if version else root
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------------------------------------- exports

def metadata_object(meta) -> Column:
    """Stored metadata text -> JSON value for export; null, empty or malformed -> ``{}``."""
    c = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(F.when(F.length(c) > 0, strict_json(c)), F.parse_json(F.lit("{}")))


def metadata_json(meta) -> Column:
    """Stored metadata as JSON text for export: an object keeps its key order (parsed as
    ``map<string,variant>``), another JSON value is re-serialised, bad or empty text -> ``{}``."""
    c = F.col(meta) if isinstance(meta, str) else meta

    def render(v):
        return (F.when(F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
                       F.to_json(F.from_json(c, "map<string,variant>")))
                .when(v.isNotNull(), F.to_json(v)).otherwise(F.lit("{}")))

    return let(F.when(F.length(c) > 0, strict_json(c)), render)


def _with_metadata(fields: Column, meta: Column) -> Column:
    """``{...fields, "metadata": <meta JSON>}`` with the metadata inserted as JSON text."""
    head = F.to_json(fields)
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"metadata":'), meta, F.lit("}"))


def jsonl_lines(store: DataFrame) -> DataFrame:
    """S11 rows: ``filename, chunk_index, line`` with ``{filename, chunk_index, text, metadata}``."""
    line = _with_metadata(F.struct(F.col("filename"), F.col("chunk_index"), F.col("chunk_text").alias("text")),
                          metadata_json("metadata"))
    return store.select("filename", "chunk_index", line.alias("line"))


def export_jsonl(store: DataFrame, path: str) -> None:
    """One JSON line per chunk, ordered by filename, chunk_index across part files (range
    partitioning), non-ASCII kept. No single-file funnel."""
    range_partitioned(jsonl_lines(store), ["filename", "chunk_index"]).select("line").write.mode("overwrite").text(path)


def json_documents(store: DataFrame) -> DataFrame:
    """S12 rows: one per filename with its chunks ``[{chunk_index, text, metadata}]`` in order
    (one document's chunks per row)."""
    item = _item()
    g = store.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_index"), item.alias("_j")))).alias("_c"))
    return g.select("filename", F.concat(F.lit("["), F.array_join(F.transform("_c", lambda c: c["_j"]), ","),
                                         F.lit("]")).alias("chunks"))


def json_manifest(store: DataFrame, export_date: str | None = None) -> DataFrame:
    """S12 manifest row: ``export_date, total_documents, total_chunks``."""
    d = F.lit(export_date) if export_date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return store.agg(d.alias("export_date"), F.count_distinct("filename").alias("total_documents"),
                     F.count(F.lit(1)).alias("total_chunks"))


HEAD, BODY, FOOT = range(3)


def _item(meta: str = "metadata") -> Column:
    return _with_metadata(F.struct(F.col("chunk_index"), F.col("chunk_text").alias("text")), metadata_json(meta))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (``filename, chunk_index`` and what they carry) with ``row_no`` and the text before and after a chunk in the object."""
    rows = with_row_index(rows.withColumn("filename", F.coalesce("filename", F.lit(""))), ["filename", "chunk_index"], "row_no")
    ends = rows.groupBy("filename").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    name = F.to_json(F.struct(F.col("filename").alias("f")))
    key = F.concat(F.when(F.col("row_no") > 0, F.lit(",")).otherwise(F.lit("")), name.substr(F.lit(6), F.length(name) - 6), F.lit(":["))
    return rows.join(ends, "filename").withColumns({
        "prefix": F.when(F.col("row_no") == F.col("lo"), key).otherwise(F.lit(",")),
        "suffix": F.when(F.col("row_no") == F.col("hi"), F.lit("]")).otherwise(F.lit(""))}).drop("lo", "hi")


def _head(store: DataFrame, export_date: str | None) -> DataFrame:
    h = F.to_json(F.struct("export_date", "total_documents", "total_chunks"))
    return json_manifest(store, export_date).select(F.concat(h.substr(F.lit(1), F.length(h) - 1), F.lit(',"documents":{')).alias("fragment"))


def json_fragments(store: DataFrame, export_date: str | None = None) -> DataFrame:
    """S12 as one object in pieces: rows ``section, row_no, fragment`` whose fragments, one per line and
    in the order of ``section, row_no``, are ``{export_date, total_documents, total_chunks, documents: {filename: [chunks]}}``
    with filenames in order. One row per chunk: neither the object nor a document is ever held in one row."""
    body = _placed(store.select("filename", "chunk_index", _item().alias("item")))

    def part(df, section, row_no, fragment):
        return df.select(F.lit(section).alias("section"), row_no.cast("long").alias("row_no"), fragment.alias("fragment"))

    return (part(_head(store, export_date), HEAD, F.lit(0), F.col("fragment"))
            .unionByName(part(body, BODY, F.col("row_no"), F.concat("prefix", "item", "suffix")))
            .unionByName(part(store.sparkSession.range(1), FOOT, F.lit(0), F.lit("}}"))))


def json_offsets(store: DataFrame, export_date: str | None = None) -> DataFrame:
    """``filename, chunk_index, row_no, n_bytes, byte_offset`` of every chunk's fragment (its line end included) in the object that
    ``export_single_json`` writes. Sizes only are sorted and shuffled, no texts."""
    rows = _placed(store.select("filename", "chunk_index", F.octet_length(_item()).alias("n")))
    size = (F.octet_length("prefix") + F.col("n") + F.octet_length("suffix") + 1).cast("long")
    rows = with_running_total(rows.select("filename", "chunk_index", "row_no", size.alias("n_bytes")), ["row_no"], "n_bytes", "byte_offset")
    head = _head(store, export_date).select((F.octet_length("fragment") + 1).cast("long")).scalar()
    return rows.withColumn("byte_offset", F.col("byte_offset") + head)


def export_single_json(store: DataFrame, path: str, export_date: str | None = None) -> None:
    """S12, single-object form: ordered text parts; their concatenation in the order of the names is the one JSON object."""
    range_partitioned(json_fragments(store, export_date), ["section", "row_no"]).select("fragment").write.mode("overwrite").text(path)


def export_json(store: DataFrame, path: str, export_date: str | None = None) -> None:
    """Per-file JSON rows under ``path/documents`` plus ``path/manifest``. ``export_single_json``
    writes the one object."""
    json_documents(store).write.mode("overwrite").json(f"{path}/documents")
    json_manifest(store, export_date).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


# ---------------------------------------------------------------------------------------------- samples

def save_samples(samples: DataFrame, path: str) -> None:
    """Samples as JSONL (folder created, overwritten; null fields written as null)."""
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_sample_objects(samples: DataFrame, path: str, sample: str = "sample") -> None:
    """Whole sample objects (VARIANT, as ``load_samples_strict`` and F11 keep them) as JSONL: keys beside instruction and
    output reach the file too."""
    samples.select(F.to_json(F.col(sample)).alias("value")).write.mode("overwrite").text(path)


def parse_sample_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Non-blank JSONL lines -> ``sample`` (VARIANT, null when the line is not strict JSON)."""
    return lines.where(has_text(F.col(line))).withColumn("sample", strict_json(F.col(line)))


def load_samples_strict(lines: DataFrame, line: str = "line", failfast: bool = False) -> DataFrame:
    """Records holding both ``instruction`` and ``output`` (the whole object stays in ``sample``);
    malformed lines are flagged in ``rejected`` (or fail the load with ``failfast``)."""
    from ..functions.jsonx import has_key, is_object, object_keys, text_of

    p = parse_sample_lines(lines, line)
    if failfast and not p.where(F.col("sample").isNull()).isEmpty():
        raise ValueError("malformed JSON line in samples file")
    keys = object_keys(F.col("sample"))
    ok = is_object(F.col("sample")) & has_key(F.col("sample"), "instruction", keys) & has_key(F.col("sample"), "output", keys)
    return p.select("*", F.col("sample").isNull().alias("rejected"), ok.alias("_ok"),
                    text_of(F.col("sample"), "instruction").alias("instruction"),
                    text_of(F.col("sample"), "output").alias("output"), F.size(keys).alias("n_keys"))


def load_sft_dataset(lines: DataFrame, line: str = "line") -> DataFrame:
    """Every JSON object line -> ``instruction, output`` with missing keys as ``""``; other
    lines are flagged ``rejected``. Zero accepted rows is the failure case (``require_rows``)."""
    from ..functions.jsonx import is_object, text_of

    p = parse_sample_lines(lines, line)
    obj = is_object(F.col("sample"))
    return p.select("*", (~obj).alias("rejected"),
                    F.when(obj, F.coalesce(text_of(F.col("sample"), "instruction"), F.lit(""))).alias("instruction"),
                    F.when(obj, F.coalesce(text_of(F.col("sample"), "output"), F.lit(""))).alias("output"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail with ``message`` when ``df`` has no row (one bounded check), else return it."""
    if df.isEmpty():
        raise ValueError(message)
    return df


# ---------------------------------------------------------------------------------------------- CPT corpus

def build_cpt_corpus(store: DataFrame, path: str) -> None:
    """Every chunk text followed by a blank line, as text part files."""
    store.select("chunk_text").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_cpt_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One sample per non-blank line, stripped."""
    return cpt_samples(spark.read.text(path), "value")


def cpt_samples(lines: DataFrame, col: str) -> DataFrame:
    return lines.select(ustrip(F.col(col)).alias("text")).where(F.col("text") != "")


def count_nonblank_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Number of non-blank lines (0 means the file is empty)."""
    return lines.agg(F.count_if(has_text(F.col(col))).alias("nonblank_lines"))
