"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path, ship_package

# The six ASCII white-space characters that separate words (fixed value).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and shipped package: what every operator's job needs on a cluster."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: cuts the lineage,
    so a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of ``text`` (runs without ASCII white space); null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+"))


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def arrow_schema(ddl: str):
    """The pyarrow schema of a flat ``name type, ...`` list (usable inside Python workers)."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(","))])


def release() -> None:
    """Give a Python worker's freed memory back: idle workers live on and would keep their peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def trimmed(fn):
    """``fn`` of one to three arguments (a function of batches, a group or a pair of groups) that releases memory when it ends."""
    import inspect

    if inspect.isgeneratorfunction(fn):
        def stream(batches):
            yield from fn(batches)
            release()

        return stream

    def call(*args):
        out = fn(*args)
        release()
        return out

    n = len(inspect.signature(fn).parameters)
    return (lambda a: call(a)) if n == 1 else (lambda a, b: call(a, b)) if n == 2 else (lambda a, b, c: call(a, b, c))
