"""F9 as a durable job: requests keyed by hash, replies in a table, resume by anti join, paced tasks.

The ledger is a Parquet folder of ``key, reply, error, attempts`` in shared storage; ``key`` is the SHA-256 of the
request text. ``answer_requests`` works in waves (a share of the keys each); a wave's replies are committed together by
Spark's writer. A run that is killed repeats at most the wave it was in: every later run starts with an
anti join against the replies already there. Equal requests are asked once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store_io import path_missing
from .samples import generate_responses

LEDGER = "key string, reply string, error string, attempts int"
CHARS_PER_TOKEN = 4  # for pacing only


def request_key(request: Column) -> Column:
    return F.sha2(F.coalesce(request, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per key: a reply, if any run got one (the smallest, should there be several), else the last error."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if path_missing(e):  # no wave committed yet
            return spark.createDataFrame([], LEDGER)
        raise
    return rows.groupBy("key").agg(F.min("reply").alias("reply"), F.max("error").alias("error"),
                                   F.sum("attempts").cast("int").alias("attempts")).withColumn(
        "error", F.when(F.col("reply").isNull(), F.col("error")))


def record_replies(replies: DataFrame, path: str) -> None:
    """Append replies that come from elsewhere (``request, reply``) to the ledger."""
    replies.select(request_key(F.col("request")).alias("key"), "reply", F.lit(None).cast("string").alias("error"),
                   F.lit(0).alias("attempts")).write.mode("append").parquet(path)


def pending(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """``key, request`` of the distinct requests without a reply."""
    keyed = requests.select(request_key(F.col("request")).alias("key"), "request").dropDuplicates(["key"])
    return keyed.join(ledger.where(F.col("reply").isNotNull()).select("key"), "key", "left_anti")


def paced(generate: Callable[[pd.Series], pd.Series], tokens_per_second: float | None) -> Callable[[pd.Series], pd.Series]:
    """``generate`` that keeps within a token budget per second, counted per task from its first call."""
    if not tokens_per_second:
        return generate
    began: list[float] = []
    spent = [0.0]

    def run(prompts: pd.Series) -> pd.Series:
        if not began:
            began.append(time.monotonic())
        wait = began[0] + spent[0] / tokens_per_second - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        out = generate(prompts)
        spent[0] += (prompts.fillna("").str.len().sum() + out.fillna("").str.len().sum()) / CHARS_PER_TOKEN
        return out

    return run


def answer_requests(spark: SparkSession, requests: DataFrame, path: str, generate: Callable[[pd.Series], pd.Series], waves: int = 8,
                    parallelism: int = 5, tokens_per_second: float | None = None, retries: int = 3, backoff: float = 0.5) -> DataFrame:
    """Ask every request (``request``) that the ledger at ``path`` has no reply to, and return ``with_replies``. ``parallelism`` tasks
    share ``tokens_per_second``."""
    rate = tokens_per_second / parallelism if tokens_per_second else None
    for wave in range(waves):
        todo = pending(requests, read_ledger(spark, path)).where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave)
        if todo.isEmpty():
            continue
        done = generate_responses(todo, "request", paced(generate, rate), parallelism, retries, backoff)
        done.select("key", "reply", "error", "attempts").write.mode("append").parquet(path)
    return with_replies(requests, read_ledger(spark, path))


def with_replies(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every request row with ``reply, error, attempts`` (null without a ledger row)."""
    j = requests.withColumn("_key", request_key(F.col("request"))).join(ledger.withColumnRenamed("key", "_key"), "_key", "left")
    return j.drop("_key")
