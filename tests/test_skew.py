"""A third of all rows under one key: results stay exact and AQE splits the hot join partition."""

import contextlib

from pyspark.sql import functions as F

from chunkmill.operators.merge import merge_dedup_content, merge_stores

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextlib.contextmanager
def small_thresholds(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _stores(spark, n=30000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot.txt"))
        .otherwise(F.concat(F.lit("f"), (F.col("id") % 5000).cast("string"), F.lit(".txt"))).alias("filename"),
        (F.col("id") % 3).cast("int").alias("store_rank"), F.col("id").alias("id"),
        F.col("id").cast("int").alias("chunk_index"),
        F.when(F.col("id") % 3 == 1, F.lit("same boilerplate line")).otherwise(F.col("id").cast("string")).alias("chunk_text"),
        F.lit("S").alias("store"))


def _final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_filename_merge(spark):
    with small_thresholds(spark):
        rows, plan = _final_plan(merge_stores(_stores(spark)))
    # hot.txt lives only in store_rank 0 (ids divisible by 3): all 10,000 of its chunks are kept
    assert sum(1 for r in rows if r.filename == "hot.txt") == 10000
    # every other name keeps only its first store's rows
    best = {}
    for i in range(30000):
        if i % 3 == 0:
            continue
        f = f"f{i % 5000}.txt"
        best[f] = min(best.get(f, 9), i % 3)
    assert sum(1 for r in rows if r.filename != "hot.txt") == sum(
        1 for i in range(30000) if i % 3 and (i % 3) == best[f"f{i % 5000}.txt"])
    assert "skew=true" in plan


def test_hot_text_dedup(spark):
    with small_thresholds(spark):
        rows, plan = _final_plan(merge_dedup_content(_stores(spark)))
    same = [r for r in rows if r.chunk_text == "same boilerplate line"]
    assert len(same) == 1 and same[0].id == 1
    assert len(rows) == 20000 + 1
