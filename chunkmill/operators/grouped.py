"""Per-group statistics that stay correct and balanced when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_row_index


def ordinal_lag(df: DataFrame, key: str, order: str, cols: list[str], suffix: str = "_prev") -> DataFrame:
    """Previous row's ``cols`` within ``key`` by ``order`` (like ``lag``), without a window
    partitioned by ``key``: rows get a global ordinal over (key, order), and each row joins the
    row whose ordinal is one less. The join key is unique, so a hot group cannot skew a task."""
    ranked = with_row_index(df, [key, order], "_g")
    prev = ranked.select((F.col("_g") + 1).alias("_g"), F.col(key).alias("_pkey"),
                         *[F.col(c).alias(c + suffix) for c in cols])
    out = ranked.join(prev, "_g", "left")
    for c in cols:
        out = out.withColumn(c + suffix, F.when(F.col("_pkey") == F.col(key), F.col(c + suffix)))
    return out.drop("_g", "_pkey")


def grouped_percentile(df: DataFrame, key: str, value: str, p: float, out: str = "threshold") -> DataFrame:
    """Exact percentile with linear interpolation per ``key`` (numpy / ``quantile_cont``).

    Values are ranked by a global ordinal over (key, value); per-group first ordinal and count come
    from a map-side combined aggregate; the two neighbouring order statistics are fetched by a
    join on the unique ordinal. No group is ever collected into one task."""
    vals = df.where(F.col(value).isNotNull()).select(key, value)
    ranked = with_row_index(vals, [key, value], "_g")
    stats = ranked.groupBy(key).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    pos = F.lit(p) * (F.col("_n") - 1)
    targets = stats.select(
        key,
        (F.col("_g0") + F.floor(pos)).alias("_lo"),
        (F.col("_g0") + F.least(F.floor(pos) + 1, F.col("_n") - 1)).alias("_hi"),
        (pos - F.floor(pos)).alias("_frac"),
    )
    vlo = ranked.select(F.col("_g").alias("_lo"), F.col(value).alias("_vlo"))
    vhi = ranked.select(F.col("_g").alias("_hi"), F.col(value).alias("_vhi"))
    return (targets.join(vlo, "_lo").join(vhi, "_hi")
            .select(key, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(out)))


def first_per_key(df: DataFrame, key: str, rank_col: str) -> DataFrame:
    """Rows whose ``rank_col`` is the minimum of their ``key`` (all ties kept).

    A map-side combined ``min`` per key joined back; AQE splits a hot key's partition in the join
    or broadcasts the per-key table after measuring it."""
    best = df.groupBy(key).agg(F.min(rank_col).alias("_best"))
    return df.join(best, key).where(F.col(rank_col) == F.col("_best")).drop("_best")
