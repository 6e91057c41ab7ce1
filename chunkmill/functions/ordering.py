"""Global ordinals without funnelling rows through one task.

``row_number() OVER (ORDER BY k)`` with no partition runs in a single task. Here rows are range
partitioned on the order key, sorted inside each partition, numbered locally, and shifted by the
row counts of all earlier partitions. The offset table has one row per partition, so it is
bounded by the partition count and safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, range_partitioned

_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | position in partition


def with_row_index(df: DataFrame, order_cols: list, name: str = "row_index", start: int = 0,
                   num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based (plus ``start``) ordinal following ``order_cols``.

    ``order_cols`` must be a total order (ties are broken arbitrarily). The sorted, tagged frame
    is checkpointed so the counting pass and the numbering pass see the same partitions, also
    after an executor is lost. AQE may merge neighbouring ranges; ids stay ordered because merged
    partitions keep their range order.
    """
    return number_rows(range_partitioned(df, list(order_cols), num_partitions), name, start)


def number_rows(df: DataFrame, name: str = "row_index", start: int = 0) -> DataFrame:
    """The numbering of ``with_row_index`` for rows that already lie in order: over the partitions and in each."""
    tagged = cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a proven bound, safe to broadcast
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    local = F.col("_mid") - F.shiftleft(F.shiftright(F.col("_mid"), _LOCAL_BITS), _LOCAL_BITS)
    return (
        tagged.join(F.broadcast(offsets), pid == F.col("_pid"), "left")
        .withColumn(name, F.col("_off") + local + F.lit(start))
        .drop("_mid", "_pid", "_off")
    )


def with_running_total(df: DataFrame, order_cols: list, value: str, name: str = "total_before") -> DataFrame:
    """Add the sum of ``value`` over all earlier rows in the order of ``order_cols`` (a total order). Keep ``df`` narrow: it is
    sorted and checkpointed once, each range sums its own rows, and one total per range (broadcast) shifts them."""
    tagged = range_partitioned(df, list(order_cols)).withColumn("_mid", F.monotonically_increasing_id())
    tagged = cut_lineage(tagged.withColumn("_range", F.shiftright("_mid", _LOCAL_BITS)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0)).alias("_off"))
    local = F.coalesce(F.sum(value).over(before.partitionBy("_range").orderBy("_mid")), F.lit(0))
    out = tagged.withColumn("_local", local).join(F.broadcast(totals), "_range")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_mid", "_range", "_off", "_local")
