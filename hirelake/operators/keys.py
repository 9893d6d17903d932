"""Distributed surrogate keys.

A global ``row_number() OVER (ORDER BY name)`` moves every row into one task.  Here
the rows are range-partitioned by the order column (a distributed sort), each row
gets its position inside its partition, and a per-partition count table (one row per
partition, so its size is bounded by the partition count) turns positions into
global ranks.  The sorted rows with their partition and position are written to shared
storage once, and both the counts and the result read that copy: planned apart, the two
branches would each sample range bounds of their own and lose or repeat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_POS_BITS = 33  # monotonically_increasing_id(): partition index << 33 | row position


def sequential_ids(df: DataFrame, order_cols: list[str], id_col: str = "id", start=0) -> DataFrame:
    """Attach ``id = start + 1 + rank`` in the total order of ``order_cols``.

    ``order_cols`` must identify rows uniquely (e.g. distinct dimension names).
    ``start`` may be a Column over a one-row frame's value or a literal.
    """
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    mid = F.monotonically_increasing_id()
    tagged = materialize(ordered.withColumn("_row", mid).select(
        "*",
        F.shiftright(F.col("_row"), _POS_BITS).alias("_pid"),
        F.col("_row").bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("_pos"),
    ).drop("_row"), "sorted")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    start_c = start if isinstance(start, Column) else F.lit(start)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (start_c + F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_pid", "_pos", "_off"))
