"""Distributed row numbering and running sums without a single-partition window.

``row_number()`` over an un-partitioned window moves every row into one task.
Here the keys are range-partitioned on the order columns, numbered inside
their partition, and shifted by the row count of all earlier partitions; only
one row per partition is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import written

_POS_BITS = 33   # monotonically_increasing_id = partition_index << 33 | position


def global_ordinal(df: DataFrame, order_cols: list[str], name: str = "ordinal",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based dense position of each row in ``order_cols`` order (nulls first, ties in any order).

    Rows with equal order columns are told apart by a row number, which also spreads a hot
    key over partitions.  The rows are computed once, by the write that gives them that number:
    the range bounds are a pass of their own, which would compute them again.  Range-partitioned
    and sorted they are written again (shared dir), so that counting and shifting see the same
    partitions after an executor loss, the count reads one column, and nothing is joined back
    but one count per partition.
    """
    parts = [num_partitions] if num_partitions else []
    order = [*order_cols, "_tie"]
    rows = written(df.withColumn("_tie", F.monotonically_increasing_id()), "computed")
    ranged = (rows.repartitionByRange(*parts, *order).sortWithinPartitions(*order).drop("_tie")
                  .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = written(ranged, "ranged").withColumn("_pid", F.shiftright("_mid", _POS_BITS))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    position = F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (tagged.join(F.broadcast(offsets), "_pid").withColumn(name, position).drop("_mid", "_pid", "_off"))


def running_sums(df: DataFrame, order_col: str, value_cols: list[str],
                 prefix: str = "running_", block: int = 4096) -> DataFrame:
    """Cumulative sums of ``value_cols`` over a dense integer ``order_col`` (1, 2, 3, ...).

    Two levels: a window inside blocks of ``block`` consecutive keys, plus the
    total of all earlier blocks.  No window partition ever holds more than
    ``block`` rows, and the block-total table has (#keys / block) rows.
    """
    blk = F.floor((F.col(order_col) - 1) / F.lit(block))
    d = df.withColumn("_blk", blk)
    inside = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    for c in value_cols:
        d = d.withColumn(f"_in_{c}", F.sum(c).over(inside))
    totals = d.groupBy("_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    earlier = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_blk", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}")
                                      for c in value_cols])
    out = d.join(offsets, "_blk", "left")
    for c in value_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_in_{c}") + F.col(f"_o_{c}"))
    return out.drop("_blk", *[f"_in_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])
