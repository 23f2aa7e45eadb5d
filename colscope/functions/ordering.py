"""Exact global row numbers without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.plans.stages import staged


def global_row_number(
    df: DataFrame,
    keys: Sequence[tuple[str, bool]],
    name: str = "row_no",
) -> DataFrame:
    """Number the rows 1..n in the order of ``keys``, pairs of (column, descending).

    ``keys`` must be a total order; nulls come first in it, last in a descending key. A
    window with no partition would pull every row into one task, so the rows are sorted
    by range, as many ranges as the session shuffles into, and written once with their
    place in the range. The ranges' sizes then give each range's offset: the input is
    computed once and no range grows with the rest.
    """
    order = [F.desc_nulls_last(c) if d else F.asc_nulls_first(c) for c, d in keys]
    # The partition in the upper bits, the place in it in the lower 33.
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(placed, "ordered").select(
        *df.columns,
        F.shiftright("_at", 33).alias("_range"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row a range.
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_range").alias("_offset_range"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset")
    )
    return ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_offset_range"), "left").select(
        *df.columns, (F.col("_offset") + F.col("_place") + 1).alias(name)
    )
