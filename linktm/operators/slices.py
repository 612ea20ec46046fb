"""Global order without a single-task window.

A frame is stored once, ranged over partitions by its whole order key and sorted inside each: the
partitions are slices, consecutive ranges of a total order, of about equal row count. Every
row keeps its slice and its place in it, so numbering needs one more row per slice and no window.
As the whole key decides, a value of the first column that holds a third of all rows spreads over a
third of the slices.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktm.scratch import materialize

ROWS_PER_SLICE = 4_000_000
SMALL_SLICE = 1_000
SLICE = "_slice"
INSIDE = "_inside"
# monotonically_increasing_id holds the partition above this bit and the row's place below it.
PLACE_BITS = 33


def slice_count(rows: int, tasks: int, rows_per_slice: int = ROWS_PER_SLICE) -> int:
    """Slices for a number of rows: several per task for small frames, then one per
    `rows_per_slice` rows without a limit."""
    even = min(4 * tasks, math.ceil(rows / SMALL_SLICE))
    return max(1, even, math.ceil(rows / rows_per_slice))


def slice_by(
    frame: DataFrame,
    order: list[str],
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """`frame` with its slice (`_slice`) and its place there (`_inside`, from 0) in the order of the columns
    `order`, nulls first, NaN last.

    The input is evaluated once, into the shared folder; the count, the borders and the rows come from what is
    stored, and the result is stored as well, so every later pass, retry or replay agrees. `stored` says that the
    rows already follow from stored or persisted data alone: they are then evaluated again instead of written twice.
    `order` must identify a row up to ties whose mutual order does not matter.
    """
    spark = frame.sparkSession
    rows = frame if stored else materialize(frame, "unordered")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = slice_count(rows.select(*order).count(), tasks, rows_per_slice)
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())
    inside = F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    numbered = placed.withColumns({SLICE: F.shiftright("_at", PLACE_BITS), INSIDE: inside})
    return materialize(numbered.drop("_at"), "slices")


def dense_row_id(
    frame: DataFrame,
    order: list[str],
    *,
    name: str = "row_id",
    total: str | None = None,
    start: int = 0,
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """Add consecutive integers from `start` in the order of `order`; `total`, when
    given, names a column for the number of rows."""
    sliced = slice_by(frame, order, rows_per_slice=rows_per_slice, stored=stored)
    counted = sliced.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    # These windows run over the slice table: one row per slice.
    everything = Window.orderBy(SLICE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = counted.select(
        SLICE,
        (F.sum("_rows").over(Window.orderBy(SLICE)) - F.col("_rows") + start).alias("_before"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    # One row per slice: sent to every task while it is small, else joined by slice.
    numbered = sliced.join(offsets, SLICE).withColumn(name, F.col("_before") + F.col(INSIDE))
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop(SLICE, INSIDE, "_before", "_total")
