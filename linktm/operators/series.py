"""Arrival-time series: union, consecutive differences and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktm.operators.selection import select_first
from linktm.operators.slices import INSIDE, ROWS_PER_SLICE, SLICE, slice_by


def combine(*series: DataFrame) -> DataFrame:
    """All rows of all series, duplicates kept."""
    return reduce(lambda left, right: left.unionByName(right), series)


def consecutive_difference(
    frame: DataFrame,
    time: str,
    *,
    by: list[str] | None = None,
    tie: list[str] | None = None,
    name: str = "delta",
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """n rows -> n-1 rows with `time` minus the previous row's `time`.

    by   columns that separate series (default: one global series).
    tie  columns that order rows of equal time.
    stored  as in `slices.slice_by`: the frame follows from stored rows and is not written once more.

    The frame is sliced in (time, tie) order and each series is ordered inside each
    slice, so a series or a time that holds most of the rows spreads over many slices.
    What a slice's first row needs from outside, the last time of its series in an
    earlier slice, joins the slice as one more row in front.
    """
    by, tie = by or [], tie or []
    timed = frame.where(F.col(time).isNotNull())
    sliced = slice_by(timed, [time, *tie], rows_per_slice=rows_per_slice, stored=stored).drop(INSIDE)
    last = sliced.groupBy(SLICE, *by).agg(F.max(time).alias("_last"))
    # One row per slice and series; without `by`, one row per slice.
    earlier = last.select(
        SLICE, *by, F.lag("_last").over(Window.partitionBy(*by).orderBy(SLICE)).alias(time)
    ).where(F.col(time).isNotNull())
    rows = sliced.withColumn("_own", F.lit(True)).unionByName(
        earlier.withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    within = Window.partitionBy(SLICE, *by).orderBy(time, "_own", *tie)
    return (
        rows.withColumn("_before", F.lag(time).over(within))
        .where(F.col("_own") & F.col("_before").isNotNull())
        .withColumn(name, F.col(time) - F.col("_before"))
        .drop(SLICE, "_own", "_before")
    )


def difference_stats(
    deltas: DataFrame, *, name: str = "delta", by: list[str] | None = None
) -> DataFrame:
    """Count, mean, minimum and maximum of the differences."""
    return deltas.groupBy(*(by or [])).agg(
        F.count(name).alias("n"),
        F.avg(name).alias("avg_delta"),
        F.min(name).alias("min_delta"),
        F.max(name).alias("max_delta"),
    )


def packets_per_window(
    frame: DataFrame, time: str, *, width: str = "10 seconds", delay: str | None = None
) -> DataFrame:
    """Rows per time window. `delay` is the lateness a stream waits for."""
    if delay is not None:
        frame = frame.withWatermark(time, delay)
    return frame.groupBy(F.window(time, width).alias("w")).agg(
        F.count(F.lit(1)).alias("packets")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "packets")


def first_packets(packets: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first `n` packets in the given order: a bounded top-n while n is small, else by selection."""
    return select_first(packets, order, n)
