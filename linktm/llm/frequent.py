"""The most frequent keys of a table of counts, without a sort of all of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Steps per doubling of a count: at most 64 * STEPS rows reach the driver.
STEPS = 16


def step_of(n: Column | str) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def least_step(counts: DataFrame, limit: int) -> float:
    """The step from which on the rows of `counts` (n > 0) are at most `limit`, as many whole steps as that allows."""
    sizes = counts.groupBy(step_of("n").alias("step")).count().collect()
    total, least = 0, math.inf
    for r in sorted(sizes, key=lambda r: -r.step):
        total += r["count"]
        if total > limit:
            break
        least = r.step
    return float(least)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of `counts` (n > 0) with the largest `n`, as many whole steps of counts as hold at most
    `limit` rows together."""
    return counts.where(step_of("n") >= F.lit(least_step(counts, limit)))
