"""Joins of many rows with one row per key, where a few keys may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of the rows, so at most HOT_KEYS keys are.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n_rows: int) -> DataFrame:
    """Inner join of `rows` with `counted` on `keys`. `counted` has one row per key and `rows_here`, the
    number of its rows. Hot keys, at most HOT_KEYS, are sent to every task and move no row; of
    the others none holds more than 1 / HOT_KEYS of the rows that are shuffled."""
    hot = F.col("rows_here") * HOT_KEYS >= n_rows
    few = F.broadcast(counted.where(hot))
    near = rows.join(few, keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(counted.where(~hot), keys)).drop("rows_here")
