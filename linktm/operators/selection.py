"""The first n rows of an order by selection: no sort of the table and no task that holds n rows.

A few keys taken at random cut the table into ranges; the rows of each range are counted, and only the range in
which the n-th key lies is cut again. Once that key is known the answer is a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktm.operators.slices import PLACE_BITS
from linktm.scratch import materialize

BORDERS = 64
# Up to this many rows Spark's bounded top-n is one pass.
TOP = 1_000


def _numbered_cut(rows: DataFrame, n: int) -> DataFrame:
    """Any `n` of `rows`, in no order: rows are stored, and numbered by stored part and place."""
    stored = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ties")
    part = F.shiftright("_at", PLACE_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per part of the tied rows.
    before = 0
    takes = []
    for row in sizes.orderBy("_part").collect():
        takes.append((row["_part"], max(0, min(row["_rows"], n - before))))
        before += row["_rows"]
    take = rows.sparkSession.createDataFrame(takes, "_part bigint, _take bigint")
    inside = F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    placed = stored.withColumns({"_part": part, "_inside": inside}).join(take, "_part")
    return placed.where(F.col("_inside") < F.col("_take")).select(*rows.columns)


def _border(borders: DataFrame, place: int) -> DataFrame:
    return borders.select(F.col("borders")[place].alias("key"))


def nth_key(keys: DataFrame, n: int) -> tuple[DataFrame, int, int] | None:
    """The n-th smallest `key` of `keys`, from 1, as a frame of one row, how many of the first n rows have it
    and how many rows have it in all; None where there are fewer rows. Each round reads the keys twice, and
    the range it leaves, some 1 / BORDERS of the rows, is stored for the next."""
    inside, rank = keys, n
    while True:
        sample = inside.orderBy(F.rand(seed=rank)).limit(BORDERS)
        borders = materialize(sample.agg(F.array_sort(F.collect_set("key")).alias("borders")), "borders")
        placed = inside.select("key", borders.scalar().alias("borders")).select(
            F.size(F.filter("borders", lambda b: b < F.col("key"))).alias("below"),
            F.size(F.filter("borders", lambda b: b <= F.col("key"))).alias("upto"),
        )
        # At most 2 * BORDERS + 1 rows.
        counts = placed.groupBy("below", "upto").count().orderBy("below", "upto").collect()
        found = None
        for row in counts:
            if rank <= row["count"]:
                found = row
                break
            rank -= row["count"]
        if found is None:
            return None
        if found.below < found.upto:
            return _border(borders, found.below), rank, found["count"]
        if found.below > 0:
            inside = inside.where(F.col("key") > _border(borders, found.below - 1).scalar())
        if found.below < counts[-1].upto:
            inside = inside.where(F.col("key") < _border(borders, found.below).scalar())
        inside = materialize(inside, "range")


def select_first(frame: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first `n` rows of `frame` in the order of `order` (ascending, nulls first, NaN last), in no order.

    Where several rows have the n-th key, any of them fill the number up. Fewer rows than n: all. n of 0 or
    less: none. `frame` must follow from stored data alone, as it is read several times, the key columns only until the
    last.
    """
    if n <= TOP:
        return frame.orderBy(*order).limit(max(n, 0))
    key = F.struct(*order)
    nth = nth_key(frame.select(key.alias("key")), n)
    if nth is None:
        return frame
    row, wanted, tied = nth
    border = row.scalar()
    if wanted == tied:
        return frame.where(key <= border)
    return frame.where(key < border).unionByName(_numbered_cut(frame.where(key == border), wanted))
