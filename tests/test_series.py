import math
import random

import pytest
from pyspark.sql import functions as F

from linktm.operators.series import (
    combine,
    consecutive_difference,
    difference_stats,
    first_packets,
    packets_per_window,
)
from linktm.operators.slices import SLICE, dense_row_id, slice_by, slice_count
from linktm.scratch import materialize

N = 6_000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one microsecond, and half of them in one series."""
    r = random.Random(5)
    rows = []
    for i in range(N):
        time = 1_000_000 if r.random() < 1 / 3 else r.randrange(3_000_000)
        rows.append((i, time, "hot" if r.random() < 0.5 else f"s{r.randrange(7)}"))
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "id bigint, ts bigint, series string")
    return rows, frame.repartition(5)


def test_slices_are_balanced_and_ordered(skewed):
    rows, frame = skewed
    slices = slice_by(frame, ["ts", "id"], rows_per_slice=200)
    sizes = [
        r for r in slices.groupBy(SLICE).agg(
            F.count("id").alias("n"), F.min(F.struct("ts", "id")).alias("lo"),
            F.max(F.struct("ts", "id")).alias("hi"),
        ).orderBy(SLICE).collect()
    ]
    assert len(sizes) <= slice_count(N, 8, 200) == 30
    assert max(s.n for s in sizes) < 3 * N / 30
    for left, right in zip(sizes, sizes[1:]):
        assert left.hi < right.lo


@pytest.mark.parametrize("rows_per_slice", [100, 1_000, 10**9])
def test_dense_row_id(skewed, rows_per_slice):
    rows, frame = skewed
    got = dense_row_id(
        frame, ["ts", "id"], total="n", start=7, rows_per_slice=rows_per_slice
    ).collect()
    want = {i: place + 7 for place, (_, i) in enumerate(sorted((t, i) for i, t, _ in rows))}
    assert {r.id: r.row_id for r in got} == want
    assert {r.n for r in got} == {N}


@pytest.mark.parametrize("rows_per_slice", [100, 10**9])
def test_global_difference(skewed, rows_per_slice):
    rows, frame = skewed
    got = consecutive_difference(frame, "ts", tie=["id"], rows_per_slice=rows_per_slice)
    line = sorted((t, i) for i, t, _ in rows)
    want = {b[1]: b[0] - a[0] for a, b in zip(line, line[1:])}
    assert {r.id: r.delta for r in got.collect()} == want


@pytest.mark.parametrize("rows_per_slice", [100, 10**9])
def test_difference_per_series(skewed, rows_per_slice):
    rows, frame = skewed
    got = consecutive_difference(
        frame, "ts", by=["series"], tie=["id"], rows_per_slice=rows_per_slice
    )
    want = {}
    for name in {s for _, _, s in rows}:
        line = sorted((t, i) for i, t, s in rows if s == name)
        want |= {b[1]: b[0] - a[0] for a, b in zip(line, line[1:])}
    assert {r.id: r.delta for r in got.collect()} == want


def test_hot_times_are_cut_by_the_whole_key(spark):
    """Two hot times, one inside the other's neighbourhood, and a constant frame."""
    rows = [(i, 500 if i % 3 else (501 if i % 2 else i)) for i in range(3_000)]
    for data in (rows, [(i, 7) for i in range(2_000)]):
        frame = spark.createDataFrame(data, "id bigint, ts bigint").repartition(4)
        slices = slice_by(frame, ["ts", "id"], rows_per_slice=100)
        sizes = [r["count"] for r in slices.groupBy(SLICE).count().collect()]
        assert len(sizes) > len(data) / 100 / 2 and max(sizes) < 300
        got = dense_row_id(frame, ["ts", "id"], rows_per_slice=100)
        want = {i: n for n, (_, i) in enumerate(sorted((t, i) for i, t in data))}
        assert {r.id: r.row_id for r in got.collect()} == want


def test_times_beyond_double_precision(spark):
    """Neighbouring nanoseconds share a double but keep their order."""
    base = 1_704_067_207_179_575_000
    data = [(i, base + i // 2) for i in range(4_000)]
    frame = spark.createDataFrame(data, "id bigint, ts bigint").repartition(4)
    got = dense_row_id(frame, ["ts", "id"], rows_per_slice=50)
    assert all(r.id == r.row_id for r in got.collect())
    deltas = consecutive_difference(frame, "ts", tie=["id"], rows_per_slice=50).collect()
    assert sorted((r.id, r.delta) for r in deltas) == [(i, (i + 1) % 2) for i in range(1, 4_000)]


def test_timestamps_and_missing_times(spark):
    data = [(i, i * 1_000_003) for i in range(2_500)] + [(9_000 + i, None) for i in range(3)]
    frame = spark.createDataFrame(data, "id bigint, us bigint").withColumn(
        "ts", F.timestamp_micros("us")
    )
    got = {r.id: r.row_id for r in dense_row_id(frame, ["ts", "id"], rows_per_slice=100).collect()}
    assert got == {9_000: 0, 9_001: 1, 9_002: 2} | {i: i + 3 for i in range(2_500)}
    hot = frame.withColumn("ts", F.timestamp_micros(F.lit(1_522_920_989_746_678)))
    slices = slice_by(hot, ["ts", "id"], rows_per_slice=100)
    assert max(r["count"] for r in slices.groupBy(SLICE).count().collect()) < 300
    deltas = consecutive_difference(frame, "us", tie=["id"], rows_per_slice=100)
    assert deltas.count() == 2_499 and {r.delta for r in deltas.collect()} == {1_000_003}


def test_missing_series_name_is_a_series(spark):
    rows = [(1, 10, None), (2, 30, None), (3, 15, "a"), (4, 16, "a")]
    frame = spark.createDataFrame(rows, "id int, ts bigint, series string")
    got = consecutive_difference(frame, "ts", by=["series"], tie=["id"])
    assert {r.id: r.delta for r in got.collect()} == {2: 20, 4: 1}


def test_empty_and_single_rows(spark):
    frame = spark.createDataFrame([], "id bigint, ts bigint")
    assert consecutive_difference(frame, "ts", tie=["id"]).count() == 0
    assert dense_row_id(frame, ["ts", "id"]).count() == 0
    one = spark.createDataFrame([(1, 5)], "id bigint, ts bigint")
    assert consecutive_difference(one, "ts", tie=["id"]).count() == 0
    assert dense_row_id(one, ["ts", "id"]).first().row_id == 0


def test_combined_series_statistics(spark):
    a = spark.createDataFrame([(1, 10), (2, 40)], "id int, ts bigint")
    b = spark.createDataFrame([(3, 25), (4, 10)], "id int, ts bigint")
    both = combine(a, b)
    assert both.count() == 4
    row = difference_stats(consecutive_difference(both, "ts", tie=["id"])).first()
    assert (row.n, row.min_delta, row.max_delta) == (3, 0, 15)
    assert math.isclose(row.avg_delta, 10.0)


def test_windows_and_first(spark):
    frame = spark.createDataFrame(
        [(i, i * 4) for i in range(10)], "offset bigint, s bigint"
    ).withColumn("time", F.timestamp_seconds("s"))
    counts = packets_per_window(frame, "time").orderBy("window_start").collect()
    assert [c.packets for c in counts] == [3, 2, 3, 2]
    assert [r.offset for r in first_packets(frame, ["offset"], 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("n", [1_001, 2_857, 2_858, 5_000, 19_999, 20_000, 20_001])
def test_first_by_selection(spark, n):
    """Nulls come first, a whole key decides, and rows that share the last key fill the number up."""
    number = F.col("id")
    frame = materialize(
        spark.range(20_000).select(
            F.when(number % 7 != 0, number % 50).alias("a"), (number * 7_919 % 20_011).alias("b"), "id"
        ),
        "rows",
    )

    def key(row):
        return row.a is not None, row.a or 0, row.b

    rows = sorted(frame.collect(), key=key)
    whole = first_packets(frame, ["a", "b"], n)
    assert sorted(whole.collect(), key=key) == rows[:n]
    assert "TakeOrdered" not in whole._jdf.queryExecution().toString()
    tied = first_packets(frame, ["a"], n).collect()
    assert len({r.id for r in tied}) == len(tied) == min(n, 20_000)
    assert sorted(key(r)[:2] for r in tied) == [key(r)[:2] for r in rows[:n]]


def test_slices_follow_the_rows_without_a_limit():
    assert slice_count(0, 8) == slice_count(1, 8) == 1
    assert slice_count(10**6, 8) == 32
    assert slice_count(10**12, 8) == 250_000 and slice_count(10**13, 8) == 2_500_000


def test_any_first_column_and_nan(spark):
    values = [math.nan, 2.0, None, -math.inf, 1.0, math.nan] * 300
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, "id bigint, x double")
    got = {r.id: r.row_id for r in dense_row_id(frame, ["x", "id"], rows_per_slice=100).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, math.isnan(r[1] or 0.0), 0 if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
    assert got == {i: n for n, (i, _) in enumerate(order)}
    named = frame.withColumn("name", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")))
    assert {r.id: r.row_id for r in dense_row_id(named, ["name"]).collect()} == {i: i for i, _ in rows}


@pytest.mark.parametrize("operator", ["numbers", "differences"])
def test_the_input_is_evaluated_once(spark, operator):
    """Every evaluation of the input adds its rows to the counter."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.range(5_000).select("id", (F.col("id") * 3).alias("ts"))
    counted = frame.mapInArrow(count, "id bigint, ts bigint")
    if operator == "numbers":
        dense_row_id(counted, ["ts", "id"], rows_per_slice=500).count()
    else:
        consecutive_difference(counted, "ts", tie=["id"], rows_per_slice=500).count()
    assert seen.value == 5_000
