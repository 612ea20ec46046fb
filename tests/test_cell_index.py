import pytest
from pyspark.sql import functions as F

from linktm.scratch import remove
from linktm.sinks import stores as K
from linktm.sources import stores as R
from linktm.sources.cell_index import files_of_keys, get_rows, index_cells

ROWS = 4_000


def some_cells(spark, first=0, rows=ROWS):
    """Even row numbers only; two cells a row."""
    ids = spark.range(first, first + rows).select(
        F.format_string("duration.Row%08d", F.col("id") * 2).alias("row_key"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("family"),
        F.explode(F.array(F.lit("eng"), F.lit("unit"))).alias("qualifier"),
        F.col("id").cast("string").alias("value"),
    )
    return ids.repartition(6)


def key(number):
    return f"duration.Row{number:08d}"


def digest(frame):
    return sorted(tuple(r) for r in frame.select("row_key", "family", "qualifier", "value").collect())


@pytest.fixture
def store(spark, tmp_path):
    path, index = str(tmp_path / "cells"), str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_cells(some_cells(spark), path)
        K.write_cells(some_cells(spark, first=ROWS), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, index


def test_gets_open_the_files_of_their_keys_only(spark, store):
    path, index = store
    files = R.read_cells(spark, path).inputFiles()
    assert len(files) > 12 and index_cells(spark, path, index) == len(files)
    assert index_cells(spark, path, index) == 0
    keys = [key(2 * n) for n in (0, 7, 7, 1999, ROWS, 2 * ROWS - 1)] + [key(3), "", "zzz", "é"]
    got = get_rows(spark, path, index, keys)
    want = R.read_cells(spark, path).where(F.col("row_key").isin(keys))
    assert digest(got) == digest(want) and len(digest(want)) == 10
    holding = {r[0] for r in want.select(F.input_file_name()).collect()}
    assert holding <= set(got.inputFiles()) and len(got.inputFiles()) <= len(holding) + 1
    assert digest(get_rows(spark, path, index, keys, "a")) == digest(want.where("family = 'a'"))
    assert got.columns == R.read_cells(spark, path).columns


def test_absent_keys_open_no_file(spark, store):
    path, index = store
    index_cells(spark, path, index)
    absent = [key(2 * n + 1) for n in range(0, 2 * ROWS, 160)]
    files = files_of_keys(spark, path, index, absent)
    # 50 keys in the ranges of two files each, 1 in 2,000 of them by chance.
    assert len(files) <= 2
    assert files_of_keys(spark, path, index, ["a", "zz"]) == files_of_keys(spark, path, index, []) == []
    none = get_rows(spark, path, index, ["a", "zz"])
    assert none.count() == 0 and "FileScan" not in none._jdf.queryExecution().executedPlan().toString()


def test_files_that_came_or_went_since(spark, store):
    path, index = store
    keys = [key(0), key(4 * ROWS)]
    # Without an index every file is looked at.
    assert digest(get_rows(spark, path, index, keys)) == digest(
        R.read_cells(spark, path).where(F.col("row_key").isin(keys))
    )
    index_cells(spark, path, index)
    K.write_cells(some_cells(spark, first=2 * ROWS, rows=10), path)
    rows = get_rows(spark, path, index, keys)
    assert {r.row_key for r in rows.collect()} == set(keys)
    assert 0 < index_cells(spark, path, index) <= 12
    assert index_cells(spark, path, index) == 0
    gone = {r[0] for r in R.read_cells(spark, path).where(F.col("row_key") == key(0)).select(F.input_file_name()).collect()}
    for file in gone:
        remove(spark, file)
    assert [r.row_key for r in get_rows(spark, path, index, keys).select("row_key").distinct().collect()] == [key(4 * ROWS)]


def test_batches_of_a_stream_and_broken_runs_of_the_index(spark, store, tmp_path):
    _, index = store
    path = str(tmp_path / "batches")
    for batch in (0, 1):
        K.write_cells(some_cells(spark, rows=50).withColumn("value", F.lit(str(batch))), path, batch_id=batch)
    index_cells(spark, path, index)
    # A run that wrote filters and no ranges: they are written once more.
    remove(spark, f"{index}/spans")
    assert index_cells(spark, path, index) > 0
    rows = get_rows(spark, path, index, [key(10)])
    assert {(r.batch_id, r.value) for r in rows.collect()} == {(0, "0"), (1, "1")}
