"""Shapes of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from linktm.operators import cells as C
from linktm.operators.decode import decode_packets, non_empty
from linktm.operators.points import points
from linktm.operators.series import consecutive_difference, difference_stats
from linktm.plans.data import messages


def plan(frame):
    frame._jdf.queryExecution().assertAnalyzed()
    return frame._jdf.queryExecution().executedPlan().toString()


def largest_method(spark, frame):
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")
    text = debug.codegenString(frame._jdf.queryExecution().executedPlan())
    return max(int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.fixture(scope="module")
def decoded(spark, tables):
    return decode_packets(non_empty(messages(spark, tables)))


@pytest.mark.parametrize("variant", ["v1", "v2"])
@pytest.mark.parametrize("compat", [False, True])
def test_decode_is_one_compiled_stage(spark, tables, variant, compat):
    frame = decode_packets(non_empty(messages(spark, tables)), variant=variant, compat=compat)
    text = plan(frame)
    assert "Exchange" not in text and "Python" not in text
    assert set(re.findall(r"\*\((\d+)\)", text)) == {"1"}
    # Above 8000 bytes the JVM leaves a method uncompiled.
    assert largest_method(spark, frame) < 8000


def test_unused_fields_are_not_decoded(decoded):
    assert plan(decoded).count("conv(") == 8
    assert plan(decoded.select("spw_ts_usec")).count("conv(") == 1
    assert "ReadSchema: struct<value:binary>" in plan(decoded.select("type"))


def test_points_take_one_pass_without_shuffle(decoded):
    text = plan(points(decoded))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Python" not in text


def single_partition_inputs(text):
    """Operators right below every move to a single partition."""
    lines = text.splitlines()
    return [lines[i + 1].strip() for i, l in enumerate(lines) if "Exchange SinglePartition" in l]


def test_differences_move_rows_once(decoded):
    series = decoded.select("spw_port_name", "spw_ts_nsec", "offset")
    for by in ([], ["spw_port_name"]):
        deltas = consecutive_difference(
            series, "spw_ts_nsec", by=by, tie=["offset"], rows_per_slice=100
        )
        text = plan(deltas)
        # Above the union of rows and slice borders there is one exchange; below it,
        # only aggregates are exchanged.
        above, below = text.split("Union", 1)
        assert above.count("Exchange") == 1
        lines = below.splitlines()
        moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert moved and all("Aggregate" in line for line in moved)
        # Without a series column, the table of slices is ordered in one place.
        assert len(single_partition_inputs(text)) == (0 if by else 1)
        assert "Join" not in text and "CartesianProduct" not in text and "Python" not in text


def test_row_numbers_move_rows_once(decoded):
    order = ["offset", "partition", "topic"]
    text = plan(C.number_rows(decoded.select(*order), order, rows_per_slice=100))
    assert single_partition_inputs(text)
    assert all("Aggregate" in below for below in single_partition_inputs(text))
    assert "NestedLoop" not in text


def test_statistics_combine_before_the_shuffle(decoded):
    series = decoded.select("spw_port_name", "spw_ts_usec", "offset")
    deltas = consecutive_difference(series, "spw_ts_usec", by=["spw_port_name"], tie=["offset"], rows_per_slice=100)
    text = plan(difference_stats(deltas, by=["spw_port_name"]))
    assert "partial_avg" in text


def test_melt_and_restore_need_one_shuffle_at_most(spark, decoded):
    rows = C.index_keys(C.cell_rows(decoded), "timestamp")
    assert "Exchange" not in plan(C.melt(rows))
    cells = spark.createDataFrame([], "row_key string, family string, qualifier string, value string")
    wide = C.restore(cells, [("a", "int64")], "k", "f")
    assert plan(wide).count("Exchange hashpartitioning") == 1
