from pyspark.sql import functions as F
import pytest

from linktm import scratch
from linktm.fixtures import packets_from_events, read_events
from linktm.operators import cells as C
from linktm.operators.decode import packet_values
from linktm.sinks import stores as K
from linktm.sources import stores as R
from linktm.sources.logs import (
    document_field,
    document_paths,
    log_documents,
    merged_schema,
    typed_documents,
    typed_field,
)


def test_topic_sink_skips_missing_packets(spark, tmp_path):
    frame = spark.createDataFrame(
        [(b"k", bytearray(b"a")), (b"k", None)], "key binary, value binary"
    )
    K.write_topic(packet_values(frame), "parquet", path=str(tmp_path / "t"))
    assert [bytes(r.value) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [b"a"]


def test_archive_grows_by_files(spark, tables, tmp_path):
    packets = packets_from_events(read_events(spark, tables))
    path = str(tmp_path / "a")
    K.write_archive(packets, path)
    first = {p.name for p in (tmp_path / "a").glob("part*")}
    K.write_archive(packets, path)
    assert first < {p.name for p in (tmp_path / "a").glob("part*")}
    assert R.read_archive(spark, path).count() == 2 * packets.count()


def test_archive_batch_is_replaced(spark, tmp_path):
    frame = spark.createDataFrame([(b"k", bytearray(b"v"))], "key binary, value binary")
    for _ in range(2):
        K.write_archive(frame, str(tmp_path / "a"), batch_id=3)
    assert R.read_archive(spark, str(tmp_path / "a")).count() == 1


def test_log_documents(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text('{"a": 1, "b": {"c": "t"}}\nnot json\n')
    rows = log_documents(spark, str(tmp_path / "logs"), "a int, b struct<c: string>").collect()
    assert [(r.doc.a, r.doc.b.c) for r in rows if r.doc.a is not None] == [(1, "t")]
    assert len(rows) == 2
    fields = log_documents(spark, str(tmp_path / "logs")).select(
        document_field("document", "$.b.c").alias("c")
    )
    assert {r.c for r in fields.collect()} == {"t", None}


def test_typed_documents(spark, tmp_path):
    lines = ['{"a": {"b": [[1], []]}, "c.d": 1}', '{"a": 2, "a": 3}', "", "7", "null", '{"it\'s": 1.5}']
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("\n".join(lines))
    documents = typed_documents(spark, str(tmp_path / "logs"))
    got = {(r.path, r.kind): r.n for r in document_paths(documents).collect()}
    assert got == {
        ("$", "object"): 2, ("$", "integer"): 1, ("$", "null"): 1,
        ("$.a", "object"): 1, ("$.a.b", "array"): 1, ("$.a.b[*]", "array"): 2, ("$.a.b[*][*]", "integer"): 1,
        ("$['c.d']", "integer"): 1, ("$['it\\'s']", "number"): 1,
    }
    fields = documents.select("document", typed_field("doc", "$.a.b[0][0]", "int").alias("v")).collect()
    assert {r.document: r.v for r in fields} == {line: 1 if line == lines[0] else None for line in lines}
    assert merged_schema(documents).first().merged == "VARIANT"
    none = typed_documents(spark, str(tmp_path / "none"))
    assert document_paths(none).count() == 0 and none.columns == ["document", "doc"]


def test_missing_log_path_is_empty(spark, tmp_path):
    frame = log_documents(spark, str(tmp_path / "none"), "a int")
    assert frame.count() == 0 and frame.columns == ["document", "doc"]


def test_json_lines_round_trip(spark, tmp_path):
    frame = spark.range(5).withColumn("name", F.concat(F.lit("n"), "id"))
    K.write_json_lines(frame, str(tmp_path / "j"))
    back = log_documents(spark, str(tmp_path / "j"), "id bigint, name string").select("doc.*")
    assert back.exceptAll(frame).count() == 0 and back.count() == 5


def test_shared_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session())


def test_files_of_cells_hold_separate_key_ranges(spark, tmp_path):
    """A narrow scan opens a fraction of the files."""
    path = str(tmp_path / "cells")
    cells = spark.range(8_000).select(
        F.format_string("duration.Row%012d", "id").alias("row_key"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("family"),
        F.lit("eng").alias("qualifier"),
        F.col("id").cast("string").alias("value"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_cells(cells.repartition(6), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = R.read_cells(spark, path)
    files = stored.groupBy("family", F.input_file_name().alias("file")).agg(
        F.min("row_key").alias("lo"), F.max("row_key").alias("hi")
    )
    for family in ("a", "b"):
        ranges = files.where(F.col("family") == family).orderBy("lo").collect()
        assert len(ranges) > 2 and all(x.hi < y.lo for x, y in zip(ranges, ranges[1:]))


def test_newest_cell_holds_and_tags_are_marked(spark, tmp_path):
    path = str(tmp_path / "cells")
    one = spark.createDataFrame([("k.Row1", "k", "eng", "9")], "row_key string, family string, qualifier string, value string")
    K.write_cells(one, path)
    K.write_cells(one.withColumn("value", F.lit("3")), path)
    assert C.restore(R.read_cells(spark, path), [("eng", "int64")], "k", "k").first().eng == 3
    points = spark.createDataFrame([("m", 1, 5, 7)], "measurement string, time int, port int, eng int")
    K.write_points(points, str(tmp_path / "p"), tags={"site": 4}, tag_columns=("port",))
    stored = R.read_points(spark, str(tmp_path / "p"))
    assert sorted(R.tag_columns(stored)) == ["port", "site"] and stored.first().port == "5"


def test_wide_rows_are_ranged_before_they_are_melted(spark, tmp_path):
    """A row moves once, not once a cell, and the files are those of cells that were ranged themselves."""
    rows = spark.range(6_000).select(
        F.format_string("k.Row%012d", "id").alias("row_key"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias(C.FAMILY),
        *(F.when(F.col("id") % 7 != n, F.col("id") + n).alias(f"c{n}") for n in range(9)),
    )
    moved = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_cells(
            rows.repartition(6),
            str(tmp_path / "wide"),
            version=1,
            melted=lambda ranged: C.melt(moved.append(ranged) or ranged),
        )
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    K.write_cells(C.melt(rows), str(tmp_path / "cells"), version=1)
    assert moved[0].columns == rows.columns
    stored = R.read_cells(spark, str(tmp_path / "wide"))
    want = R.read_cells(spark, str(tmp_path / "cells"))
    assert stored.columns == want.columns and sorted(stored.collect()) == sorted(want.collect())
    file = F.input_file_name().alias("file")
    for family in ("a", "b"):
        mine = stored.where(F.col("family") == family)
        ranges = mine.groupBy(file).agg(F.min("row_key").alias("lo"), F.max("row_key").alias("hi")).orderBy("lo").collect()
        assert len(ranges) > 2 and all(x.hi < y.lo for x, y in zip(ranges, ranges[1:]))
    for name in {r.file for r in stored.select(file).distinct().collect()}:
        keys = [r.row_key for r in spark.read.parquet(name).coalesce(1).collect()]
        assert keys == sorted(keys)


def test_restore_moves_a_row_once(spark, tmp_path):
    """Repeated cells, missing ones, columns that the catalogue lacks and nulls among the qualifiers."""
    cells = spark.createDataFrame(
        [
            ("k.Row1", "k", "a", "1", 5), ("k.Row1", "k", "a", "9", 4), ("k.Row1", "k", "b", "x", 4),
            ("k.Row2", "k", "a", "2", 1), ("k.Row2", "k", "a", "3", 1), ("k.Row3", "k", "z", "7", 1),
            ("k.Row4", "k", None, "7", 1), ("k.Row4", "k", "b", "y", 1), ("k.Row4", "k", None, "8", 1),
            ("k.Row5", "k", "a", "4", 2), ("k.Row5", "k", "a", "0", None), ("k.Row6", "k", "a", "6", 3), ("k.Row6", "k", "a", None, 4),
        ],
        f"row_key string, family string, qualifier string, value string, {C.VERSION} bigint",
    )
    wide = C.restore(cells, [("a", "int64"), ("b", "object")], "k", "k")
    assert sorted(map(tuple, wide.collect())) == [
        ("k.Row1", 1, "x"), ("k.Row2", 3, None), ("k.Row3", None, None), ("k.Row4", None, "y"), ("k.Row5", 4, None), ("k.Row6", None, None),
    ]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "qualifier" not in next(line for line in plan.splitlines() if "hashpartitioning" in line)
