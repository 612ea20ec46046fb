import pytest
from pyspark.sql import functions as F
from reference_decode import ccsds, packet

from linktm import schema as S
from linktm.functions import values as V
from linktm.operators import cells as C
from linktm.operators import points as P
from linktm.operators.decode import decode_packets, non_empty
from linktm.plans.data import messages
from linktm.sinks import stores as K
from linktm.sources import stores as R

CLOCK_US = 1522920989746678


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [
        (i, bytearray(packet(sec=1522920989 + i, payload=ccsds(telecommand=i % 2) if i % 3 else b"\xfe\x01\x4c")))
        for i in range(12)
    ]
    frame = spark.createDataFrame(rows, "offset bigint, value binary")
    return decode_packets(frame, clock=F.timestamp_micros(F.lit(CLOCK_US)))


def test_point_shapes(decoded):
    v1 = P.points(decoded)
    assert v1.columns[:5] == ["measurement", "time", "grounddate", "simulationdate", "localdate"]
    assert len(v1.columns) == 24
    assert set(P.tag_names()) <= set(v1.columns) and len(P.tag_names()) == 16
    assert P.points(decoded, optional=False).columns == [
        "measurement", "time", "confid", "eng", "dec", "raw", "unit",
    ]
    assert v1.count() == 24
    row = v1.where("measurement = 'payloadlength' and type = 'RMAP'").first()
    assert (row.eng, row.raw, row.unit, row.appid) == (3, "0x3", "bytes", None)
    assert (row.status_processed, row.status_alarm, row.sbd) == (True, False, "1.2")


def test_second_revision_points(spark):
    frame = spark.createDataFrame([(bytearray(packet(payload=ccsds())),)], "value binary")
    decoded = decode_packets(frame, variant="v2", clock=F.timestamp_micros(F.lit(CLOCK_US)))
    full = P.points(decoded, variant="v2")
    assert set(P.tag_names("v2")) <= set(full.columns) and len(P.tag_names("v2")) == 16
    row = full.where("measurement = 'duration'").withColumn("time", F.unix_micros("time")).first()
    assert row.time == CLOCK_US and row.SequenceCount == 9 and row.source == "TM"
    small = P.points(decoded, variant="v2", optional=False)
    assert small.select(F.unix_millis("time").alias("ms")).first().ms == CLOCK_US // 1000


def test_measurements_are_data(decoded):
    more = (*S.MEASUREMENTS, ("servicetype", "ccsds_service_type", "code"))
    assert P.points(decoded, measurements=more).count() == 36


def test_contract(spark):
    frame = spark.createDataFrame(
        [("12", "x", "7"), ("13", "2.5", "y")], "eng string, dec string, localdate string"
    )
    rows = P.conform_points(frame).collect()
    assert rows[0].asDict().keys() == {n for n, _ in P.CONTRACT_OPTIONAL}
    assert [(r.eng, r.dec, r.Localdate, r.raw) for r in rows] == [
        ("12", None, 7, None), ("13", 2.5, None, None),
    ]
    assert dict(P.conform_points(frame).dtypes)["timestamp"] == "timestamp"


def test_stored_points(spark, decoded, tmp_path):
    path = str(tmp_path / "points")
    K.write_points(P.points(decoded), path, tags={"station": "north"})
    K.write_points(P.points(decoded), path, tags={"station": "south"})
    scan = R.scan_measurement(spark, path, "duration")
    assert scan.count() == 24 and scan.select("station").distinct().count() == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(measurement" in plan
    listed = {r.name: r.points for r in R.list_measurements(R.read_points(spark, path)).collect()}
    assert listed == {"duration": 24, "payloadlength": 24}


def test_internal_measurement_is_not_listed(spark):
    frame = spark.createDataFrame(
        [("_internal", 1), ("a", 2)], "measurement string, s bigint"
    ).withColumn("time", F.timestamp_seconds("s"))
    assert [r.name for r in R.list_measurements(frame).collect()] == ["a"]


@pytest.mark.parametrize("profile", C.PROFILES)
def test_cells_round_trip(spark, profile, tmp_path):
    variant = "v2" if profile == "v2" else "v1"
    rows = [
        (i, bytearray(packet(sec=1522920989 + i, payload=ccsds() if i % 3 else b"\xfe\x01\x4c")))
        for i in range(12)
    ]
    frame = spark.createDataFrame(rows, "offset bigint, value binary")
    decoded = decode_packets(frame, variant=variant, clock=F.timestamp_micros(F.lit(CLOCK_US)))
    numbered = C.number_rows(decoded, ["offset"], rows_per_slice=4)
    wide = C.sequential_keys(C.cell_rows(numbered, profile))
    K.write_cells(C.melt(wide), str(tmp_path / "cells"))
    K.write_catalog(C.profile_catalog(wide, profile), str(tmp_path / "catalog"))
    K.write_catalog(C.profile_catalog(wide, profile), str(tmp_path / "catalog"))
    stored = R.read_cells(spark, str(tmp_path / "cells"))
    catalog = spark.read.parquet(str(tmp_path / "catalog"))
    key = C.KEY_V2 if profile == "v2" else "duration"
    columns = C.catalog_columns(catalog, key, "duration")
    assert [name for name, _ in columns] == C.content_columns(wide)
    back = C.restore(stored, columns, key, "duration")
    want = wide.where("measurement_no = 1").select("row_key", *C.content_columns(wide))
    assert back.dtypes == want.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_sequential_keys_run_through_the_measurements(decoded):
    cells = C.packet_cells(decoded, ["offset"], "v1", start=5)
    keys = {r.row_key for r in cells.select("row_key").distinct().collect()}
    assert keys == {f"payloadlength.Row{5 + i}" for i in range(12)} | {
        f"duration.Row{17 + i}" for i in range(12)
    }


def test_first_revision_without_time(decoded):
    qualifiers = {
        r.qualifier
        for r in C.packet_cells(decoded, ["offset"], "v1", compat=True).collect()
    }
    assert qualifiers == {"confid", "eng", "dec", "raw_packet_data", "unit"}


def test_rewritten_cells_and_lookup(spark):
    cells = spark.createDataFrame(
        [("k.Row1", "f", "a", "1", 0), ("k.Row1", "f", "a", "2", 1), ("k.Row10", "f", "a", "x", 0),
         ("k.ColumnType", "f", "a", "int64", 0), ("k2.Row1", "f", "a", "9", 0), ("k.Row1", "g", "a", "7", 0)],
        "row_key string, family string, qualifier string, value string, batch_id int",
    )
    wide = C.restore(cells, [("a", "int64")], "k", "f", version="batch_id")
    assert {(r.row_key, r.a) for r in wide.collect()} == {("k.Row1", 2), ("k.Row10", None)}
    assert C.get_row(cells, "k.Row1", "g").count() == 1
    assert C.range_scan(cells, "k.Row1", "k.Row10").count() == 3
    assert [r.row_key for r in C.key_ordered(C.data_rows(cells, "k", "f")).collect()] == [
        "k.Row1", "k.Row1", "k.Row10",
    ]


def test_key_range_reaches_the_files(spark, decoded, tmp_path):
    K.write_cells(C.packet_cells(decoded, ["offset"]), str(tmp_path / "c"))
    scan = C.data_rows(R.read_cells(spark, str(tmp_path / "c")), "duration", "duration")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_key,duration.Row)" in plan
    assert "LessThan(row_key,duration.Rox)" in plan


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_value_functions(spark):
    assert one(spark, V.rounded_millis(F.lit(1522920989), F.lit(746678112))) == pytest.approx(
        1522920989746.7, abs=1e-3
    )
    assert one(spark, F.unix_micros(V.utc_from_millis(F.lit(1522920989746.7)))) == 1522920989746700
    assert one(spark, F.unix_micros(V.parse_timestamp(F.lit("2018-04-05 09:36:29.746678")))) == CLOCK_US
    assert one(spark, V.parse_timestamp(F.lit("no time"))) is None
    assert one(spark, V.scaled_number(F.lit("1.5"))) == 1500.0
    assert one(spark, V.scaled_number(F.lit("x"))) is None
    assert one(spark, V.column_of(F.lit(V.qualified("cf", "a")))) == "a"
    assert one(spark, V.row_key("k", F.lit(7), 4)) == "k.Row0007"
    assert one(spark, V.row_key("k", F.lit(123456), 4)) == "k.Row123456"
    assert bytes(one(spark, V.typed_cell(V.cell_text(F.lit(bytes(200)), "binary"), "bytes"))) == bytes(200)
    assert one(spark, V.cell_text(F.lit(True), "boolean", python_booleans=True)) == "True"
    assert one(spark, V.typed_cell(F.lit("True"), "bool")) is True
    assert one(spark, V.typed_cell(F.lit("x"), "int64")) is None


@pytest.mark.parametrize("profile, variant", [("v1", "v1"), ("v1_optional", "v1"), ("v2", "v2")])
def test_numbering_stores_the_columns_of_the_profile_once(spark, tables, monkeypatch, profile, variant):
    from linktm.operators import slices
    from linktm.scratch import materialize

    packets = decode_packets(non_empty(messages(spark, tables)), variant=variant)
    order = ["offset", "partition", "topic"]
    stored = []
    monkeypatch.setattr(slices, "materialize", lambda f, n: (stored.append((n, set(f.columns))), materialize(f, n))[1])
    C.packet_cells(packets, order, profile, stored=True)
    wanted = C.profile_inputs(profile) | set(order) | {slices.SLICE, slices.INSIDE}
    assert [n for n, _ in stored] == ["slices"] and stored[0][1] == wanted
    assert len(wanted) < 16 < len(packets.columns)
