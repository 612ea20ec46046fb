import os

import pytest
from pyspark.sql import functions as F

from linktm import scratch
from linktm.fixtures import malformed_packets_from_events, packets_from_events, read_events
from linktm.operators import cells as C
from linktm.operators.decode import decode_packets, non_empty, quarantine, readable
from linktm.operators.points import points
from linktm.operators.series import packets_per_window
from linktm.sinks.stores import write_points
from linktm.sources import stores as R
from linktm.sources.messages import packet_batch, packet_stream
from linktm.streaming import ledger
from linktm.streaming.compaction import STORES, Run, merge_store, read_store, retire
from linktm.streaming.job import TelemetryJob, archive_stream, packet_counts

CLOCK_US = 1522920989746678


def clock():
    return F.timestamp_micros(F.lit(CLOCK_US))


@pytest.fixture(scope="module")
def messages(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messages") / "in")
    malformed_packets_from_events(read_events(spark, tables)).repartitionByRange(
        3, "offset"
    ).write.parquet(folder)
    return folder


@pytest.fixture(scope="module")
def finished(spark, messages, tmp_path_factory):
    job = TelemetryJob(str(tmp_path_factory.mktemp("job")), clock=clock())
    stream = packet_stream(spark, "parquet", path=messages, maxFilesPerTrigger="1")
    run = job.start(stream, interval=None, name="telemetry")
    assert run.awaitTermination(300)
    return job, sorted(tuple(r) for r in packet_counts(spark, job).collect())


def batch_decoded(spark, messages):
    return decode_packets(non_empty(packet_batch(spark, "parquet", path=messages)), clock=clock())


def test_batches_are_counted(finished):
    _, counts = finished
    assert [batch for batch, _ in counts] == [0, 1, 2]
    assert sum(n for _, n in counts) == 1000


def test_stream_equals_batch(spark, messages, finished):
    job, _ = finished
    decoded = batch_decoded(spark, messages)
    want = points(readable(decoded))
    got = R.read_points(spark, job.points_path).select(*want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    columns = ["offset", "partition", "topic", "decode_status", "raw_packet_data"]
    bad, want = spark.read.parquet(job.quarantine_path).select(*columns), quarantine(decoded).select(*columns)
    assert bad.exceptAll(want).count() == want.exceptAll(bad).count() == 0


def test_row_numbers_run_through_the_batches(spark, messages, finished):
    job, _ = finished
    good = readable(batch_decoded(spark, messages)).count()
    numbers = (
        R.read_cells(spark, job.cells_path)
        .select(F.regexp_extract("row_key", r"Row(\d+)", 1).cast("int").alias("n"), "qualifier")
        .groupBy("n")
        .agg(F.count("qualifier").alias("cells"))
        .collect()
    )
    assert sorted(r.n for r in numbers) == list(range(2 * good))
    assert {r.cells for r in numbers} == {6}


def test_cells_are_restored_with_the_stored_catalogue(spark, messages, finished):
    job, _ = finished
    columns = C.catalog_columns(spark.read.parquet(job.catalog_path), "duration", "duration")
    wide = C.restore(
        R.read_cells(spark, job.cells_path), columns, "duration", "duration", version="batch_id"
    )
    want = readable(batch_decoded(spark, messages)).select("spw_ts_usec", "spw_duration")
    got = wide.select(F.col("timestamp").alias("spw_ts_usec"), F.col("eng").alias("spw_duration"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_ledger_totals(spark, messages, finished):
    job, _ = finished
    decoded = batch_decoded(spark, messages)
    good, bad = readable(decoded).count(), quarantine(decoded).count()
    totals = {
        r.sink: (r.rows, r.batches)
        for r in ledger.totals(ledger.read(spark, job.ledger_path)).collect()
    }
    assert totals == {"points": (2 * good, 3), "cells": (12 * good, 3), "quarantine": (bad, 3), "received": (1000, 3)}


def test_replayed_batch_changes_nothing(spark, messages, finished):
    job, _ = finished
    stores = (job.points_path, job.cells_path, job.quarantine_path)
    before = [spark.read.parquet(p).collect() for p in stores]
    # The middle batch's rows are those whose keys it wrote.
    offsets = spark.read.parquet(f"{job.quarantine_path}/batch_id=1").agg(
        F.min("offset"), F.max("offset")
    ).first()
    files = [f for f in packet_batch(spark, "parquet", path=messages).inputFiles()]
    middle = next(
        f for f in files
        if spark.read.parquet(f).where(F.col("offset") == offsets[0]).count()
    )
    job.write_batch(spark.read.parquet(middle), 1)
    after = [spark.read.parquet(p).collect() for p in stores]
    for one, two in zip(before, after):
        assert sorted(map(str, one)) == sorted(map(str, two))


def test_restart_continues_the_numbers(spark, tables, tmp_path):
    packets = packets_from_events(read_events(spark, tables))
    folder = str(tmp_path / "in")
    packets.where("offset < 400").coalesce(1).write.parquet(folder)
    job = TelemetryJob(str(tmp_path / "out"), clock=clock())
    job.start(packet_stream(spark, "parquet", path=folder), interval=None).awaitTermination(120)
    packets.where("offset >= 400").coalesce(1).write.mode("append").parquet(folder)
    job.start(packet_stream(spark, "parquet", path=folder), interval=None).awaitTermination(120)
    keys = R.read_cells(spark, job.cells_path).select("row_key").distinct()
    assert keys.count() == 2 * packets.count()
    assert sorted(
        r.next_row for r in ledger.read(spark, job.ledger_path).where("sink = 'cells'").collect()
    ) == [800, 2000]


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    job = TelemetryJob(str(tmp_path / "out"))
    run = job.start(packet_stream(spark, "parquet", path=str(tmp_path / "in")), interval=None)
    run.awaitTermination(60)
    assert packet_counts(spark, job).count() == 0
    assert ledger.totals(ledger.read(spark, job.ledger_path)).count() == 0


def test_batch_of_unreadable_packets_only(spark, tmp_path):
    frame = spark.createDataFrame(
        [("t", 0, i, bytearray(b"\x01\x02")) for i in range(5)],
        "topic string, partition int, offset bigint, value binary",
    )
    job = TelemetryJob(str(tmp_path / "out"))
    job.write_batch(frame, 0)
    job.write_batch(frame, 1)
    assert ledger.next_row(spark, job.ledger_path, 2) == 0
    assert spark.read.parquet(job.quarantine_path).count() == 10


def test_extra_sink_and_repartition(spark, messages, tmp_path):
    seen = []
    job = TelemetryJob(
        str(tmp_path / "out"),
        clock=clock(),
        extra_sinks={"copy": lambda frame, batch: seen.append((batch, frame.count()))},
    )
    stream = packet_stream(spark, "parquet", path=messages, repartition=3)
    job.start(stream, interval=None).awaitTermination(120)
    assert seen == [(0, readable(batch_decoded(spark, messages)).count())]


def test_archive_stream(spark, messages, tmp_path):
    stream = packet_stream(spark, "parquet", path=messages, maxFilesPerTrigger="1")
    path, checkpoint = str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    archive_stream(stream, path, checkpoint, interval=None).awaitTermination(120)
    archive_stream(stream, path, checkpoint, interval=None).awaitTermination(120)
    got = R.read_archive(spark, path)
    want = packet_batch(spark, "parquet", path=messages).select("key", "value")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_windows_of_a_stream(spark, messages, tmp_path):
    stream = packet_stream(spark, "parquet", path=messages)
    counts = packets_per_window(stream, "timestamp", width="1 day", delay="30 days")
    run = (
        counts.writeStream.format("memory").queryName("window_counts").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    assert spark.table("window_counts").agg(F.sum("packets")).first()[0] == 1000


def test_broker_options(spark):
    """Without the connector package the broker source fails by name, not earlier."""
    with pytest.raises(Exception, match="kafka"):
        packet_stream(spark, **{"kafka.bootstrap.servers": "broker:9092"})


def test_counts_outlive_the_progress_buffer(spark, tmp_path):
    """Every batch keeps its count, also when more ran than the query remembers, and no
    intermediate of a batch stays behind."""
    frame = spark.createDataFrame(
        [("t", 0, i, bytearray(b"\x01")) for i in range(3)],
        "topic string, partition int, offset bigint, value binary",
    )
    before = set(os.listdir(f"{scratch.shared_folder(spark)}/linktm")) if os.path.isdir(
        f"{scratch.shared_folder(spark)}/linktm") else set()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        job = TelemetryJob(str(tmp_path / "out"))
        for part in range(4):
            frame.where(F.col("offset") <= part).write.mode("append").parquet(str(tmp_path / "in"))
            job.start(packet_stream(spark, "parquet", path=str(tmp_path / "in")), interval=None).awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sorted(tuple(r) for r in packet_counts(spark, job).collect()) == [(0, 1), (1, 2), (2, 3), (3, 3)]
    assert set(os.listdir(f"{scratch.shared_folder(spark)}/linktm")) == before


def test_merged_stores_and_unfinished_batches(spark, tmp_path):
    """However far batches are merged, every store shows its committed batches; a batch that broke off after any
    of its sinks shows nowhere, and its repetition shows once. A row is written once a level."""
    packets = scratch.materialize(malformed_packets_from_events(read_events(spark, "/root/testdata/sf0.001")), "in")
    job = TelemetryJob(str(tmp_path / "out"), clock=clock())
    whole = TelemetryJob(str(tmp_path / "whole"), clock=clock())
    made: list[Run] = []
    for part in range(5):
        mine = packets.where(F.col("offset") % 16 == part)
        good = readable(job.decode(mine))
        # The first sink of the batch was written, the ledger was not.
        write_points(points(good), job.points_path, batch_id=part)
        if part:
            assert {r.batch_id for r in read_store(spark, job, "points").select("batch_id").collect()} == set(range(part))
        job.write_batch(mine, part)
        whole.write_batch(mine, part)
        for store in STORES:
            new = merge_store(spark, job, store, fanout=2)
            assert merge_store(spark, job, store, fanout=2) == []
            made += new if store == "cells" else []
            if part != 2:
                retire(spark, job, store, grace=0)
    assert [(r.level, r.first, r.last) for r in made] == [(1, 0, 1), (1, 2, 3), (2, 0, 3)]
    for store in STORES:
        want = R.read_cells(spark, getattr(whole, f"{store}_path"))
        columns = [c for c in want.columns if c not in ("started", "finished")]
        got = read_store(spark, job, store)
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
        folders = [f for f in os.listdir(getattr(job, f"{store}_path")) if f.startswith("batch_id=")]
        assert sorted(folders) == (["batch_id=3", "batch_id=4"] if store == "ledger" else ["batch_id=4"])
        assert os.listdir(f"{job.root}/merged/{store}-records") == ["level-2-batches-0-3"]
    rows = read_store(spark, job, "cells").where("batch_id < 4").count()
    assert sum(r.rows for r in made) == 2 * rows
    assert sorted(tuple(r) for r in packet_counts(spark, job).collect()) == sorted(tuple(r) for r in packet_counts(spark, whole).collect())


def test_a_merge_waits_for_the_ledger_and_for_readers(spark, tmp_path):
    packets = scratch.materialize(packets_from_events(read_events(spark, "/root/testdata/sf0.001")), "in")
    job = TelemetryJob(str(tmp_path / "out"), clock=clock())
    with pytest.raises(ValueError):
        read_store(spark, job, "points")
    for part in (0, 1, 3):
        (job if part < 3 else TelemetryJob(str(tmp_path / "other"))).write_batch(
            packets.where(F.col("offset") % 32 == part), part if part < 3 else 0
        )
    before = read_store(spark, job, "points")
    rows = before.count()
    assert [(r.first, r.last) for r in merge_store(spark, job, "points", fanout=2)] == [(0, 1)]
    retire(spark, job, "points")
    assert before.count() == rows == read_store(spark, job, "points").count()
    # No readable packet, hence no row in this store.
    assert merge_store(spark, job, "quarantine", fanout=2)[0].rows == 0
    retire(spark, job, "quarantine", grace=0)
    assert merge_store(spark, job, "points", fanout=2) == merge_store(spark, job, "cells", fanout=3) == []
    assert merge_store(spark, job, "cells", fanout=2, last_batch=0) == []


def test_a_batch_reads_its_source_once(spark, tmp_path):
    packets = scratch.materialize(malformed_packets_from_events(read_events(spark, "/root/testdata/sf0.001")), "in")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    job = TelemetryJob(str(tmp_path / "out"), clock=clock())
    job.write_batch(packets.mapInArrow(passed, packets.schema), 0)
    assert seen.value == packets.count() == packet_counts(spark, job).first().packets


class Broken(Exception):
    pass


@pytest.mark.parametrize("sink", ["points", "cells", "quarantine", "extra"])
def test_a_batch_that_breaks_off_behind_a_sink_shows_nowhere(spark, tmp_path, monkeypatch, sink):
    """Stopped once `sink` is written: readers of all stores see the batch before only, the repetition shows once."""
    packets = scratch.materialize(malformed_packets_from_events(read_events(spark, "/root/testdata/sf0.001")), "in")
    first, second = (packets.where(F.col("offset") % 20 == part) for part in (0, 1))
    job = TelemetryJob(str(tmp_path / "out"), clock=clock(), extra_sinks={"extra": lambda rows, _: rows.count()})

    def broken(*_, **__):
        raise Broken

    job.write_batch(first, 0)
    with monkeypatch.context() as patch:
        if sink == "points":
            patch.setattr("linktm.streaming.job.write_cells", broken)
        elif sink == "cells":
            patch.setattr("linktm.streaming.job.quarantine", broken)
        elif sink == "quarantine":
            patch.setitem(job.extra_sinks, "extra", broken)
        else:
            patch.setattr(ledger, "record", broken)
        with pytest.raises(Broken):
            job.write_batch(second, 1)
    written = {"points": 1, "cells": 2, "quarantine": 3, "extra": 3}[sink]
    stores = ("points", "cells", "quarantine")
    assert [os.path.exists(f"{job.root}/{s}/batch_id=1") for s in stores] == [n < written for n in range(3)]
    for store in STORES:
        assert {r.batch_id for r in read_store(spark, job, store).select("batch_id").collect()} == {0}
    job.write_batch(second, 1)
    decoded = job.decode(packets.where(F.col("offset") % 20 < 2))
    assert read_store(spark, job, "points").count() == points(readable(decoded)).count()
    assert read_store(spark, job, "quarantine").count() == quarantine(decoded).count()
    cells = read_store(spark, job, "cells")
    assert cells.count() == cells.select("row_key", "family", "qualifier").distinct().count()
    assert {r.batch_id for r in cells.select("batch_id").distinct().collect()} == {0, 1}
