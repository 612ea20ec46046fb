import random
import uuid

import pytest
from reference_decode import ccsds, packet

from linktm.fixtures import packets_from_events, read_events, write_capture_files
from linktm.scratch import materialize
from linktm.sources import capture
from linktm.sources.capture_index import capture_index, chunk_size, read_captures

HEADER = bytes(24)


def write(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.pcap").write_bytes(content)
    return str(folder)


def sequential(content, mask=0x0FFFFFFF):
    """(number, offset, bytes) by walking the file once."""
    found, at = [], 24
    while at < len(content):
        size = 40 + (int.from_bytes(content[at + 28 : at + 32], "little") & mask)
        found.append((len(found), at, content[at : at + size]))
        at += size
    return found


def as_rows(frame):
    return sorted((r.record_no, r.byte_offset, bytes(r.value)) for r in frame.collect())


def some_packets(n, seed=1, largest=300):
    r = random.Random(seed)
    return [
        packet(sec=1522920989 + i, nanos=r.randrange(10**9), payload=r.randbytes(r.randint(0, largest)))
        for i in range(n)
    ]


def test_whole_file(spark, tmp_path):
    content = HEADER + b"".join(some_packets(50))
    path = write(tmp_path, one=content)
    assert as_rows(capture.read_whole_files(spark, path)) == sequential(content)
    assert as_rows(capture.read_whole_files(spark, path, first=7)) == sequential(content)[:7]


def test_several_files_and_odd_ones(spark, tmp_path):
    whole = HEADER + b"".join(some_packets(20))
    path = write(
        tmp_path, a=whole, b=whole[:-9], empty=b"", stub=HEADER[:5], header=HEADER,
        tail=HEADER + packet()[:30],
    )
    for read in (capture.read_whole_files, read_captures):
        frame = read(spark, path)
        assert frame.count() == 20 + 20 + 1
        tails = {
            r.path.rsplit("/", 1)[1]: bytes(r.value)
            for r in frame.collect() if r.record_no in (0, 19)
        }
        assert tails["tail.pcap"] == packet()[:30]
        assert tails["b.pcap"] == sequential(whole)[19][2][:-9]


def test_unmasked_lengths(spark, tmp_path):
    marked = packet(payload=b"abcd", declared=0xF0000004)
    content = HEADER + marked + packet(payload=b"xyz")
    path = write(tmp_path, one=content)
    assert capture.read_whole_files(spark, path).count() == 2
    assert as_rows(capture.read_whole_files(spark, path, compat=True)) == sequential(
        content, 0xFFFFFFFF
    )
    assert read_captures(spark, path, compat=True).count() == 1


def test_packet_larger_than_a_block(tmp_path, monkeypatch):
    monkeypatch.setattr(capture, "BLOCK", 64)
    content = HEADER + b"".join(some_packets(30, largest=500))
    (tmp_path / "x.pcap").write_bytes(content)
    got = [
        row
        for batch in capture.frame_range(str(tmp_path / "x.pcap"), 24, None, 0)
        for row in batch.to_pylist()
    ]
    assert [(r["record_no"], r["byte_offset"], r["value"]) for r in got] == sequential(content)


@pytest.mark.parametrize("chunk", [100, 1_000, 10_000])
def test_split_file_equals_one_scan(spark, tmp_path, chunk):
    content = HEADER + b"".join(some_packets(400, largest=250))
    path = write(tmp_path, one=content, two=content[: len(content) // 2])
    got = read_captures(spark, path, chunk_bytes=chunk)
    one = as_rows(got.where("path like '%one.pcap'"))
    two = as_rows(got.where("path like '%two.pcap'"))
    assert one == sequential(content)
    assert two == sequential(content[: len(content) // 2])


def test_misleading_payloads_are_corrected(spark, tmp_path):
    """Payloads that hold whole packets invite wrong guesses at every border."""
    inner = b"".join(some_packets(8, seed=2, largest=20))
    content = HEADER + b"".join(packet(sec=1522920989, payload=inner[i:]) for i in range(60))
    path = write(tmp_path, one=content)
    assert as_rows(read_captures(spark, path, chunk_bytes=600)) == sequential(content)


def test_unguessable_borders(spark, tmp_path):
    """Sub-second fields above any plausible value: no border can be guessed."""
    content = HEADER + b"".join(packet(nanos=2**32 - 1, payload=b"abcd") for _ in range(40))
    path = write(tmp_path, one=content)
    assert as_rows(read_captures(spark, path, chunk_bytes=500)) == sequential(content)


def test_index_covers_every_record_once(spark, tmp_path):
    content = HEADER + b"".join(some_packets(300))
    path = write(tmp_path, one=content)
    ranges = capture_index(spark, path, chunk_bytes=2_000).orderBy("chunk").collect()
    assert sum(r.records for r in ranges) == 300
    assert [r.first for r in ranges] == [
        sum(x.records for x in ranges[:i]) for i in range(len(ranges))
    ]


def test_chunk_size_bounds(spark):
    assert chunk_size(spark, [10]) == 64 << 10
    assert chunk_size(spark, [1 << 50]) == 128 << 20


def test_folder_as_uri(spark, tmp_path):
    path = write(tmp_path, one=HEADER + b"".join(some_packets(5)))
    for uri in (f"file:{path}", f"file://{path}", path):
        assert read_captures(spark, uri).count() == 5
        assert capture.read_whole_files(spark, uri).count() == 5


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        capture.capture_files(str(tmp_path / "none"))


def test_round_trip_of_the_event_packets(spark, tables, tmp_path):
    packets = packets_from_events(read_events(spark, tables))
    folder = str(tmp_path / uuid.uuid4().hex)
    write_capture_files(packets.repartition(3, "offset"), folder)
    got = read_captures(spark, folder, chunk_bytes=3_000).select("value")
    assert got.exceptAll(packets.select("value")).count() == 0
    assert got.count() == packets.count()


def test_ccsds_helper_is_16_bytes_at_least():
    assert len(ccsds(data=b"")) == 16


def count_framings(monkeypatch):
    """Rows of every index table: framings of chunks, by table."""
    from linktm.sources import capture_index as module

    written = []

    def counted(frame, name):
        stored = materialize(frame, name)
        written.append((name, stored.count()))
        return stored

    monkeypatch.setattr(module, "materialize", counted)
    return written


def look_alikes(n):
    inner = b"".join(some_packets(8, seed=2, largest=20))
    return [packet(sec=SECOND, payload=inner[i % 50 :]) for i in range(n)]


SECOND = 1522920989
UNGUESSABLE = [packet(nanos=2**32 - 1, payload=b"abcd" * 5) for _ in range(500)]
ODD_SIZES = [packet(nanos=2**32 - 1, payload=random.Random(i).randbytes(i * 37 % 211)) for i in range(400)]


@pytest.mark.parametrize("packets", [UNGUESSABLE, ODD_SIZES, look_alikes(300)], ids=["alike", "odd", "look-alikes"])
def test_chunks_are_framed_twice_at_most(spark, tmp_path, monkeypatch, packets):
    """250 chunks without a guess, or with wrong ones."""
    content = HEADER + b"".join(packets)
    path = write(tmp_path, one=content)
    written = count_framings(monkeypatch)
    size = len(content) // 250
    ranges = capture_index(spark, path, chunk_bytes=size).collect()
    assert len(ranges) >= 250 and sum(r.records for r in ranges) == len(packets)
    framings = sum(n for name, n in written if name in ("capture-index", "capture-bridges"))
    assert framings <= 2 * len(ranges)
    places = {at: n for n, at, _ in sequential(content)}
    assert all(places[r.entry] == r.first for r in ranges if r.records)


def test_no_task_leaves_its_chunk(tmp_path, monkeypatch):
    """Bytes that a bridge reads, from an entry that never meets the guess."""
    content = HEADER + b"".join(UNGUESSABLE)
    (tmp_path / "x.pcap").write_bytes(content)
    framed = []
    whole = capture.measure_range
    monkeypatch.setattr(capture, "measure_range", lambda p, a, b, m: framed.append((a, b)) or whole(p, a, b, m))
    chunk = {"chunk": 1, "stop": 6000, "guess": 3333, "records": 5, "following": 6010}
    row = {"path": str(tmp_path / "x.pcap"), "entry": 3024, "chunks": [chunk], "masked": True}
    import pyarrow as pa

    (got,) = capture.bridge_ranges(iter([pa.RecordBatch.from_pylist([row])]))
    starts = [at for _, at, _ in sequential(content) if 3024 <= at < 6000]
    assert got.to_pylist()[0]["records"] == len(starts) and all(b <= 6000 for _, b in framed)


def test_a_packet_over_many_chunks(spark, tmp_path):
    content = HEADER + b"".join([*some_packets(5), packet(payload=bytes(20_000)), *some_packets(5, seed=4)])
    path = write(tmp_path, one=content)
    assert as_rows(read_captures(spark, path, chunk_bytes=700)) == sequential(content)


def test_random_bytes_are_framed_alike(spark, tmp_path):
    """Lengths that mean nothing: guesses are wrong or missing throughout."""
    r = random.Random(9)
    content = HEADER + bytes(b if i % 44 < 28 else b % 2 for i, b in enumerate(r.randbytes(9_000)))
    path = write(tmp_path, one=content)
    assert as_rows(read_captures(spark, path, chunk_bytes=1_500)) == sequential(content)


def test_first_packets_of_each_file(spark, tmp_path):
    content = HEADER + b"".join(some_packets(200))
    path = write(tmp_path, one=content)
    for n in (0, 1, 77, 200, 10**6):
        got = read_captures(spark, path, chunk_bytes=1_000, first=n)
        assert as_rows(got) == sequential(content)[:n]
    plan = read_captures(spark, path, chunk_bytes=1_000, first=77)._jdf.queryExecution().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan


def streamed(spark, folder, root, **options):
    """Batches of a stream that works through what is there: {batch: rows}."""
    def keep(frame, batch_id):
        frame.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    writer = capture.capture_stream(spark, folder, **options).writeStream.foreachBatch(keep)
    run = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="0 seconds").start()
    run.processAllAvailable()
    run.stop()
    found = {}
    for r in spark.read.parquet(f"{root}/out").orderBy("batch_id", "path", "record_no").collect():
        found.setdefault(r.batch_id, []).append((r.path.rsplit("/", 1)[1], r.record_no, r.byte_offset, bytes(r.value)))
    return found


def test_stream_of_captures(spark, tmp_path):
    """A limit cuts batches across files, new files follow, and a restart neither loses nor repeats a packet."""
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {n: HEADER + b"".join(some_packets(k, seed=k)) for n, k in (("a", 10), ("b", 7), ("c", 5))}
    rows = [(f"{n}.pcap", *r) for n in "abc" for r in sequential(contents[n])]
    write(folder, a=contents["a"], b=contents["b"], empty=b"")
    first = streamed(spark, str(folder), tmp_path / "s", max_packets=6)
    assert [len(b) for b in first.values()] == [6, 6, 5]
    write(folder, c=contents["c"])
    (folder / "empty.pcap").rename(folder / "z.pcap")
    second = streamed(spark, str(folder), tmp_path / "s", max_packets=4)
    assert [len(b) for b in second.values()] == [6, 6, 5, 4, 1]
    assert [r for b in second.values() for r in b] == rows


def test_stream_starts_where_it_is_told(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    content = HEADER + b"".join(some_packets(9))
    write(folder, a=content, b=content)
    place = sequential(content)[6]
    start = {"file": f"file:{folder}/a.pcap", "byte": place[1], "record": 6}
    found = streamed(spark, str(folder), tmp_path / "s", start=start)
    assert [r for b in found.values() for r in b] == [("a.pcap", *r) for r in sequential(content)[6:]] + [
        ("b.pcap", *r) for r in sequential(content)
    ]


def test_hops_mark_where_tasks_begin(tmp_path, monkeypatch):
    monkeypatch.setattr(capture, "SPLIT", 1000)
    monkeypatch.setattr(capture, "BLOCK", 400)
    content = HEADER + b"".join(some_packets(40, largest=300))
    (tmp_path / "x.pcap").write_bytes(content)
    places = {at: n for n, at, _ in sequential(content)}
    marks = list(capture.hop(str(tmp_path / "x.pcap"), 24, 30, True))
    assert len(marks) > 3 and all(places[at] == n for n, at in marks) and marks[-1][0] == 30
    assert list(capture.hop(str(tmp_path / "x.pcap"), 24, 99, True))[-1] == (40, len(content))


def test_packets_are_not_sent_to_the_driver_by_a_join(spark, tmp_path):
    """The ranges are small, what is read from them is not: neither side of a join is broadcast by Spark's own choice."""
    content = HEADER + b"".join(some_packets(300))
    path = write(tmp_path, one=content)
    place = ["path", "record_no", "byte_offset"]
    whole = capture.read_whole_files(spark, path).select(*place)
    packets = read_captures(spark, path, chunk_bytes=1_000)
    for joined in (packets.join(whole, place), packets.select("*").where("record_no >= 0").join(packets.select(*place), place)):
        assert as_rows(joined) == sequential(content)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([(7,)], "record_no long")
    assert "BroadcastHashJoin" in packets.join(few.hint("broadcast"), "record_no")._jdf.queryExecution().executedPlan().toString()


def test_fine_chunks_do_not_make_tasks(spark, tmp_path):
    """The driver keeps track of tasks by the bytes, not by the chunks."""
    content = HEADER + b"".join(some_packets(400))
    path = write(tmp_path, one=content)
    index = capture_index(spark, path, chunk_bytes=200)
    assert index.count() > 100
    packets = read_captures(spark, path, chunk_bytes=200)
    assert packets.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert as_rows(packets) == sequential(content)
