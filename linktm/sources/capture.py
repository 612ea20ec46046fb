"""Capture files as a Spark data source.

    register_capture(spark)
    spark.read.format("capture").load(folder)

A capture file is a 24-byte global header and then packets back to back; a packet's
own length field says where the next one starts. Each file is one partition, read
in blocks, so no file has to fit in memory. `capture_index.read_captures` reads
large files with many tasks.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from linktm.scratch import full_uri

# Fixed values of the file layout.
GLOBAL_HEADER = 24
PACKET_HEADER = 40
LENGTH_AT = 28
LENGTH_MASK = 0x0FFFFFFF

BLOCK = 8 << 20
# Bytes read behind a short range, so that its last packet is whole as a rule.
PAST = 64 << 10
# Bytes of a stream's batch that one task reads.
SPLIT = 32 << 20
SCHEMA = "path string, record_no bigint, byte_offset bigint, value binary"
BATCH_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("record_no", pa.int64()),
        ("byte_offset", pa.int64()),
        ("value", pa.binary()),
    ]
)

# Executors get this module with the job; they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or of a local path. Object stores go by several names."""
    for name in ("s3a", "s3n"):
        if path.startswith(f"{name}://"):
            path = "s3" + path.removeprefix(name)
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def capture_files(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file or of the files below a folder, hidden ones left out."""
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    else:
        raise FileNotFoundError(path)
    # What stands before the inner path in the URI stands before every file.
    front = path[: -len(inner)] if path.endswith(inner) else ""
    files = [
        (f"{front}{f.path}", f.size)
        for f in found
        if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
    ]
    return sorted(files)


def frame_range(
    path: str,
    start: int,
    stop: int | None,
    first: int,
    *,
    masked: bool = True,
    before: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """Records whose first byte lies in [start, stop), numbered from `first`;
    `before` ends the scan ahead of that record number. The records of a block are
    contiguous, so the block itself is the value buffer."""
    mask = LENGTH_MASK if masked else 0xFFFFFFFF
    length_of = struct.Struct("<I").unpack_from
    store, inner = open_store(path)
    with store.open_input_file(inner) as source:
        size = source.size()
        stop = size if stop is None else min(stop, size)
        position, number = start, first
        want = near = min(BLOCK, max(0, stop - start) + PAST)
        while position < stop and (before is None or number < before):
            block = source.read_at(min(want, size - position), position)
            held = len(block)
            at_end = position + held >= size
            starts, at = [], 0
            while at < held and position + at < stop:
                if before is not None and number + len(starts) >= before:
                    break
                if held - at < PACKET_HEADER:
                    if not at_end:
                        break
                    following = held
                else:
                    following = at + PACKET_HEADER + (length_of(block, at + LENGTH_AT)[0] & mask)
                    if following > held:
                        if not at_end:
                            break
                        following = held
                starts.append(at)
                at = following
            if not starts:
                # One packet is larger than the block: read on with a larger one.
                want *= 2
                continue
            want = near
            n = len(starts)
            offsets = pa.array([*starts, at], pa.int32()).buffers()[1]
            values = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(block)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n, pa.string()),
                    pa.array(range(number, number + n), pa.int64()),
                    pa.array([position + s for s in starts], pa.int64()),
                    values,
                ],
                schema=BATCH_SCHEMA,
            )
            position, number = position + at, number + n


class CaptureFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CaptureRange(InputPartition):
    """Packets of one file that start in [start, stop), numbered from `first`."""

    def __init__(self, path: str, start: int, stop: int, first: int):
        self.path, self.start, self.stop, self.first = path, start, stop, first


def hop(path: str, start: int, limit: int, masked: bool) -> Iterator[tuple[int, int]]:
    """(packets, position behind them) at every SPLIT bytes of the first `limit` packets from `start` on, and behind
    the last of them. Headers are looked at in blocks; no packet is kept."""
    mask = LENGTH_MASK if masked else 0xFFFFFFFF
    length_of = struct.Struct("<I").unpack_from
    store, inner = open_store(path)
    with store.open_input_file(inner) as source:
        size, at, seen, told, block, base = source.size(), start, 0, start, b"", start
        while at < size and seen < limit:
            if at + PACKET_HEADER > base + len(block):
                base, block = at, source.read_at(min(BLOCK, size - at), at)
            if at + PACKET_HEADER > size:
                at = size
            else:
                at = min(size, at + PACKET_HEADER + (length_of(block, at - base + LENGTH_AT)[0] & mask))
            seen += 1
            if at - told >= SPLIT and seen < limit and at < size:
                yield seen, at
                told = at
        yield seen, at


class CaptureStreamReader(DataSourceStreamReader):
    """Offsets are {file, byte, record}: the next packet to read. Files are read in the order of their paths, and each
    must be whole when it appears; one that sorts before the offset is not read any more."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.masked = options.get("maskedlength", "true").lower() == "true"
        self.limit = int(options["maxpacketspertrigger"]) if "maxpacketspertrigger" in options else None
        self.first = {
            "file": options.get("startfile", ""),
            "byte": int(options.get("startbyte", GLOBAL_HEADER)),
            "record": int(options.get("startrecord", 0)),
        }
        self.position: dict | None = None
        self.marks: list[dict] = []

    def _files(self, start: dict, last: str | None = None) -> list[tuple[str, int, int, int]]:
        """(file, first byte, size, first record) of what lies behind `start`."""
        found = []
        for path, size in capture_files(self.path):
            if path >= start["file"] and (last is None or path <= last):
                here = path == start["file"] or not start["file"] and not found
                found.append((path, start["byte"] if here else GLOBAL_HEADER, size, start["record"] if here else 0))
        return found

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        start = self.position or self.first
        left, end, self.marks = self.limit, start, []
        for path, byte, size, record in self._files(start):
            if left is None:
                end = {"file": path, "byte": max(size, byte), "record": 0}
            elif byte < size and left > 0:
                for packets, at in hop(path, byte, left, self.masked):
                    end = {"file": path, "byte": at, "record": record + packets}
                    self.marks.append(end)
                left -= packets
        self.position = end
        return end

    def partitions(self, start: dict, end: dict) -> list[CaptureRange]:
        # After a restart this is the first call, with the last offset of the run before.
        self.position = end
        ranges = []
        for path, byte, size, record in self._files(start, end["file"]) if start != end else []:
            stop = end["byte"] if path == end["file"] else size
            for mark in self.marks:
                if mark["file"] == path and byte < mark["byte"] < stop:
                    ranges.append(CaptureRange(path, byte, mark["byte"], record))
                    byte, record = mark["byte"], mark["record"]
            if byte < stop:
                ranges.append(CaptureRange(path, byte, stop, record))
        return ranges

    def read(self, partition: CaptureRange):
        return frame_range(
            partition.path, partition.start, partition.stop, partition.first, masked=self.masked
        )


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.masked = options.get("maskedlength", "true").lower() == "true"
        self.first = int(options["firstrecords"]) if "firstrecords" in options else None

    def partitions(self):
        return [CaptureFile(path) for path, _ in capture_files(self.path)]

    def read(self, partition: CaptureFile):
        return frame_range(
            partition.path, GLOBAL_HEADER, None, 0, masked=self.masked, before=self.first
        )


class CaptureDataSource(DataSource):
    """Options: `path` (file or folder), `maskedLength` (default true: only the low
    28 bits of the length field count), `firstRecords` (read no more per file). As a stream also
    `maxPacketsPerTrigger`, and `startFile`, `startByte`, `startRecord`: where a new stream begins."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader({k.lower(): v for k, v in self.options.items()})


def register_capture(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureDataSource)


def read_whole_files(
    spark: SparkSession, path: str, *, compat: bool = False, first: int | None = None
) -> DataFrame:
    """Packets of a capture file or folder, one task per file: (path, record_no,
    byte_offset, value). `first` stops each file after that many packets."""
    register_capture(spark)
    reader = spark.read.format("capture").option("maskedLength", "false" if compat else "true")
    if first is not None:
        reader = reader.option("firstRecords", str(first))
    return reader.load(full_uri(spark, path))


def capture_stream(
    spark: SparkSession,
    path: str,
    *,
    max_packets: int | None = None,
    start: dict[str, object] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Stream of the packets of a capture folder, (path, record_no, byte_offset, value), files in the order of their paths.
    `max_packets` bounds a micro-batch; the driver then looks at the headers of one batch to find its end.
    `start` is an offset (file, byte, record) for a stream without a checkpoint."""
    register_capture(spark)
    reader = spark.readStream.format("capture").option("maskedLength", "false" if compat else "true")
    if max_packets is not None:
        reader = reader.option("maxPacketsPerTrigger", str(max_packets))
    for name, value in (start or {}).items():
        reader = reader.option(f"start{name.capitalize()}", str(value))
    return reader.load(full_uri(spark, path))


def measure_range(path: str, entry: int, stop: int, masked: bool) -> tuple[int, int]:
    """(records, position after the last one) of the records that start in [entry, stop)."""
    records, following = 0, entry
    for batch in frame_range(path, entry, stop, 0, masked=masked):
        records += batch.num_rows
        last = batch.num_rows - 1
        following = batch["byte_offset"][last].as_py() + len(batch["value"][last].as_py())
    return records, following


# A guessed record start must lead to this many plausible records in a row.
CHAIN = 6
SEARCH = 1 << 20
DAY = 86_400


def guess_record(path: str, start: int, stop: int) -> int | None:
    """A position in [start, stop) that looks like a record start. Only a guess: the
    caller proves it by framing what comes before."""
    head = struct.Struct("<II20xI").unpack_from
    store, inner = open_store(path)
    with store.open_input_file(inner) as source:
        size = source.size()
        block = source.read_at(min(SEARCH + PACKET_HEADER, size - start), start)

        def header(position: int) -> tuple[int, int, int] | None:
            at = position - start
            if at + PACKET_HEADER <= len(block):
                return head(block, at)
            raw = source.read_at(PACKET_HEADER, position)
            return head(raw) if len(raw) == PACKET_HEADER else None

        def leads_on(position: int) -> bool:
            seconds = None
            for _ in range(CHAIN):
                if position == size:
                    return seconds is not None
                fields = header(position)
                if fields is None or fields[1] >= 1_000_000_000:
                    return False
                if seconds is not None and abs(fields[0] - seconds) > DAY:
                    return False
                seconds = fields[0]
                position += PACKET_HEADER + (fields[2] & LENGTH_MASK)
                if position > size:
                    return False
            return True

        for position in range(start, min(stop, start + SEARCH, size)):
            if leads_on(position):
                return position
    return None


# Bytes before and behind a chunk's start in which chains of lengths are followed.
WINDOW = 64 << 10


def likely_record(path: str, start: int, stop: int, masked: bool) -> int | None:
    """The position in [start, stop) through which the most chains of lengths pass that begin near `start`: chains from
    wrong places leave the neighbourhood at once or fall into the right one. Only a guess as well."""
    store, inner = open_store(path)
    low = max(GLOBAL_HEADER, start - WINDOW)
    high = min(stop, start + WINDOW)
    with store.open_input_file(inner) as source:
        block = np.frombuffer(source.read_at(high - low + PACKET_HEADER, low), np.uint8)
    places = min(high - low, len(block) - PACKET_HEADER)
    if places <= start - low:
        return None
    field = [block[LENGTH_AT + k : LENGTH_AT + k + places].astype(np.int64) << (8 * k) for k in range(4)]
    length = sum(field) & (LENGTH_MASK if masked else 0xFFFFFFFF)
    following = np.minimum(np.arange(places) + PACKET_HEADER + length, places).tolist()
    passing = [1] * (places + 1)
    for place, after in enumerate(following):
        passing[after] += passing[place]
    inside = passing[start - low : places]
    most = max(inside)
    return start + inside.index(most) if most > 1 else None


RANGE_SCHEMA = "path string, chunk bigint, stop bigint, entry bigint, records bigint, following bigint"
_RANGE_NAMES = ["path", "chunk", "stop", "entry", "records", "following"]


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    types = [pa.string()] + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_RANGE_NAMES)


def probe_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, chunk, start, stop, entry, masked) -> RANGE_SCHEMA; a null entry is guessed, and stays null where nothing
    looks like a packet."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            path, stop, entry, masked = (row[c] for c in ("path", "stop", "entry", "masked"))
            if entry is None:
                entry = guess_record(path, row["start"], stop)
            if entry is None:
                entry = likely_record(path, row["start"], stop, masked)
            found = (None, None) if entry is None else measure_range(path, entry, stop, masked)
            rows.append((path, row["chunk"], stop, entry, *found))
        yield _range_batch(rows)


def bridge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, entry, chunks, masked) -> RANGE_SCHEMA: the first of `chunks` (chunk, stop, guess, records, following) framed
    from `entry` on, then the next ones, until a chunk's guess is met. From there what the guess gave (`records`,
    `following`) holds. No task leaves the chunks it was given."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            path, at, masked = row["path"], row["entry"], row["masked"]
            for chunk in row["chunks"]:
                entry, guess, stop = at, chunk["guess"], chunk["stop"]
                records = 0
                if guess is not None and at <= guess:
                    records, at = measure_range(path, at, guess, masked)
                met = at == guess
                if met:
                    records, at = records + chunk["records"], chunk["following"]
                else:
                    more, at = measure_range(path, at, stop, masked)
                    records += more
                rows.append((path, chunk["chunk"], stop, entry, records, at))
                if met:
                    break
        yield _range_batch(rows)


def follow_file(table: pa.Table) -> pa.Table:
    """Framed chunks of one file, from right and wrong entries -> the chain of those that follow each other from the
    global header on. Where the chain needs an entry that nothing was framed from, it ends with that row, `records`
    null. A chunk that a packet covers whole has no records and none of its bytes are read."""
    rows = table.to_pylist()
    framed = {(r["chunk"], r["entry"]): r for r in rows if r["records"] is not None}
    stops = {r["chunk"]: r["stop"] for r in rows}
    path, position, chain = rows[0]["path"], GLOBAL_HEADER, []
    for chunk, stop in sorted(stops.items()):
        if position >= stop:
            found = (0, position)
        elif (chunk, position) in framed:
            row = framed[chunk, position]
            found = (row["records"], row["following"])
        else:
            chain.append((path, chunk, stop, position, None, None))
            break
        chain.append((path, chunk, stop, position, *found))
        position = found[1]
    return pa.Table.from_batches([_range_batch(chain)])


def frame_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, entry, stop, first, masked, before) -> records."""
    for batch in batches:
        for row in batch.to_pylist():
            yield from frame_range(
                row["path"],
                row["entry"],
                row["stop"],
                row["first"],
                masked=row["masked"],
                before=row["before"],
            )
