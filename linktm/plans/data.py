"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm.fixtures import (
    malformed_packets_from_events,
    packets_with_gaps,
    packets_from_events,
    read_events,
)
from linktm.scratch import new_path
from linktm.sources.messages import packet_batch, packet_stream
from linktm.streaming.compaction import STORES, merge_store, retire
from linktm.streaming.intervals import IntervalJob
from linktm.streaming.job import TelemetryJob

# Fixed value: the reception time used where a query must give the same rows twice.
CLOCK_US = 1522920989746678


def fixed_clock() -> Column:
    return F.timestamp_micros(F.lit(CLOCK_US))


_BUILDERS = {"packets": packets_from_events, "malformed": malformed_packets_from_events, "gaps": packets_with_gaps}
_written: dict[tuple[str, str, str], str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(spark, sf_dir)


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt out evenly, by as many tasks as the session's shuffles have."""
    return frame.repartition("event_id")


def message_path(spark: SparkSession, sf_dir: str, kind: str = "packets") -> str:
    """Folder of the messages built from all events, written once per application."""
    source = (spark.sparkContext.applicationId, sf_dir, kind)
    if source not in _written:
        path = new_path(spark, kind)
        _BUILDERS[kind](spread(events(spark, sf_dir))).write.parquet(path)
        _written[source] = path
    return _written[source]


def messages(spark: SparkSession, sf_dir: str, kind: str = "packets") -> DataFrame:
    return packet_batch(spark, "parquet", path=message_path(spark, sf_dir, kind))


# Micro-batches of the stream that works through its messages part by part.
PARTS = 4
_jobs: dict[tuple[str, str], tuple[TelemetryJob, str]] = {}


def job_in_parts(spark: SparkSession, sf_dir: str) -> tuple[TelemetryJob, str]:
    """A finished stream job of PARTS micro-batches, and the folder of its messages. Batch k has the packets
    whose offset leaves k; the stream is stopped and started again before each."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _jobs:
        folder, root = new_path(spark, "parts"), new_path(spark, "stream")
        job = TelemetryJob(root, clock=fixed_clock(), extra_sinks={"copy": copy_sink(f"{root}/copy")})
        for part in range(PARTS):
            mine = messages(spark, sf_dir).where(F.col("offset") % PARTS == part)
            mine.write.mode("append").parquet(folder)
            stream = packet_stream(spark, "parquet", path=folder)
            job.start(stream, interval=None).awaitTermination()
        _jobs[key] = job, folder
    return _jobs[key]


_merged: dict[tuple[str, str, str, tuple[int, ...]], TelemetryJob] = {}


def merged_job(spark: SparkSession, sf_dir: str, kind: str = "packets", *, merges: tuple[int, ...]) -> TelemetryJob:
    """A job of PARTS micro-batches, batch k as in `job_in_parts`. After each batch of `merges` all stores are merged by
    twos, and what is covered is removed."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, merges)
    if key not in _merged:
        job = TelemetryJob(new_path(spark, "merged"), clock=fixed_clock())
        for part in range(PARTS):
            job.write_batch(messages(spark, sf_dir, kind).where(F.col("offset") % PARTS == part), part)
            for store in STORES if part in merges else ():
                merge_store(spark, job, store, fanout=2)
                retire(spark, job, store, grace=0)
        _merged[key] = job
    return _merged[key]


_intervals: dict[tuple[str, str], IntervalJob] = {}


def intervals_in_parts(spark: SparkSession, sf_dir: str) -> IntervalJob:
    """A finished stream of gaps over PARTS micro-batches, stopped and started again before each. Packets come in the
    order of a time that is up to two eighths of a part behind their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _intervals:
        folder, root = new_path(spark, "timed-parts"), new_path(spark, "intervals")
        us = F.unix_micros("timestamp")
        found = messages(spark, sf_dir).agg(F.min(us).alias("first"), F.max(us).alias("last")).first()
        step = (found.last - found.first) // (8 * PARTS) + 1
        came = us + F.col("offset") % 3 * step
        width = (found.last - found.first + 2 * step) // PARTS + 1
        job = IntervalJob(root, delay=2 * step * 1000 + 1000)
        for part in range(PARTS):
            mine = messages(spark, sf_dir).where(F.floor((came - found.first) / width) == part)
            mine.write.mode("append").parquet(folder)
            job.start(packet_stream(spark, "parquet", path=folder), interval=None).awaitTermination()
        job.flush(spark)
        _intervals[key] = job
    return _intervals[key]


def copy_sink(path: str) -> Callable[[DataFrame, int], None]:
    def copy(packets: DataFrame, batch_id: int) -> None:
        kept = packets.select("offset", "type")
        kept.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return copy
