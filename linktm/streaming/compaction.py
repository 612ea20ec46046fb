"""The stores of a stream over years: whole batches only, and a number of folders that stays small.

A micro-batch owns a folder in every store, and readers see it once the ledger has it, so a batch that broke off
between two sinks shows in no store. Merging puts the batches of a store into runs by levels: `fanout` batches make a
run of level 1, `fanout` runs of a level one of the next. A row is therefore written once a level, a logarithm of the
number of batches, and a reader opens at most `fanout` runs a level and the batches behind them. A run counts from its
record on, which is written last; a merge that broke off is simply done again. What a run covers stays until
`retire` removes it, so that readers can end first. Points, cells, quarantine and the ledger itself are merged alike.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linktm.scratch import remove
from linktm.streaming import ledger

if TYPE_CHECKING:
    from linktm.streaming.job import TelemetryJob

FANOUT = 8
STORES = ("points", "cells", "quarantine", "ledger")
_MICROS_PER_DAY = 86_400_000_000
_RECORD = "level int, first bigint, last bigint, rows bigint, recorded double"


@dataclass(frozen=True)
class Run:
    """Batches `first` to `last` of a store, merged; `recorded` in seconds since 1970."""

    level: int
    first: int
    last: int
    rows: int
    recorded: float

    @property
    def name(self) -> str:
        return f"level-{self.level}-batches-{self.first}-{self.last}"

    def covers(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


def _path(job: TelemetryJob, store: str) -> str:
    return getattr(job, f"{store}_path")


def _data(job: TelemetryJob, store: str, run: Run) -> str:
    return f"{job.root}/merged/{store}/{run.name}"


def _record(job: TelemetryJob, store: str, run: Run) -> str:
    return f"{job.root}/merged/{store}-records/{run.name}"


def recorded_runs(spark: SparkSession, job: TelemetryJob, store: str) -> list[Run]:
    """All runs of a store that have a record, covered ones included until they are retired."""
    try:
        records = spark.read.schema(_RECORD).parquet(f"{job.root}/merged/{store}-records/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Run(*row) for row in records.collect()]


def newest_runs(runs: list[Run]) -> list[Run]:
    """Those that no other covers: they follow each other from batch 0 on, larger ones first."""
    return sorted((r for r in runs if not any(o.covers(r) for o in runs)), key=lambda r: r.first)


def _behind(runs: list[Run]) -> int:
    """The first batch behind the runs."""
    return max((r.last + 1 for r in runs), default=0)


def _run_rows(spark: SparkSession, job: TelemetryJob, store: str, runs: list[Run]) -> list[DataFrame]:
    return [spark.read.parquet(_data(job, store, r)).drop("day") for r in runs if r.rows]


def read_ledger(spark: SparkSession, job: TelemetryJob) -> DataFrame:
    """All entries of the ledger, merged or not, `batch_id` included."""
    runs = newest_runs(recorded_runs(spark, job, "ledger"))
    recent = ledger.read(spark, job.ledger_path).where(F.col("batch_id") >= _behind(runs))
    return reduce(DataFrame.unionByName, _run_rows(spark, job, "ledger", runs), recent)


def _committed(spark: SparkSession, job: TelemetryJob, first: int) -> DataFrame:
    entries = read_ledger(spark, job).where((F.col("sink") == ledger.RECEIVED) & (F.col("batch_id") >= first))
    return entries.select("batch_id")


def _recent(spark: SparkSession, job: TelemetryJob, store: str, first: int) -> DataFrame | None:
    """Rows of committed batches from `first` on; None where no batch has written a row."""
    if store == "ledger":
        return ledger.read(spark, job.ledger_path).where(F.col("batch_id") >= first)
    try:
        stored = spark.read.parquet(_path(job, store))
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    stored = stored.withColumn("batch_id", F.col("batch_id").cast("bigint")).where(F.col("batch_id") >= first)
    # One ledger row per batch decides, and folders of other batches are not read.
    return stored.join(_committed(spark, job, first), "batch_id", "left_semi")


def read_store(spark: SparkSession, job: TelemetryJob, store: str) -> DataFrame:
    """All rows of committed batches of a store (one of STORES), merged or not, with their `batch_id`."""
    runs = newest_runs(recorded_runs(spark, job, store))
    frames = _run_rows(spark, job, store, runs)
    recent = _recent(spark, job, store, _behind(runs))
    if recent is not None:
        frames.append(recent)
    if not frames:
        raise ValueError(f"{_path(job, store)}: nothing was stored yet")
    return reduce(DataFrame.unionByName, frames)


def read_points(spark: SparkSession, job: TelemetryJob) -> DataFrame:
    """All points of committed batches, merged or not."""
    return read_store(spark, job, "points").drop("batch_id")


def _write(job: TelemetryJob, store: str, rows: DataFrame, path: str) -> int:
    """Write a run in the order its readers ask for, ranged so that no task holds more than its share; its rows."""
    by: list[str] = []
    if store == "points":
        day = F.date_from_unix_date(F.floor(F.unix_micros("time") / _MICROS_PER_DAY).cast("int"))
        rows, by, order = rows.withColumn("day", day), ["measurement", "day"], ["measurement", "day", "time"]
    elif store == "cells":
        by, order = ["family"], ["family", "row_key"]
    else:
        order = ["batch_id", *(c for c in job.order if c in rows.columns)]
    seen = Observation()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = ranged.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").partitionBy(*by).parquet(path)
    return seen.get["rows"]


def _merged(spark: SparkSession, job: TelemetryJob, store: str, level: int, first: int, last: int,
            frames: list[DataFrame]) -> Run:
    run = Run(level, first, last, 0, 0.0)
    rows = _write(job, store, reduce(DataFrame.unionByName, frames), _data(job, store, run)) if frames else 0
    run = Run(level, first, last, rows, time.time())
    record = spark.createDataFrame([(level, first, last, rows, run.recorded)], _RECORD)
    record.coalesce(1).write.mode("overwrite").parquet(_record(job, store, run))
    return run


def merge_store(
    spark: SparkSession, job: TelemetryJob, store: str, fanout: int = FANOUT, last_batch: int | None = None
) -> list[Run]:
    """Write every run that is due, and return them. Only committed batches that follow the ones merged before without
    a gap take part, up to `last_batch` where one is given. Repeating it after a failure replaces what was begun."""
    runs = newest_runs(recorded_runs(spark, job, store))
    made: list[Run] = []
    first = _behind(runs)
    # Batches that came since the last merge.
    waiting = {r.batch_id for r in _committed(spark, job, first).collect()}
    while all(b in waiting and (last_batch is None or b <= last_batch) for b in range(first, first + fanout)):
        last = first + fanout - 1
        recent = _recent(spark, job, store, first)
        frames = [] if recent is None else [recent.where(F.col("batch_id") <= last)]
        made.append(_merged(spark, job, store, 1, first, last, frames))
        runs.append(made[-1])
        while len(same := [r for r in runs if r.level == runs[-1].level]) >= fanout:
            frames = _run_rows(spark, job, store, same)
            made.append(_merged(spark, job, store, same[0].level + 1, same[0].first, same[-1].last, frames))
            runs = [r for r in runs if r not in same] + [made[-1]]
        first = _behind(runs)
    return made


def _batch_folders(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]


def retire(spark: SparkSession, job: TelemetryJob, store: str, grace: float = 3600.0) -> None:
    """Remove the batches and runs that a run covers which has been recorded for `grace` seconds: readers that began
    before it must have ended. The newest batch of the ledger stays, as the next one goes on from it."""
    runs = recorded_runs(spark, job, store)
    old = [r for r in newest_runs(runs) if r.recorded <= time.time() - grace]
    for run in runs:
        if any(o.covers(run) for o in old):
            # The record goes last: a covered run is not read, with or without its data.
            remove(spark, _data(job, store, run))
            remove(spark, _record(job, store, run))
    batches = _batch_folders(spark, _path(job, store))
    for batch in batches:
        kept = store == "ledger" and batch >= max(batches) - 1
        if not kept and any(o.first <= batch <= o.last for o in old):
            remove(spark, f"{_path(job, store)}/batch_id={batch}")
