"""Write ledger: one row per micro-batch and sink, one folder per micro-batch.

It holds what must survive a restart: rows written, time spent, and the next free
row number. A replayed batch replaces its own folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The entry that holds a micro-batch's number of received packets.
RECEIVED = "received"
SCHEMA = "sink string, rows bigint, started timestamp, finished timestamp, next_row bigint"


@dataclass(frozen=True)
class Entry:
    sink: str
    rows: int
    started: datetime
    finished: datetime
    next_row: int | None = None


def now() -> datetime:
    return datetime.now(timezone.utc)


def record(spark: SparkSession, path: str, batch_id: int, entries: list[Entry]) -> None:
    rows = [(e.sink, e.rows, e.started, e.finished, e.next_row) for e in entries]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/batch_id={batch_id}"
    )


def next_row(spark: SparkSession, path: str, batch_id: int) -> int:
    """First free row number for a batch: where the batch before it stopped. Reads
    that batch's folder alone; batch numbers have no gaps."""
    if batch_id == 0:
        return 0
    before = spark.read.schema(SCHEMA).parquet(f"{path}/batch_id={batch_id - 1}")
    return before.agg(F.max("next_row")).first()[0] or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """All entries, `batch_id` included; empty when nothing was written yet."""
    schema = f"{SCHEMA}, batch_id bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def totals(ledger: DataFrame) -> DataFrame:
    """Rows, batches and seconds per sink."""
    seconds = F.unix_micros("finished") - F.unix_micros("started")
    return ledger.groupBy("sink").agg(
        F.sum("rows").alias("rows"),
        F.count_distinct("batch_id").alias("batches"),
        (F.sum(seconds) / 1_000_000).alias("seconds"),
    )
