"""Gaps between arrivals of every series (port) on a running stream.

What a micro-batch needs from those before it is kept in folders of its own number: the last arrival of every
series (one row each), the watermark, and the packets that are held back. A packet is held until the largest time
seen is `delay` past it, so packets may come out of order by that much; the released ones are put in order
and differenced with the last arrivals in front. A packet older than what was already released is late: it is stored apart
and takes no part. The record of a batch is written last, and readers see recorded batches only; a
replayed batch starts from the folders of the batch before it and replaces its own, so restarts neither lose nor
repeat a gap. Folders that no replay can ask for are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linktm import scratch
from linktm.operators.decode import decode_packets, non_empty, readable
from linktm.operators.series import consecutive_difference

RECORD = "watermark bigint, gaps bigint, late bigint, held bigint, series bigint"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of the job, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class IntervalJob:
    """Settings of the stream and the folders below `root`.

    time   column of arrival times, a whole number.
    by     columns that separate series.
    tie    columns that order packets of equal time.
    delay  how much older than the newest packet one may be without being late, in units of `time`.
    """

    root: str
    time: str = "spw_ts_nsec"
    by: tuple[str, ...] = ("spw_port_name",)
    tie: tuple[str, ...] = ("offset",)
    delay: int = 0
    name: str = "delta_ns"

    def folder(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def arrivals(self, packets: DataFrame) -> DataFrame:
        """Series, time and order of every readable packet that has a time."""
        decoded = readable(decode_packets(non_empty(packets)))
        return decoded.where(F.col(self.time).isNotNull()).select(*self.by, self.time, *self.tie)

    def write_batch(self, packets: DataFrame, batch_id: int) -> None:
        self._advance(packets.sparkSession, self.arrivals(packets), batch_id, self.delay)

    def flush(self, spark: SparkSession) -> None:
        """Release what is held back, as after the last packet of a recording. It counts as a batch of its own: the
        stream must not go on behind it."""
        last = last_batch(spark, self)
        if last is not None:
            schema = _stored_schema(spark, self, last)
            self._advance(spark, spark.createDataFrame([], schema), last + 1, None)

    def _advance(self, spark: SparkSession, arrivals: DataFrame, batch_id: int, delay: int | None) -> None:
        with scratch.scope(spark):
            new = scratch.materialize(arrivals, "arrivals")
            if batch_id:
                before = spark.read.schema(RECORD).parquet(self.folder("records", batch_id - 1)).first().watermark
                held = spark.read.schema(new.schema).parquet(self.folder("held", batch_id - 1))
                last = spark.read.schema(new.select(*self.by, self.time).schema).parquet(self.folder("last", batch_id - 1))
            else:
                before, held, last = None, new.limit(0), new.select(*self.by, self.time).limit(0)
            time = F.col(self.time)
            # An empty batch leaves the watermark; a flush moves it past everything.
            reach = new.unionByName(held).agg(F.max(time)).first()[0]
            seen = None if reach is None else reach + 1 if delay is None else reach - delay
            watermark = max((w for w in (before, seen) if w is not None), default=None)
            late = new.where(time < before) if before is not None else new.limit(0)
            timely = (new.where(time >= before) if before is not None else new).unionByName(held)
            ready = timely.where(time < watermark) if watermark is not None else timely.limit(0)
            rest = timely.where(time >= watermark) if watermark is not None else timely
            # Every released packet of a series is younger than its last arrival, which therefore comes first.
            run = ready.unionByName(last, allowMissingColumns=True)
            # All of it is read from the stored arrivals and the folders of the batch before.
            gaps = consecutive_difference(
                run, self.time, by=list(self.by), tie=list(self.tie), name=self.name, stored=True
            )
            newest = run.groupBy(*self.by).agg(F.max(time).alias(self.time))
            counts = {}
            for table, frame in (("gaps", gaps), ("late", late), ("held", rest), ("last", newest)):
                path = self.folder(table, batch_id)
                frame.write.mode("overwrite").parquet(path)
                counts[table] = spark.read.schema(frame.schema).parquet(path).count()
            row = (watermark, counts["gaps"], counts["late"], counts["held"], counts["last"])
            record = spark.createDataFrame([row], RECORD).coalesce(1)
            record.write.mode("overwrite").parquet(self.folder("records", batch_id))
        # The batch before is what a replay of this one starts from; older states have served.
        if batch_id > 1:
            for table in ("held", "last"):
                scratch.remove(spark, self.folder(table, batch_id - 2))

    def start(self, packets: DataFrame, *, interval: str | None = "10 seconds") -> StreamingQuery:
        """Run the stream; `interval=None` works through what is there and stops."""
        writer = packets.writeStream.foreachBatch(self.write_batch)
        writer = writer.option("checkpointLocation", f"{self.root}/checkpoint")
        trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
        return writer.trigger(**trigger).start()


def records(spark: SparkSession, job: IntervalJob) -> DataFrame:
    """`batch_id` and its watermark, gaps, late and held packets, and series in the state."""
    return _stored(spark, f"{job.root}/records", f"{RECORD}, batch_id bigint")


def last_batch(spark: SparkSession, job: IntervalJob) -> int | None:
    return records(spark, job).agg(F.max("batch_id")).first()[0]


def _stored_schema(spark: SparkSession, job: IntervalJob, batch_id: int):
    return spark.read.parquet(job.folder("held", batch_id)).schema


def _recorded(spark: SparkSession, job: IntervalJob, table: str) -> DataFrame:
    stored = spark.read.parquet(f"{job.root}/{table}")
    stored = stored.withColumn("batch_id", F.col("batch_id").cast("bigint"))
    # One row a batch: a batch without a record is not there yet.
    return stored.join(records(spark, job).select("batch_id"), "batch_id", "left_semi")


def read_gaps(spark: SparkSession, job: IntervalJob) -> DataFrame:
    """Every gap of recorded batches: series, time and order of the later packet, the gap, `batch_id`."""
    return _recorded(spark, job, "gaps")


def read_late(spark: SparkSession, job: IntervalJob) -> DataFrame:
    """Packets that came too late, `batch_id` included."""
    return _recorded(spark, job, "late")
