"""The telemetry stream: decode each micro-batch once and write every sink from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linktm import scratch
from linktm.operators.cells import melt, numbered_cell_rows, profile_catalog, sequential_keys
from linktm.operators.decode import decode_packets, non_empty, quarantine, raw_bytes, readable
from linktm.operators.points import points
from linktm.schema import ARRIVAL_ORDER, MEASUREMENTS, PROJECTED_V1, PROJECTED_V2
from linktm.sinks.stores import write_catalog, write_cells, write_points
from linktm.streaming import ledger
from linktm.streaming.compaction import read_ledger

INTERVAL = "10 seconds"


@dataclass(frozen=True)
class TelemetryJob:
    """Settings of a telemetry stream and the folders it writes below `root`."""

    root: str
    variant: str = "v1"
    profile: str = "v1"
    compat: bool = False
    clock: Column | None = None
    decoder: Callable[[Column], Column] = raw_bytes
    order: tuple[str, ...] = ARRIVAL_ORDER
    extra_sinks: dict[str, Callable[[DataFrame, int], None]] = field(default_factory=dict)

    @property
    def points_path(self) -> str:
        return f"{self.root}/points"

    @property
    def cells_path(self) -> str:
        return f"{self.root}/cells"

    @property
    def catalog_path(self) -> str:
        return f"{self.root}/catalog"

    @property
    def quarantine_path(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def ledger_path(self) -> str:
        return f"{self.root}/ledger"

    def decode(self, packets: DataFrame) -> DataFrame:
        """The packets' place, the columns the sinks use and the decode status."""
        decoded = decode_packets(
            non_empty(packets),
            variant=self.variant,
            compat=self.compat,
            clock=self.clock,
            decoder=self.decoder,
        )
        columns = PROJECTED_V1 if self.variant == "v1" else PROJECTED_V2
        return decoded.select(*self.order, *columns, "decode_status")

    def write_batch(self, packets: DataFrame, batch_id: int) -> None:
        """Write one micro-batch. Every sink replaces what an earlier try of the same
        batch wrote, and the ledger is written last."""
        with scratch.scope(packets.sparkSession):
            self._write_batch(packets, batch_id)

    def _write_batch(self, packets: DataFrame, batch_id: int) -> None:
        spark = packets.sparkSession
        started = ledger.now()
        # Received packets are counted on their way into the decoder, empty ones included: the source is read once.
        received = Observation()
        decoded = self.decode(packets.observe(received, F.count(F.lit(1)).alias("rows"))).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        entries: list[ledger.Entry] = []

        def timed(sink: str, frame: DataFrame, write, next_row: int | None = None) -> int:
            # Rows are counted while they are written, not by another pass.
            seen = Observation()
            started = ledger.now()
            write(frame, lambda f: f.observe(seen, F.count(F.lit(1)).alias("rows")))
            rows = seen.get["rows"]
            entries.append(ledger.Entry(sink, rows, started, ledger.now(), next_row))
            return rows

        try:
            good = readable(decoded)
            timed(
                "points",
                points(good, variant=self.variant),
                lambda f, seen: write_points(seen(f), self.points_path, batch_id=batch_id),
            )
            start = ledger.next_row(spark, self.ledger_path, batch_id)
            # The persisted packets are put in order; nothing but the order's result is written.
            rows = numbered_cell_rows(
                good, list(self.order), self.profile, compat=self.compat, stored=True
            )
            keyed = sequential_keys(rows, start=start)
            cells_of = partial(melt, python_booleans=self.compat)
            timed(
                "cells",
                keyed,
                lambda f, seen: write_cells(
                    f, self.cells_path, batch_id=batch_id, observed=seen, melted=cells_of
                ),
                start + good.count() * len(MEASUREMENTS),
            )
            if batch_id == 0:
                write_catalog(
                    profile_catalog(rows, self.profile, compat=self.compat), self.catalog_path
                )
            timed(
                "quarantine",
                quarantine(decoded),
                lambda f, seen: seen(f).write.mode("overwrite").parquet(
                    f"{self.quarantine_path}/batch_id={batch_id}"
                ),
            )
            entries.append(ledger.Entry(ledger.RECEIVED, received.get["rows"], started, ledger.now()))
            for name, sink in self.extra_sinks.items():
                timed(name, good, lambda f, seen, sink=sink: sink(seen(f), batch_id))
            ledger.record(spark, self.ledger_path, batch_id, entries)
        finally:
            decoded.unpersist()

    def start(
        self, packets: DataFrame, *, interval: str | None = INTERVAL, name: str | None = None
    ) -> StreamingQuery:
        """Run the stream; `interval=None` works through what is there and stops."""
        writer = packets.writeStream.foreachBatch(self.write_batch).option(
            "checkpointLocation", f"{self.root}/checkpoint"
        )
        if name:
            writer = writer.queryName(name)
        trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
        return writer.trigger(**trigger).start()


def archive_stream(
    packets: DataFrame, path: str, checkpoint: str, *, interval: str | None = INTERVAL
) -> StreamingQuery:
    """Append raw (key, value) messages as Parquet segments, exactly once."""
    writer = (
        packets.select("key", "value")
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def packet_counts(spark: SparkSession, job: TelemetryJob) -> DataFrame:
    """`batch_id`, `packets` received in every micro-batch of a job since it first ran, empty packets included."""
    entries = read_ledger(spark, job).where(F.col("sink") == ledger.RECEIVED)
    return entries.select("batch_id", F.col("rows").alias("packets"))
