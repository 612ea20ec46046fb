"""Keyed message topics, as streams or batches.

The same functions serve a broker (`fmt="kafka"`, with the connector package on the
session) and message files (`fmt="parquet"`), so a job is tested on files unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linktm.schema import MESSAGE_SCHEMA

TOPIC = "TM_RAW"
MESSAGE_COLUMNS = [field.name for field in MESSAGE_SCHEMA.fields]


def _reader(reader, fmt: str, options: dict[str, str]):
    if fmt != "kafka":
        reader = reader.schema(MESSAGE_SCHEMA)
    return reader.format(fmt).options(**options)


def packet_stream(
    spark: SparkSession,
    fmt: str = "kafka",
    *,
    path: str | None = None,
    repartition: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of (key, value, topic, partition, offset, timestamp).

    Useful options: `subscribe`, `startingOffsets` (default latest),
    `maxOffsetsPerTrigger` and `minPartitions` for a broker; `maxFilesPerTrigger` for
    files. `repartition` spreads each micro-batch before the decode.
    """
    if fmt == "kafka":
        options.setdefault("subscribe", TOPIC)
    stream = _reader(spark.readStream, fmt, options).load(path)
    stream = stream.select(*MESSAGE_COLUMNS)
    return stream.repartition(repartition) if repartition else stream


def packet_batch(
    spark: SparkSession, fmt: str = "kafka", *, path: str | None = None, **options: str
) -> DataFrame:
    """The same columns, read once."""
    if fmt == "kafka":
        options.setdefault("subscribe", TOPIC)
    return _reader(spark.read, fmt, options).load(path).select(*MESSAGE_COLUMNS)
