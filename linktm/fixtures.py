"""Link packets built from the `events` table.

Each event row becomes one binary packet whose header fields are chosen from the
row's columns, so an expected decode can be written straight from `events`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm.scratch import full_uri


def event_text() -> Column:
    """The event time as text. It carries no zone in the table and means UTC."""
    return F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))


def event_micros() -> Column:
    return F.unix_micros(event_text().cast("timestamp"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _be(number: str, size: int) -> str:
    return f"lpad(hex({number}), {2 * size}, '0')"


def _le32(number: str) -> str:
    swapped = (
        f"((({number}) & 255) << 24) | ((({number}) & 65280) << 8)"
        f" | ((({number}) >> 8) & 65280) | ((({number}) >> 24) & 255)"
    )
    return _be(swapped, 4)


def packets_from_events(events: DataFrame) -> DataFrame:
    """`events` -> message frame (key, value, topic, partition, offset, timestamp)."""
    body = events.select(
        "event_id",
        "user_id",
        "ts",
        event_micros().alias("us"),
        F.hex(F.encode("props", "UTF-8")).alias("body"),
        F.expr("cast(round(value * 100) as bigint)").alias("lsb"),
        F.expr("event_id % 4").alias("k"),
    )
    # Every header field varies with the event, so that a decode with a wrong shift shows.
    address = _be("200 + event_id % 50", 1)
    ccsds = (
        "concat(" + address + ", '020000', "
        + _be("event_id % 8 * 8192 + (CASE WHEN k = 1 THEN 4096 ELSE 0 END)"
              " + (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2048 END) + user_id % 2048", 2)
        + ", " + _be("event_id div 8 % 4 * 16384 + event_id div 4 % 16384", 2)
        + ", " + _be("cast(length(body) / 2 as bigint) + 5", 2)
        + ", " + _be("event_id div 4 % 256", 1)
        + ", " + _be("1 + event_id % 20", 1)
        + ", " + _be("event_id % 5", 1)
        + ", " + _be("user_id % 256", 1)
        + ", body, " + _be("event_id % 65536", 2) + ")"
    )
    payload = body.withColumn(
        "payload",
        F.expr(
            f"CASE WHEN k IN (0, 1) THEN {ccsds} WHEN k = 2 THEN concat({address}, '014C', body) "
            f"ELSE concat({address}, 'F000', body) END"
        ),
    ).withColumn("pl", F.expr("cast(length(payload) / 2 as bigint)"))
    record = (
        f"concat({_le32('us div 1000000')}, "
        f"{_le32('(us % 1000000) * 1000 + event_id % 1000')}, "
        f"{_le32('pl + 24')}, {_le32('pl + 24')}, {_be('event_id % 7', 1)}, '0000', "
        "CASE WHEN user_id % 2 = 1 THEN '20' ELSE '00' END, "
        "rpad(hex(concat('SPW-', user_id % 10)), 16, '0'), "
        f"{_le32('pl')}, {_le32('lsb')}, '000000', {_be('event_id % 3', 1)}, payload)"
    )
    return payload.select(
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.expr(f"unhex({record})").alias("value"),
        F.lit("TM_RAW").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.timestamp_micros("us").alias("timestamp"),
    )


def packets_with_gaps(events: DataFrame) -> DataFrame:
    """Every event's packet, and after every fifth an empty and a missing one."""
    packets = packets_from_events(events)
    fifth = packets.where("offset % 5 = 0")
    empty = fifth.withColumn("value", F.expr("X''"))
    missing = fifth.withColumn("value", F.lit(None).cast("binary"))
    return packets.unionByName(empty).unionByName(missing)


def malformed_packets_from_events(events: DataFrame) -> DataFrame:
    """Every event's packet, some damaged: cut to 3 bytes, cut to the bare header,
    cut in the protocol header, cut by its last byte, or given a bad port name."""
    return packets_from_events(events).withColumn(
        "value",
        F.expr(
            """CASE offset % 7
                 WHEN 1 THEN substring(value, 1, 3)
                 WHEN 2 THEN substring(value, 1, 40)
                 WHEN 3 THEN substring(value, 1, 50)
                 WHEN 4 THEN substring(value, 1, length(value) - 1)
                 WHEN 5 THEN concat(substring(value, 1, 20), X'FFFE', substring(value, 23))
                 ELSE value END"""
        ),
    )


def write_capture_files(packets: DataFrame, folder: str, order: str = "offset") -> None:
    """Packets as capture files: each partition becomes one file, its packets in
    `order` after a global header. `folder` must be reachable by every executor."""
    import pyarrow as pa

    from linktm.sources.capture import open_store

    folder = full_uri(packets.sparkSession, folder)

    def write(batches):
        from pyspark import TaskContext

        # Fixed value: a global header; readers skip its 24 bytes.
        header = bytes.fromhex("d4c3b2a1020004000000000000000000ffff000001000000")
        store, inner = open_store(folder)
        store.create_dir(inner, recursive=True)
        name = f"capture-{TaskContext.get().partitionId():05d}.pcap"
        rows = 0
        with store.open_output_stream(f"{inner}/{name}") as out:
            out.write(header)
            for batch in batches:
                for value in batch.column(0):
                    out.write(value.as_buffer())
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["file", "packets"])

    ordered = packets.sortWithinPartitions(order).select("value")
    written = ordered.mapInArrow(write, "file string, packets bigint")
    written.write.format("noop").mode("overwrite").save()
