"""Registered queries: each takes (session, table folder) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm import schema as S
from linktm.fixtures import event_micros, event_text, write_capture_files
from linktm.functions import values as V
from linktm.functions.bytes import hex_text, latin1_text
from linktm.operators import cells as C
from linktm.operators import points as P
from linktm.operators import series as R
from linktm.operators.decode import (
    decode_packets,
    latin1_value,
    non_empty,
    packet_values,
    project,
    quarantine,
    select_present,
)
from linktm.operators.slices import dense_row_id
from linktm.plans.data import (
    PARTS,
    events,
    fixed_clock,
    intervals_in_parts,
    job_in_parts,
    merged_job,
    message_path,
    messages,
)
from linktm.scratch import materialize, new_path
from linktm.sinks import stores as K
from linktm.sources import stores as Q
from linktm.sources.capture import capture_stream, read_whole_files
from linktm.sources.capture_index import read_captures
from linktm.sources.cell_index import get_rows, index_cells
from linktm.sources.logs import (
    document_field,
    document_paths,
    log_documents,
    merged_schema,
    typed_documents,
    typed_field,
)
from linktm.sources.messages import packet_batch, packet_stream
from linktm.streaming import ledger
from linktm.streaming.compaction import read_points, read_store
from linktm.streaming.intervals import read_gaps, records
from linktm.streaming.job import TelemetryJob, archive_stream, packet_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORDER = list(S.ARRIVAL_ORDER)
# Fixed value: packets of the full workload.
WORKLOAD = 863_928


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def decoded(spark: SparkSession, sf_dir: str, kind: str = "packets", **options) -> DataFrame:
    packets = non_empty(messages(spark, sf_dir, kind))
    return decode_packets(packets, clock=fixed_clock(), **options)


def flat_points(frame: DataFrame) -> DataFrame:
    """Points with the time as epoch microseconds."""
    return frame.withColumn("time", F.unix_micros("time")).withColumnRenamed("time", "time_us")


# Decode


@query
def classify_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("packets"))


@query
def decode_link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select(
        "offset",
        "local_timestamp",
        "spw_ts_usec",
        "spw_ts_nsec",
        "spw_incl_length",
        "spw_orig_length",
        "spw_frame_type",
        "spw_direction",
        "spw_port_name",
        "spw_payload_length",
        "spw_duration",
        "spw_logical_addr",
        "spw_protocol_id",
        "spw_ext_protocol_id",
        "spw_data_raw",
        "type",
        "decode_status",
        hex_text(F.col("raw_packet_data")).alias("raw_hex"),
    )


@query
def decode_ccsds_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = decoded(spark, sf_dir)
    return frame.select("offset", *(c for c in frame.columns if c.startswith("ccsds_")))


@query
def decode_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = decoded(spark, sf_dir, compat=True)
    return frame.select(
        "offset",
        "spw_duration",
        "spw_data_raw",
        *(c for c in frame.columns if c.startswith("ccsds_")),
    )


@query
def decode_v2_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, variant="v2").select(
        "offset",
        "local_timestamp",
        "spw_ts_sec",
        "spw_ts_usec",
        "spw_ts_msec",
        "spw_ts_nsec",
        "spw_data_raw",
    )


@query
def decode_v2_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, variant="v2", compat=True).select(
        "offset", "spw_ts_usec", "spw_ts_msec", "spw_ts_nsec", "spw_data_raw", "ccsds_data_raw"
    )


@query
def decode_latin1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets carried as ISO-8859-1 text, decoded through the pluggable decoder."""
    packets = non_empty(messages(spark, sf_dir)).withColumn("value", latin1_text(F.col("value")))
    return decode_packets(packets, clock=fixed_clock(), decoder=latin1_value).select(
        "offset", "spw_ts_nsec", "spw_duration", "spw_data_raw", "type"
    )


@query
def decode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir, "malformed").select("offset", "decode_status")


@query
def quarantine_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(decoded(spark, sf_dir, "malformed")).select(
        "offset", "decode_status", F.length("raw_packet_data").alias("bytes")
    )


@query
def project_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(decoded(spark, sf_dir)).withColumn(
        "raw_packet_data", hex_text(F.col("raw_packet_data"))
    )


@query
def project_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(decoded(spark, sf_dir, variant="v2"), "v2").withColumn(
        "raw_packet_data", hex_text(F.col("raw_packet_data"))
    )


@query
def select_present_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed columns that exist; `no_such_column` does not."""
    return select_present(
        decoded(spark, sf_dir, variant="v2"), [*S.CELL_COLUMNS_V2, "no_such_column", "offset"]
    )


@query
def first_n_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.first_packets(messages(spark, sf_dir), ORDER, 10)
    return first.select("offset", hex_text(F.col("value")).alias("value_hex"))


@query
def first_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = R.first_packets(messages(spark, sf_dir), ORDER, 1)
    return first.select("offset", hex_text(F.col("value")).alias("value_hex"))


@query
def first_packets_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More packets than one task should merge, by port and time."""
    packets = decoded(spark, sf_dir).select("offset", "spw_port_name", "spw_ts_usec")
    return R.first_packets(packets, ["spw_port_name", "spw_ts_usec", "offset"], 4_567)


@query
def first_packets_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many packets as the full workload has, all where there are fewer."""
    first = R.first_packets(messages(spark, sf_dir), ORDER, WORKLOAD)
    return first.select("offset", hex_text(F.col("value")).alias("value_hex"))


# Points


@query
def points_v1_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_points(P.points(decoded(spark, sf_dir)))


@query
def points_v1_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_points(P.points(decoded(spark, sf_dir), optional=False))


@query
def points_v2_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_points(P.points(decoded(spark, sf_dir, variant="v2"), variant="v2"))


@query
def points_v2_mandatory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_points(
        P.points(decoded(spark, sf_dir, variant="v2"), variant="v2", optional=False)
    )


def stored_points(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "points")
    K.write_points(P.points(decoded(spark, sf_dir)), path, tags={"station": "north"})
    return path


@query
def measurement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = Q.scan_measurement(spark, stored_points(spark, sf_dir), "duration")
    return flat_points(scan).select(
        "time_us", "measurement", "eng", "raw", "unit", "subsystem", "station"
    )


@query
def measurement_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Q.read_points(spark, stored_points(spark, sf_dir))
    return Q.list_measurements(stored).select(
        "name",
        "points",
        F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"),
    )


@query
def inventory_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a store that holds an internal measurement too."""
    path = new_path(spark, "points")
    frame = P.points(decoded(spark, sf_dir))
    K.write_points(frame.unionByName(frame.withColumn("measurement", F.lit(Q.INTERNAL))), path)
    listed = Q.list_measurements(Q.read_points(spark, path))
    return listed.select(
        "name",
        "points",
        F.unix_micros("first_time").alias("first_us"),
        F.unix_micros("last_time").alias("last_us"),
    )


@query
def points_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored points by the names of their tags, whose values are texts."""
    path = new_path(spark, "points")
    K.write_points(P.points(decoded(spark, sf_dir)), path, tag_columns=P.tag_names())
    stored = Q.read_points(spark, path)
    tags = Q.tag_columns(stored)
    named = stored.unpivot(["measurement"], tags, "tag", "value")
    return named.groupBy("measurement", "tag", "value").agg(F.count(F.lit(1)).alias("points"))


@query
def conform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = P.points(decoded(spark, sf_dir))
    conformed = P.conform_points(
        frame, P.CONTRACT_OPTIONAL, {"groupdate": "grounddate", "timestamp": "time"}
    )
    return conformed.withColumn("timestamp", F.unix_micros("timestamp"))


@query
def conform_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event texts under the small contract: what does not fit becomes null."""
    frame = events(spark, sf_dir).select(
        "event_id",
        F.col("value").alias("eng"),
        document_field("props", "$.k").alias("dec"),
        F.col("event_type").alias("timestamp"),
        F.col("user_id").alias("confid"),
    )
    contract = (("event_id", "any"), *P.CONTRACT_MANDATORY)
    return P.conform_points(frame, contract).withColumn("timestamp", F.unix_micros("timestamp"))


# Cells


@query
def cells_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packet_cells(decoded(spark, sf_dir), ORDER, "v1", stored=True)


@query
def cells_v1_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packet_cells(decoded(spark, sf_dir), ORDER, "v1_optional", stored=True)


@query
def cells_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packet_cells(decoded(spark, sf_dir, variant="v2"), ORDER, "v2", stored=True)


@query
def cells_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.packet_cells(decoded(spark, sf_dir, compat=True), ORDER, "v1_optional", compat=True, stored=True)


@query
def cells_index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.cell_rows(decoded(spark, sf_dir))
    return C.melt(C.index_keys(rows, "timestamp"), ["eng", "unit"])


@query
def cells_row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.numbered_cell_rows(decoded(spark, sf_dir), ORDER, stored=True)
    return C.sequential_keys(rows, width=12).select(
        "row_key", F.col(C.FAMILY).alias("family"), "timestamp"
    )


def stored_cells(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    cells_path, catalog_path = new_path(spark, "cells"), new_path(spark, "catalog")
    rows = C.numbered_cell_rows(decoded(spark, sf_dir), ORDER, "v1_optional", stored=True)
    K.write_catalog(C.profile_catalog(rows, "v1_optional"), catalog_path)
    K.write_cells(C.sequential_keys(rows, width=12), cells_path, melted=C.melt)
    return cells_path, catalog_path


@query
def cells_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All data rows of one key, by key range, in key order."""
    stored = Q.read_cells(spark, stored_cells(spark, sf_dir)[0])
    return C.key_ordered(C.data_rows(stored, "duration", "duration")).select(
        "row_key", "family", "qualifier", "value"
    )


@query
def cells_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries beside the number of cells stored under each column."""
    cells_path, catalog_path = stored_cells(spark, sf_dir)
    cells, catalog = Q.read_cells(spark, cells_path), spark.read.parquet(catalog_path)
    types = catalog.where(F.col("row_key").endswith(C.TYPE_ROW)).select(
        "family", "qualifier", F.col("value").alias("dtype")
    )
    order = catalog.where(F.col("row_key").endswith(C.ORDER_ROW)).select(
        "family", F.col("value").alias("qualifier"), F.col("qualifier").cast("int").alias("place")
    )
    stored = cells.groupBy("family", "qualifier").agg(F.count(F.lit(1)).alias("cells"))
    return types.join(order, ["family", "qualifier"]).join(
        stored, ["family", "qualifier"], "left"
    )


@query
def cells_row_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the first packet's row, by key, with columns split from qualified names."""
    stored = Q.read_cells(spark, stored_cells(spark, sf_dir)[0])
    cells = C.get_row(stored, f"duration.Row{events(spark, sf_dir).count():012d}", "duration")
    named = F.concat("family", F.lit(":"), "qualifier")
    return cells.select("row_key", V.column_of(named).alias("column"), "value")


@query
def cells_point_gets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of 100 rows by key, every second of them absent, from the files that an index names."""
    path, index = stored_cells(spark, sf_dir)[0], new_path(spark, "cell-index")
    index_cells(spark, path, index)
    last = 2 * events(spark, sf_dir).count() - 1
    keys = [f"{name}.Row{last * k // 49:012d}" for k in range(50) for name in ("duration", "absent")]
    return get_rows(spark, path, index, keys).select("row_key", "family", "qualifier", "value")


@query
def cells_catalog_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical type names of the columns, beside the number of packets."""
    frame = decoded(spark, sf_dir, compat=True)
    rows = C.cell_rows(frame, "v1_optional", compat=True)
    catalog = C.profile_catalog(rows, "v1_optional", compat=True)
    types = catalog.where(F.col("row_key").endswith(C.TYPE_ROW))
    counts = rows.groupBy(F.col(C.FAMILY).alias("family")).agg(F.count(F.lit(1)).alias("rows"))
    return types.join(counts, "family").select(
        "family", "qualifier", F.col("value").alias("dtype"), "rows"
    )


@query
def cells_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written twice: the later write holds."""
    path = new_path(spark, "cells")
    rows = C.sequential_keys(C.numbered_cell_rows(decoded(spark, sf_dir), ORDER, stored=True))
    K.write_cells(C.melt(rows.withColumn("eng", F.col("eng") + 1), ["eng"]), path)
    K.write_cells(C.melt(rows, ["eng"]), path)
    return C.restore(Q.read_cells(spark, path), [("eng", "int64")], "duration", "duration")


@query
def cells_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells_path, catalog_path = stored_cells(spark, sf_dir)
    columns = C.catalog_columns(spark.read.parquet(catalog_path), "duration", "duration")
    wide = C.restore(Q.read_cells(spark, cells_path), columns, "duration", "duration")
    return wide.withColumn("raw_packet_data", hex_text(F.col("raw_packet_data")))


# Series


def port_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times per port, stored: a series is read several times to be put in order."""
    frame = decoded(spark, sf_dir).select(
        "spw_port_name", "spw_ts_usec", "spw_ts_nsec", "offset"
    )
    return materialize(frame, "series")


def two_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet-protocol packets and the other link packets as one series."""
    times = ["spw_ts_usec", "spw_ts_nsec", "offset"]
    frame = decoded(spark, sf_dir).select("type", *times)
    stored = materialize(frame, "series")
    is_ccsds = F.col("type").isin(S.TYPE_TELEMETRY, S.TYPE_TELECOMMAND)
    return R.combine(stored.where(is_ccsds).select(*times), stored.where(~is_ccsds).select(*times))


@query
def interarrival_per_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consecutive_difference(
        port_series(spark, sf_dir),
        "spw_ts_nsec",
        by=["spw_port_name"],
        tie=["offset"],
        name="delta_ns",
    ).select("offset", "spw_port_name", "delta_ns")


@query
def interarrival_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.consecutive_difference(
        two_series(spark, sf_dir), "spw_ts_nsec", tie=["offset"], name="delta_ns"
    ).select("offset", "delta_ns")


@query
def interarrival_global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = R.consecutive_difference(two_series(spark, sf_dir), "spw_ts_usec", tie=["offset"])
    stats = R.difference_stats(deltas)
    return stats.withColumn("avg_delta", F.round(F.col("avg_delta"), 3))


@query
def interarrival_port_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = R.consecutive_difference(
        port_series(spark, sf_dir), "spw_ts_usec", by=["spw_port_name"], tie=["offset"]
    )
    stats = R.difference_stats(deltas, by=["spw_port_name"])
    return stats.withColumn("avg_delta", F.round(F.col("avg_delta"), 3))


@query
def time_ordered_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = decoded(spark, sf_dir).select("spw_ts_nsec", "offset")
    return dense_row_id(frame, ["spw_ts_nsec", "offset"], start=100).select("offset", "row_id")


@query
def packets_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = decoded(spark, sf_dir).select(V.utc_from_micros(F.col("spw_ts_usec")).alias("time"))
    return R.packets_per_window(frame, "time").select(
        F.unix_micros("window_start").alias("start_us"), "packets"
    )


@query
def time_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch units, text and rounded-second conversions of every event time."""
    us = F.col("us")
    frame = events(spark, sf_dir).select(
        "event_id", event_micros().alias("us"), event_text().alias("text"), "props"
    )
    return frame.select(
        "event_id",
        F.unix_micros(V.utc_from_micros(us)).alias("from_us"),
        F.unix_micros(V.utc_from_millis(F.expr("us div 1000"))).alias("from_ms"),
        F.unix_micros(V.parse_timestamp(F.col("text"))).alias("from_text"),
        F.round(V.rounded_millis(F.expr("us div 1000000"), F.expr("(us % 1000000) * 1000")), 1)
        .cast("decimal(18,1)")
        .cast("string")
        .alias("rounded_ms"),
        V.scaled_number(document_field("props", "$.k")).alias("scaled"),
    )


# Sources and sinks


def capture_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = new_path(spark, "captures")
    write_capture_files(packet_order(messages(spark, sf_dir)), folder)
    return folder


def packet_order(packets: DataFrame) -> DataFrame:
    """Consecutive packets in the same partition, so that files follow arrival order."""
    return packets.repartitionByRange("offset").select("offset", "value")


def capture_rows(packets: DataFrame) -> DataFrame:
    return decode_packets(packets, clock=fixed_clock()).select(
        "spw_ts_nsec", "spw_payload_length", "type", hex_text(F.col("raw_packet_data")).alias("raw")
    )


@query
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_rows(read_captures(spark, capture_folder(spark, sf_dir)))


@query
def capture_scan_whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_rows(read_whole_files(spark, capture_folder(spark, sf_dir)))


@query
def capture_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, and how far the packet numbers of the files reach together."""
    files = read_captures(spark, capture_folder(spark, sf_dir)).groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), (F.max("record_no") + 1).alias("last")
    )
    return files.agg(F.sum("n").alias("packets"), F.sum("last").alias("numbered"))


@query
def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets whose number and place in their file are those of one sequential scan."""
    folder = capture_folder(spark, sf_dir)
    place = ["path", "record_no", "byte_offset"]
    whole = read_whole_files(spark, folder).select(*place)
    return capture_rows(read_captures(spark, folder, chunk_bytes=100_000).join(whole, place))


@query
def capture_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first packets of every file, by number, as many as the full workload has."""
    return capture_rows(read_captures(spark, capture_folder(spark, sf_dir), first=WORKLOAD))


@query
def quarantine_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable packets of capture files that a record number and a place come with."""
    packets = messages(spark, sf_dir, "malformed").select(
        F.concat(F.lit("file-"), F.col("offset") % 10).alias("path"),
        F.col("offset").alias("record_no"),
        (F.col("offset") * 100).alias("byte_offset"),
        "value",
    )
    bad = quarantine(decode_packets(non_empty(packets), clock=fixed_clock()))
    return bad.select("path", "record_no", "byte_offset", "decode_status")


@query
def classify_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets per type where empty and missing messages stand between them."""
    frame = decoded(spark, sf_dir, "gaps")
    return frame.groupBy("type").agg(F.count(F.lit(1)).alias("packets"))


@query
def topic_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic gets empty packets, but none for a missing one."""
    path = new_path(spark, "topic")
    K.write_topic(packet_values(messages(spark, sf_dir, "gaps")), "parquet", path=path)
    return spark.read.parquet(path).select(hex_text(F.col("value")).alias("value_hex"))


@query
def log_documents_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a folder and of one that does not exist."""
    path = new_path(spark, "log-text")
    K.write_text_lines(events(spark, sf_dir).select(F.col("props").alias("document")), path)
    return log_documents(spark, path).unionByName(log_documents(spark, new_path(spark, "none")))


@query
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    K.write_archive(messages(spark, sf_dir), path)
    return Q.read_archive(spark, path).select(
        F.decode("key", "UTF-8").alias("key"), hex_text(F.col("value")).alias("value_hex")
    )


@query
def topic_sink_file_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "topic")
    K.write_topic(packet_values(messages(spark, sf_dir)), "parquet", path=path)
    return spark.read.parquet(path).select(hex_text(F.col("value")).alias("value_hex"))


@query
def log_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "logs")
    K.write_json_lines(events(spark, sf_dir).select("event_id", "event_type", "props"), path)
    documents = log_documents(
        spark, path, "event_id bigint, event_type string, props string"
    )
    return documents.select(
        "doc.event_id",
        "doc.event_type",
        document_field("doc.props", "$.k").cast("bigint").alias("k"),
        document_field("document", "$.event_type").alias("schemaless_type"),
    )


@query
def log_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "log-text")
    documents = events(spark, sf_dir).select(F.col("props").alias("document"))
    K.write_text_lines(documents, path)
    return log_documents(spark, path)


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed documents of three forms, and every 50th line no JSON: a number or text as `event_id`, with or without a
    nested object, an array of mixed values, a missing value."""
    form = F.col("event_id") % 3
    a = F.format_string('{"event_id": %d, "props": %s, "ok": true}', "event_id", "props")
    b = F.format_string('{"event_id": "e%d", "tags": ["x", null, {"n": 1}], "a key": 2.5}', "event_id")
    c = F.format_string('{"event_id": %d, "props": null, "tags": []}', "event_id")
    text = F.when(F.col("event_id") % 50 == 0, "no json").when(form == 0, a).when(form == 1, b).otherwise(c)
    path = new_path(spark, "mixed-logs")
    K.write_text_lines(events(spark, sf_dir).select(text.alias("document")), path)
    return typed_documents(spark, path)


@query
def log_documents_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of documents that differ in form."""
    documents = mixed_documents(spark, sf_dir)
    return documents.select(
        typed_field("doc", "$.event_id", "bigint").alias("event_id"),
        typed_field("doc", "$.event_id", "string").alias("id_text"),
        typed_field("doc", "$.props.k", "int").alias("k"),
        typed_field("doc", "$.tags[2].n", "bigint").alias("n"),
        typed_field("doc", "$['a key']", "double").alias("a_key"),
        typed_field("doc", "$.ok", "boolean").alias("ok"),
        F.col("doc").isNull().alias("unreadable"),
    )


@query
def log_document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paths(mixed_documents(spark, sf_dir))


@query
def log_documents_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type that holds all documents."""
    return merged_schema(mixed_documents(spark, sf_dir))


# Streams


def finished_job(spark: SparkSession, sf_dir: str, kind: str = "packets") -> TelemetryJob:
    job = TelemetryJob(new_path(spark, "stream"), clock=fixed_clock())
    run = job.start(
        packet_stream(spark, "parquet", path=message_path(spark, sf_dir, kind)), interval=None
    )
    run.awaitTermination()
    return job


@query
def stream_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Q.read_points(spark, finished_job(spark, sf_dir).points_path)
    return flat_points(stored.drop("batch_id"))


@query
def stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the cells that four micro-batches wrote."""
    job, _ = job_in_parts(spark, sf_dir)
    return Q.read_cells(spark, job.cells_path).select("row_key", "family", "qualifier", "value")


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells after one of the micro-batches has been written again."""
    job, folder = job_in_parts(spark, sf_dir)
    packets = packet_batch(spark, "parquet", path=folder)
    job.write_batch(packets.where(F.col("offset") % PARTS == 2), 2)
    return Q.read_cells(spark, job.cells_path).select("row_key", "family", "qualifier", "value")


@query
def stream_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    job, _ = job_in_parts(spark, sf_dir)
    return packet_counts(spark, job)


@query
def stream_compacted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of a stream of which the first two batches are merged and their folders gone."""
    return flat_points(read_points(spark, merged_job(spark, sf_dir, merges=(1,))))


@query
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells where two batches are merged and two are not."""
    cells = read_store(spark, merged_job(spark, sf_dir, merges=(1,)), "cells")
    return cells.select("row_key", "family", "qualifier", "value")


@query
def merged_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable packets of a run of runs."""
    job = merged_job(spark, sf_dir, "malformed", merges=(1, 3))
    return read_store(spark, job, "quarantine").select("offset", "batch_id", "decode_status")


@query
def merged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a ledger whose batches are merged."""
    job = merged_job(spark, sf_dir, "malformed", merges=(1, 3))
    return ledger.totals(read_store(spark, job, "ledger")).select("sink", "rows", "batches")


@query
def stream_extra_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback of the job's own saw of every micro-batch."""
    job, _ = job_in_parts(spark, sf_dir)
    copied = spark.read.parquet(f"{job.root}/copy")
    return copied.groupBy("batch_id", "type").agg(F.count(F.lit(1)).alias("packets")).withColumn(
        "batch_id", F.col("batch_id").cast("bigint")
    )


@query
def stream_interarrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps per port over four micro-batches with restarts, in which packets come out of order."""
    job = intervals_in_parts(spark, sf_dir)
    return read_gaps(spark, job).select("offset", "spw_port_name", "delta_ns")


@query
def stream_interarrival_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batches of that stream kept: a state of one row per port, and no late packet."""
    kept = records(spark, intervals_in_parts(spark, sf_dir))
    return kept.agg(
        F.sum("gaps").alias("gaps"), F.sum("late").alias("late"), F.max("series").alias("series")
    )


@query
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = finished_job(spark, sf_dir, "malformed")
    return spark.read.parquet(job.quarantine_path).select("offset", "decode_status")


@query
def stream_batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = finished_job(spark, sf_dir, "malformed")
    return ledger.totals(ledger.read(spark, job.ledger_path)).select("sink", "rows")


def streamed_captures(spark: SparkSession, sf_dir: str, max_packets: int) -> DataFrame:
    """Packets of a capture folder as a stream gave them, with `batch_id`. The stream is stopped after its first
    batch and started again."""
    folder, root = capture_folder(spark, sf_dir), new_path(spark, "capture-stream")

    def keep(packets: DataFrame, batch_id: int) -> None:
        packets.write.mode("overwrite").parquet(f"{root}/packets/batch_id={batch_id}")

    def start(**trigger):
        writer = capture_stream(spark, folder, max_packets=max_packets).writeStream.foreachBatch(keep)
        return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()

    start(availableNow=True).awaitTermination()
    run = start(processingTime="0 seconds")
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(f"{root}/packets")


def quarter(spark: SparkSession, sf_dir: str) -> int:
    return -(-events(spark, sf_dir).count() // 4)


@query
def stream_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_rows(streamed_captures(spark, sf_dir, quarter(spark, sf_dir)))


@query
def stream_capture_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of every micro-batch where the limit is a quarter of all."""
    packets = streamed_captures(spark, sf_dir, quarter(spark, sf_dir))
    return packets.groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("packets"))


@query
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = new_path(spark, "stream-archive"), new_path(spark, "checkpoint")
    stream = packet_stream(spark, "parquet", path=message_path(spark, sf_dir))
    archive_stream(stream, path, checkpoint, interval=None).awaitTermination()
    return Q.read_archive(spark, path).select(
        F.decode("key", "UTF-8").alias("key"), hex_text(F.col("value")).alias("value_hex")
    )

