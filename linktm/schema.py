"""Packet layout, fixed values and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Byte lengths of the three stacked link headers and of the
# global header that opens a capture file.
RECORD_HEADER = 16
LINK_HEADER = 12
SPACEWIRE_HEADER = 12
HEADER_BYTES = RECORD_HEADER + LINK_HEADER + SPACEWIRE_HEADER
CAPTURE_HEADER = 24

# The payload length occupies the low 28 bits of its word.
PAYLOAD_LENGTH_BITS = 28

# Protocol identifiers and packet type names.
PROTOCOL_RMAP = 1
PROTOCOL_CCSDS = 2
TYPE_TELEMETRY = "TM"
TYPE_TELECOMMAND = "TC"
TYPE_RMAP = "RMAP"
TYPE_RAW = "SPW_RAW"
NOT_APPLICABLE = -1

# Shortest payload that carries the three protocol bytes, and
# shortest packet-protocol payload (14 header bytes plus 2 of error control).
PROTOCOL_BYTES = 3
CCSDS_BYTES = 16
CCSDS_HEADER_BYTES = 14

# Fixed values of the point model.
CONFIGURATION_ID = "cb4223af4ba"
DATABASE_VERSION = "1.2"
STATUS_SET, STATUS_CLEAR = True, False
CHANNEL_ID = 0
MONITORING_STATUS = "MONITORING"
STATE_LEVEL = "NONE"

# Fixed values: (measurement, decoded column that holds its value, unit); add a
# row to publish another decoded column.
MEASUREMENTS = (
    ("payloadlength", "spw_payload_length", "bytes"),
    ("duration", "spw_duration", "nanoseconds"),
)

# Message coordinates travel with the payload: (offset, partition, topic)
# identifies a packet and fixes its place in arrival order.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
ARRIVAL_ORDER = ("offset", "partition", "topic")

CELL_SCHEMA = "row_key string, family string, qualifier string, value string"

# Names and order of the decoded columns.
DECODED_V1 = (
    "local_timestamp",
    "spw_ts_usec",
    "spw_ts_nsec",
    "spw_incl_length",
    "spw_orig_length",
    "spw_frame_type",
    "spw_port_name",
    "spw_payload_length",
    "spw_duration",
    "spw_protocol_id",
    "spw_logical_addr",
    "spw_data_raw",
    "spw_direction",
    "spw_ext_protocol_id",
    "ccsds_packet_ver_num",
    "ccsds_type",
    "ccsds_sec_header",
    "ccsds_apid",
    "ccsds_seq_flags",
    "ccsds_seq_count",
    "ccsds_packet_len",
    "ccsds_sec_header_flag",
    "ccsds_pus_ver_num",
    "ccsds_ack",
    "ccsds_service_type",
    "ccsds_service_subtype",
    "ccsds_source_id",
    "ccsds_data_raw",
    "ccsds_error_control",
    "type",
    "raw_packet_data",
)
# The second revision adds a time column after `spw_ts_usec` and the seconds.
DECODED_V2 = (
    DECODED_V1[:2] + ("spw_ts_msec",) + DECODED_V1[2:3] + ("spw_ts_sec",) + DECODED_V1[3:]
)

# The columns kept for the sinks.
PROJECTED_V1 = (
    "local_timestamp",
    "spw_ts_usec",
    "spw_port_name",
    "spw_payload_length",
    "spw_duration",
    "ccsds_apid",
    "ccsds_service_type",
    "ccsds_service_subtype",
    "type",
    "raw_packet_data",
    "spw_data_raw",
    "ccsds_data_raw",
)
PROJECTED_V2 = PROJECTED_V1[:2] + ("spw_ts_msec",) + PROJECTED_V1[2:] + ("ccsds_seq_count",)

# Cell columns of the second revision, in order.
CELL_COLUMNS_V2 = (
    "spw_port_name",
    "spw_data_raw",
    "local_timestamp",
    "ccsds_data_raw",
    "spw_ts_usec",
)

# Tag names of the point shapes, in order.
TAGS_V1 = (
    "confid",
    "appid",
    "vcid",
    "subsystem",
    "puss",
    "pusss",
    "status_processed",
    "status_invalid",
    "status_obsolete",
    "status_caution",
    "status_action",
    "status_alarm",
    "source",
    "sbd",
    "unit",
    "type",
)
TAGS_V2 = (
    "confid",
    "MonitoringStatus",
    "ChannelId",
    "ServiceType",
    "ServiceSubType",
    "Status_IsProcessed",
    "Status_IsInvalid",
    "Status_IsObsolete",
    "Status_IsCaution",
    "Status_IsOOR",
    "Status_IsAction",
    "Status_StateLevel",
    "type",
    "source",
    "subsystem",
    "unit",
)
