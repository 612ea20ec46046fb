"""The registered queries as plain SQL on the given tables.

The SQL never decodes bytes: it states each expected field from the event row that
the packet was built from.
"""

from __future__ import annotations

from linktm.plans.data import CLOCK_US


def _le(n: str) -> str:
    return (
        f"printf('%02X%02X%02X%02X', ({n}) & 255, (({n}) >> 8) & 255, "
        f"(({n}) >> 16) & 255, (({n}) >> 24) & 255)"
    )


BASE = f"""
WITH b AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) * 1000 + event_id % 1000 AS ns,
    octet_length(encode(props)) AS bl, hex(encode(props)) AS body,
    CAST(round(value * 100) AS BIGINT) AS lsb, event_id % 4 AS k,
    printf('%02X', 200 + event_id % 50) AS address
  FROM events),
q AS (
  SELECT *, CASE
      WHEN k < 2 THEN address || '020000'
        || printf('%04X', event_id % 8 * 8192 + (CASE WHEN k = 1 THEN 4096 ELSE 0 END)
          + (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2048 END) + user_id % 2048)
        || printf('%04X', event_id // 8 % 4 * 16384 + event_id // 4 % 16384) || printf('%04X', bl + 5)
        || printf('%02X', event_id // 4 % 256)
        || printf('%02X', 1 + event_id % 20) || printf('%02X', event_id % 5)
        || printf('%02X', user_id % 256) || body || printf('%04X', event_id % 65536)
      WHEN k = 2 THEN address || '014C' || body ELSE address || 'F000' || body END AS payload,
    CAST(bl + CASE WHEN k < 2 THEN 16 ELSE 3 END AS INTEGER) AS pl,
    (event_id % 3) * 4294967296 + lsb AS duration,
    CAST(concat(event_id % 3, lsb) AS BIGINT) AS duration_text,
    'SPW-' || (user_id % 10) AS port,
    CASE k WHEN 0 THEN 'TM' WHEN 1 THEN 'TC' WHEN 2 THEN 'RMAP' ELSE 'SPW_RAW' END AS type
  FROM b),
p AS (
  SELECT *, lower({_le('us // 1000000')} || {_le('(us % 1000000) * 1000 + event_id % 1000')}
    || {_le('pl + 24')} || {_le('pl + 24')} || printf('%02X', event_id % 7) || '0000'
    || CASE WHEN user_id % 2 = 1 THEN '20' ELSE '00' END || rpad(hex(encode(port)), 16, '0')
    || {_le('pl')} || {_le('lsb')} || '000000' || printf('%02X', event_id % 3)
    || payload) AS raw,
    {CLOCK_US} AS clock_us, {CLOCK_US // 1000} AS clock_ms
  FROM q)
"""

_CCSDS = """
  CAST(CASE WHEN k < 2 THEN event_id % 8 {else_int} END AS INTEGER) AS ccsds_packet_ver_num,
  CAST(CASE WHEN k < 2 THEN k {else_int} END AS INTEGER) AS ccsds_type,
  CASE WHEN k < 2 THEN {header} END AS ccsds_sec_header,
  CAST(CASE WHEN k < 2 THEN user_id % 2048 {else_int} END AS INTEGER) AS ccsds_apid,
  CAST(CASE WHEN k < 2 THEN event_id // 8 % 4 {else_int} END AS INTEGER) AS ccsds_seq_flags,
  CAST(CASE WHEN k < 2 THEN event_id // 4 % 16384 {else_int} END AS INTEGER) AS ccsds_seq_count,
  CAST(CASE WHEN k < 2 THEN bl + 5 {else_int} END AS INTEGER) AS ccsds_packet_len,
  CASE WHEN k < 2 THEN {flag} END AS ccsds_sec_header_flag,
  CAST(CASE WHEN k < 2 THEN event_id // 4 // 16 % 8 {else_int} END AS INTEGER) AS ccsds_pus_ver_num,
  CAST(CASE WHEN k < 2 THEN event_id // 4 % 16 {else_int} END AS INTEGER) AS ccsds_ack,
  CAST(CASE WHEN k < 2 THEN 1 + event_id % 20 {else_int} END AS INTEGER) AS ccsds_service_type,
  CAST(CASE WHEN k < 2 THEN event_id % 5 {else_int} END AS INTEGER) AS ccsds_service_subtype,
  CAST(CASE WHEN k < 2 THEN user_id % 256 {else_int} END AS INTEGER) AS ccsds_source_id,
  CASE WHEN k < 2 THEN lower(body) {else_text} END AS ccsds_data_raw,
  CAST(CASE WHEN k < 2 THEN event_id % 65536 {else_int} END AS INTEGER) AS ccsds_error_control
"""
CCSDS = _CCSDS.format(
    else_int="", else_text="", flag="event_id // 4 % 256 >= 128", header="event_id % 3 <> 0"
)
CCSDS_COMPAT = _CCSDS.format(else_int="ELSE -1", else_text="ELSE '-1'", flag="true", header="true")

APID = "CAST(CASE WHEN k < 2 THEN user_id % 2048 END AS INTEGER)"
SEQ = "CAST(CASE WHEN k < 2 THEN event_id // 4 % 16384 END AS INTEGER)"
SERVICE = "CAST(CASE WHEN k < 2 THEN 1 + event_id % 20 END AS INTEGER)"
SUBTYPE = "CAST(CASE WHEN k < 2 THEN event_id % 5 END AS INTEGER)"
CCSDS_DATA = "CASE WHEN k < 2 THEN lower(body) END"
OTHER_DATA = "CASE WHEN k >= 2 THEN lower(payload) END"

MEASURED = """
, m AS (
  SELECT *, 'payloadlength' AS measurement, 0 AS mno, CAST(pl AS BIGINT) AS v, 'bytes' AS unit FROM p
  UNION ALL
  SELECT *, 'duration', 1, duration, 'nanoseconds' FROM p)
"""
NUMBERED = """
, r AS (
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 + mno * n AS row_no
  FROM (SELECT *, count(*) OVER (PARTITION BY mno) AS n FROM m)
  WHERE mno = 0
  UNION ALL
  SELECT *, row_number() OVER (ORDER BY event_id) - 1 + mno * n AS row_no
  FROM (SELECT *, count(*) OVER (PARTITION BY mno) AS n FROM m)
  WHERE mno = 1)
"""
# Row numbers of four micro-batches, the k-th with the events that leave k: they run through the
# measurements of a batch and on into the next batch.
IN_PARTS = """
, z AS (SELECT event_id % 4 AS part, count(*) AS n FROM p GROUP BY event_id % 4)
, r AS (
  SELECT m.*, row_number() OVER (PARTITION BY event_id % 4, mno ORDER BY event_id) - 1 + mno * z.n
      + 2 * (SELECT coalesce(sum(y.n), 0) FROM z y WHERE y.part < event_id % 4)::BIGINT AS row_no
  FROM m JOIN z ON z.part = event_id % 4)
"""

DETAILS_V1 = f"""
  clock_us AS grounddate, clock_us AS simulationdate, clock_us AS localdate,
  'cb4223af4ba' AS confid, {APID} AS appid, 0 AS vcid, port AS subsystem,
  {SERVICE} AS puss, {SUBTYPE} AS pusss, true AS status_processed, false AS status_invalid,
  false AS status_obsolete, false AS status_caution, false AS status_action,
  false AS status_alarm, port AS source, '1.2' AS sbd, type
"""
POINTS_V1 = f"""
  SELECT measurement, us AS time_us, {DETAILS_V1}, v AS eng, v AS dec,
    '0x' || printf('%x', v) AS raw, unit FROM m
"""
CONFORMED = f"""
  SELECT clock_us AS groupdate, clock_us AS simulationdate, clock_us AS "Localdate", v AS eng,
    CAST(v AS DOUBLE) AS dec, '0x' || printf('%x', v) AS raw, us AS timestamp,
    'cb4223af4ba' AS confid, {APID} AS appid, 0 AS vcid, port AS subsystem, {SERVICE} AS puss,
    {SUBTYPE} AS pusss, true AS status_processed, false AS status_invalid,
    false AS status_obsolete, false AS status_caution, false AS status_action,
    false AS status_alarm, port AS source, '1.2' AS sbd, unit, type FROM m
"""

# A packet cut by `event_id % 7`, and the first problem a reader meets.
DAMAGED = """
, d AS (
  SELECT *, CASE event_id % 7 WHEN 1 THEN 3 WHEN 2 THEN 40 WHEN 3 THEN 50
      WHEN 4 THEN 39 + pl ELSE 40 + pl END AS bytes FROM p),
s AS (
  SELECT *, CASE
      WHEN bytes < 40 THEN 'short_header'
      WHEN event_id % 7 = 5 THEN 'bad_port'
      WHEN least(pl, bytes - 40) < 3 THEN 'short_payload'
      WHEN k < 2 AND least(pl, bytes - 40) < 16 THEN 'short_ccsds'
      WHEN bytes - 40 < pl THEN 'truncated_payload'
      ELSE 'ok' END AS decode_status FROM d)
"""
UNREADABLE = "decode_status NOT IN ('ok', 'truncated_payload')"


def _melt(columns: dict[str, str], key: str, source: str = "r") -> str:
    """One SELECT per column; null values give no cell."""
    return " UNION ALL ".join(
        f"SELECT {key} AS row_key, measurement AS family, '{name}' AS qualifier, "
        f"CAST({text} AS VARCHAR) AS value FROM {source} WHERE ({text}) IS NOT NULL"
        for name, text in columns.items()
    )


ROW_KEY = "measurement || '.Row' || CAST(row_no AS VARCHAR)"
PADDED_KEY = "measurement || '.Row' || lpad(CAST(row_no AS VARCHAR), 12, '0')"
BASE64 = "to_base64(unhex(raw))"
VALUES = {"eng": "v", "dec": "v", "raw_packet_data": BASE64, "unit": "unit"}
DETAIL_TEXTS = {
    "grounddate": "clock_us",
    "simulationdate": "clock_us",
    "localdate": "clock_us",
    "confid": "'cb4223af4ba'",
    "appid": APID,
    "vcid": "0",
    "subsystem": "port",
    "puss": SERVICE,
    "pusss": SUBTYPE,
    "status_processed": "'true'",
    "status_invalid": "'false'",
    "status_obsolete": "'false'",
    "status_caution": "'false'",
    "status_action": "'false'",
    "status_alarm": "'false'",
    "source": "port",
    "sbd": "'1.2'",
    "type": "type",
}
CELLS_V1 = {"timestamp": "us", "confid": "'cb4223af4ba'", **VALUES}
FULL = {"timestamp": "us", **DETAIL_TEXTS, **VALUES}
# The tags of the first revision's points; the other columns are fields.
TAG_TEXTS = {
    name: text
    for name, text in {**DETAIL_TEXTS, "unit": "unit"}.items()
    if name not in ("grounddate", "simulationdate", "localdate")
}
COMPAT_VALUE = "CASE WHEN mno = 0 THEN pl ELSE duration_text END"
COMPAT = {
    **{name: text.replace("'true'", "'True'").replace("'false'", "'False'") for name, text in DETAIL_TEXTS.items()},
    "appid": "CASE WHEN k < 2 THEN user_id % 2048 ELSE -1 END",
    "puss": "CASE WHEN k < 2 THEN 1 + event_id % 20 ELSE -1 END",
    "pusss": "CASE WHEN k < 2 THEN event_id % 5 ELSE -1 END",
    "eng": COMPAT_VALUE,
    "dec": COMPAT_VALUE,
    "raw_packet_data": BASE64,
    "unit": "unit",
}
V2_CELLS = {
    "spw_port_name": "port",
    "spw_data_raw": OTHER_DATA,
    "local_timestamp": "clock_ms",
    "ccsds_data_raw": CCSDS_DATA,
    "spw_ts_usec": "(us % 1000000) * 1000 + event_id % 1000",
}
PLACES = ", ".join(
    f"('{name}', {place}, '{kind}')"
    for place, (name, kind) in enumerate(
        [
            (
                name,
                "int64"
                if name in ("timestamp", "grounddate", "simulationdate", "localdate", "eng", "dec")
                else "int32"
                if name in ("appid", "vcid", "puss", "pusss")
                else "bool"
                if name.startswith("status_")
                else "bytes"
                if name == "raw_packet_data"
                else "object",
            )
            for name in FULL
        ]
    )
)

RAW_MESSAGES = "SELECT CAST(user_id AS VARCHAR) AS key, raw AS value_hex FROM p"

ORACLES: dict[str, str] = {
    "classify_packets": BASE + "SELECT type, count(*) AS packets FROM p GROUP BY type",
    "decode_link_headers": BASE
    + """SELECT event_id AS "offset", clock_us AS local_timestamp, ns // 1000 AS spw_ts_usec,
      ns AS spw_ts_nsec, CAST(pl + 24 AS BIGINT) AS spw_incl_length,
      CAST(pl + 24 AS BIGINT) AS spw_orig_length, CAST(event_id % 7 AS INTEGER) AS spw_frame_type,
      CAST(user_id % 2 AS INTEGER) AS spw_direction, port AS spw_port_name,
      pl AS spw_payload_length, duration AS spw_duration, CAST(200 + event_id % 50 AS INTEGER) AS spw_logical_addr,
      CASE WHEN k < 2 THEN 2 WHEN k = 2 THEN 1 ELSE 240 END AS spw_protocol_id,
      CASE WHEN k = 2 THEN 76 ELSE 0 END AS spw_ext_protocol_id,
      lower(payload) AS spw_data_raw, type, 'ok' AS decode_status, raw AS raw_hex FROM p""",
    "decode_ccsds_headers": BASE + f'SELECT event_id AS "offset", {CCSDS} FROM p',
    "decode_compat": BASE
    + f"""SELECT event_id AS "offset", duration_text AS spw_duration,
      lower(payload) AS spw_data_raw, {CCSDS_COMPAT} FROM p""",
    "decode_v2_times": BASE
    + f"""SELECT event_id AS "offset", clock_ms AS local_timestamp, us // 1000000 AS spw_ts_sec,
      (us % 1000000) * 1000 + event_id % 1000 AS spw_ts_usec, us AS spw_ts_msec,
      ns AS spw_ts_nsec, {OTHER_DATA} AS spw_data_raw FROM p""",
    "decode_v2_compat": BASE
    + """SELECT event_id AS "offset", (us % 1000000) * 1000 + event_id % 1000 AS spw_ts_usec,
      CAST(trunc((CAST(us // 1000000 AS DOUBLE)
        + CAST((us % 1000000) * 1000 + event_id % 1000 AS DOUBLE) / 1e9::DOUBLE) * 1e6::DOUBLE) AS BIGINT)
        AS spw_ts_msec,
      CAST(NULL AS BIGINT) AS spw_ts_nsec,
      CASE WHEN k < 2 THEN '-1' ELSE lower(payload) END AS spw_data_raw,
      CASE WHEN k < 2 THEN lower(body) ELSE '-1' END AS ccsds_data_raw FROM p""",
    "decode_latin1_values": BASE
    + """SELECT event_id AS "offset", ns AS spw_ts_nsec, duration AS spw_duration,
      lower(payload) AS spw_data_raw, type FROM p""",
    "decode_status": BASE + DAMAGED + 'SELECT event_id AS "offset", decode_status FROM s',
    "quarantine_malformed": BASE
    + DAMAGED
    + f"""SELECT event_id AS "offset", decode_status, CAST(bytes AS INTEGER) AS bytes
      FROM s WHERE {UNREADABLE}""",
    "project_v1": BASE
    + f"""SELECT clock_us AS local_timestamp, us AS spw_ts_usec, port AS spw_port_name,
      pl AS spw_payload_length, duration AS spw_duration, {APID} AS ccsds_apid,
      {SERVICE} AS ccsds_service_type, {SUBTYPE} AS ccsds_service_subtype, type,
      raw AS raw_packet_data, lower(payload) AS spw_data_raw, {CCSDS_DATA} AS ccsds_data_raw
      FROM p""",
    "project_v2": BASE
    + f"""SELECT clock_ms AS local_timestamp,
      (us % 1000000) * 1000 + event_id % 1000 AS spw_ts_usec, us AS spw_ts_msec,
      port AS spw_port_name, pl AS spw_payload_length, duration AS spw_duration,
      {APID} AS ccsds_apid, {SERVICE} AS ccsds_service_type,
      {SUBTYPE} AS ccsds_service_subtype, type, raw AS raw_packet_data,
      {OTHER_DATA} AS spw_data_raw, {CCSDS_DATA} AS ccsds_data_raw, {SEQ} AS ccsds_seq_count
      FROM p""",
    "select_present": BASE
    + f"""SELECT port AS spw_port_name, {OTHER_DATA} AS spw_data_raw,
      clock_ms AS local_timestamp, {CCSDS_DATA} AS ccsds_data_raw,
      (us % 1000000) * 1000 + event_id % 1000 AS spw_ts_usec, event_id AS "offset" FROM p""",
    "first_n_packets": BASE
    + 'SELECT event_id AS "offset", raw AS value_hex FROM p ORDER BY event_id LIMIT 10',
    "first_packet": BASE
    + 'SELECT event_id AS "offset", raw AS value_hex FROM p ORDER BY event_id LIMIT 1',
    "first_packets_selected": BASE
    + """SELECT event_id AS "offset", port AS spw_port_name, us AS spw_ts_usec FROM p
      ORDER BY spw_port_name, spw_ts_usec, "offset" LIMIT 4567""",
    "first_packets_workload": BASE
    + 'SELECT event_id AS "offset", raw AS value_hex FROM p ORDER BY event_id LIMIT 863928',
    "points_v1_optional": BASE + MEASURED + POINTS_V1,
    "points_v1_mandatory": BASE
    + MEASURED
    + """SELECT measurement, clock_us AS time_us, 'cb4223af4ba' AS confid, v AS eng, v AS dec,
      '0x' || printf('%x', v) AS raw, unit FROM m""",
    "points_v2_optional": BASE
    + MEASURED
    + f"""SELECT measurement, us AS time_us, clock_ms AS "Grounddate", clock_ms AS "BoardDate",
      clock_ms AS localdate, {APID} AS "Apid", {SEQ} AS "SequenceCount",
      'cb4223af4ba' AS confid, 'MONITORING' AS "MonitoringStatus", 0 AS "ChannelId",
      {SERVICE} AS "ServiceType", {SUBTYPE} AS "ServiceSubType", true AS "Status_IsProcessed",
      false AS "Status_IsInvalid", false AS "Status_IsObsolete", false AS "Status_IsCaution",
      false AS "Status_IsOOR", false AS "Status_IsAction", 'NONE' AS "Status_StateLevel",
      type, type AS source, '1.2' AS subsystem, '0x' || printf('%x', v) AS "EngineeringValue",
      v AS "DecodedValue", '0x' || printf('%x', v) AS "RawValue", unit FROM m""",
    "points_v2_mandatory": BASE
    + MEASURED
    + """SELECT measurement, clock_ms * 1000 AS time_us, 'cb4223af4ba' AS confid,
      '0x' || printf('%x', v) AS "EngineeringValue", v AS "DecodedValue",
      '0x' || printf('%x', v) AS "RawValue", unit FROM m""",
    "measurement_scan": BASE
    + MEASURED
    + """SELECT us AS time_us, measurement, v AS eng, '0x' || printf('%x', v) AS raw, unit,
      port AS subsystem, 'north' AS station FROM m WHERE measurement = 'duration'""",
    "measurement_inventory": BASE
    + MEASURED
    + """SELECT measurement AS name, count(*) AS points, min(us) AS first_us, max(us) AS last_us
      FROM m GROUP BY measurement""",
    "inventory_internal": BASE
    + MEASURED
    + """SELECT measurement AS name, count(*) AS points, min(us) AS first_us, max(us) AS last_us
      FROM m GROUP BY measurement""",
    "points_tagged": BASE
    + MEASURED
    + ", t AS ("
    + " UNION ALL ".join(
        f"SELECT measurement, '{name}' AS tag, CAST({text} AS VARCHAR) AS value FROM m"
        for name, text in TAG_TEXTS.items()
    )
    + ") SELECT measurement, tag, value, count(*) AS points FROM t GROUP BY ALL",
    "conform_points": BASE + MEASURED + CONFORMED,
    "conform_events": """SELECT event_id, value AS eng,
      TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS dec,
      CAST(NULL AS BIGINT) AS timestamp, CAST(user_id AS VARCHAR) AS confid FROM events""",
    "cells_v1": BASE
    + MEASURED
    + NUMBERED
    + _melt(CELLS_V1, ROW_KEY),
    "cells_v1_optional": BASE + MEASURED + NUMBERED + _melt(FULL, ROW_KEY),
    "cells_v2": BASE
    + MEASURED
    + NUMBERED
    + _melt(V2_CELLS, "'test.Row' || CAST(row_no AS VARCHAR)"),
    "cells_compat": BASE + MEASURED + NUMBERED + _melt(COMPAT, ROW_KEY),
    "cells_index_keys": BASE
    + MEASURED
    + _melt({"eng": "v", "unit": "unit"}, "measurement || '.Row' || CAST(us AS VARCHAR)", "m"),
    "cells_row_keys": BASE
    + MEASURED
    + NUMBERED
    + f"SELECT {PADDED_KEY} AS row_key, measurement AS family, us AS timestamp FROM r",
    "cells_range_scan": BASE
    + MEASURED
    + NUMBERED
    + f"""SELECT * FROM ({_melt(FULL, PADDED_KEY)})
      WHERE row_key >= 'duration.Row' AND row_key < 'duration.Rox' AND family = 'duration'""",
    "cells_catalog": BASE
    + MEASURED
    + NUMBERED
    + f"""SELECT s.family, s.qualifier, c.dtype, c.place, s.cells
      FROM (SELECT family, qualifier, count(*) AS cells
            FROM ({_melt(FULL, PADDED_KEY)}) GROUP BY family, qualifier) s
      JOIN (VALUES {PLACES}) c(qualifier, place, dtype) ON s.qualifier = c.qualifier""",
    "cells_row_get": BASE
    + MEASURED
    + NUMBERED
    + f"""SELECT row_key, qualifier AS "column", value FROM ({_melt(FULL, PADDED_KEY)})
      WHERE row_key = 'duration.Row' || lpad(CAST((SELECT count(*) FROM events) AS VARCHAR), 12, '0')""",
    "cells_point_gets": BASE
    + MEASURED
    + NUMBERED
    + f"""SELECT row_key, family, qualifier, value FROM ({_melt(FULL, PADDED_KEY)})
      WHERE row_key IN (SELECT 'duration.Row' || lpad(CAST((2 * (SELECT count(*) FROM events) - 1) * k // 49 AS VARCHAR), 12, '0')
        FROM range(50) t(k))""",
    "cells_catalog_compat": f"""SELECT family, qualifier, CASE dtype WHEN 'int32' THEN 'int64' ELSE dtype END AS dtype, (SELECT count(*) FROM events) AS rows
      FROM (VALUES {PLACES}) c(qualifier, place, dtype), (VALUES ('payloadlength'), ('duration')) f(family)
      WHERE qualifier <> 'timestamp'""",
    "cells_rewritten": BASE
    + MEASURED
    + NUMBERED
    + f"SELECT {ROW_KEY} AS row_key, v AS eng FROM r WHERE measurement = 'duration'",
    "cells_restore": BASE
    + MEASURED
    + NUMBERED
    + f"""SELECT {PADDED_KEY} AS row_key, us AS timestamp, {DETAILS_V1}, v AS eng, v AS dec,
      raw AS raw_packet_data, unit FROM r WHERE measurement = 'duration'""",
    "interarrival_per_port": BASE
    + """SELECT * FROM (SELECT event_id AS "offset", port AS spw_port_name,
      ns - lag(ns) OVER (PARTITION BY port ORDER BY ns, event_id) AS delta_ns FROM p)
      WHERE delta_ns IS NOT NULL""",
    "interarrival_global": BASE
    + """SELECT * FROM (SELECT event_id AS "offset",
      ns - lag(ns) OVER (ORDER BY ns, event_id) AS delta_ns FROM p)
      WHERE delta_ns IS NOT NULL""",
    "interarrival_global_stats": BASE
    + """SELECT count(d) AS n, round(avg(d), 3) AS avg_delta, min(d) AS min_delta,
      max(d) AS max_delta
      FROM (SELECT us - lag(us) OVER (ORDER BY us, event_id) AS d FROM p)""",
    "interarrival_port_stats": BASE
    + """SELECT port AS spw_port_name, count(d) AS n, round(avg(d), 3) AS avg_delta,
      min(d) AS min_delta, max(d) AS max_delta
      FROM (SELECT port, us - lag(us) OVER (PARTITION BY port ORDER BY us, event_id) AS d FROM p)
      WHERE d IS NOT NULL GROUP BY port""",
    "time_ordered_row_ids": BASE
    + 'SELECT event_id AS "offset", 99 + row_number() OVER (ORDER BY ns, event_id) AS row_id FROM p',
    "packets_per_window": BASE
    + """SELECT us // 10000000 * 10000000 AS start_us, count(*) AS packets FROM p
      GROUP BY us // 10000000""",
    "time_conversions": """SELECT event_id, epoch_us(ts) AS from_us,
      epoch_us(ts) // 1000 * 1000 AS from_ms, epoch_us(ts) AS from_text,
      CAST(CAST((epoch_us(ts) // 1000000 * 10000
        + (epoch_us(ts) % 1000000 * 1000 + 50000) // 100000) AS DECIMAL(18, 1)) / 10
        AS DECIMAL(18, 1))::VARCHAR AS rounded_ms,
      CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000 AS scaled FROM events""",
    "capture_scan": BASE
    + """SELECT ns AS spw_ts_nsec, pl AS spw_payload_length, type, raw FROM p""",
    "capture_scan_whole_files": BASE
    + """SELECT ns AS spw_ts_nsec, pl AS spw_payload_length, type, raw FROM p""",
    "capture_numbering": "SELECT count(*) AS packets, count(*) AS numbered FROM events",
    "capture_records": BASE
    + """SELECT ns AS spw_ts_nsec, pl AS spw_payload_length, type, raw FROM p""",
    "capture_first_n": BASE
    + """SELECT ns AS spw_ts_nsec, pl AS spw_payload_length, type, raw FROM p""",
    "quarantine_captures": BASE
    + DAMAGED
    + f"""SELECT 'file-' || (event_id % 10) AS path, event_id AS record_no,
      event_id * 100 AS byte_offset, decode_status FROM s WHERE {UNREADABLE}""",
    "classify_with_gaps": BASE + "SELECT type, count(*) AS packets FROM p GROUP BY type",
    "topic_with_gaps": BASE
    + "SELECT raw AS value_hex FROM p UNION ALL SELECT '' FROM p WHERE event_id % 5 = 0",
    "log_documents_missing": "SELECT props AS document FROM events",
    "archive_roundtrip": BASE + RAW_MESSAGES,
    "topic_sink_file_target": BASE + "SELECT raw AS value_hex FROM p",
    "log_documents": """SELECT event_id, event_type,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS schemaless_type
      FROM events""",
    "log_text_sink": "SELECT props AS document FROM events",
    "log_documents_variant": """SELECT
      CASE WHEN NOT bad AND f <> 1 THEN event_id END AS event_id,
      CASE WHEN NOT bad THEN (CASE WHEN f = 1 THEN 'e' ELSE '' END) || event_id END AS id_text,
      CASE WHEN NOT bad AND f = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
      CASE WHEN NOT bad AND f = 1 THEN 1::BIGINT END AS n,
      CASE WHEN NOT bad AND f = 1 THEN 2.5::DOUBLE END AS a_key,
      CASE WHEN NOT bad AND f = 0 THEN true END AS ok, bad AS unreadable
      FROM (SELECT *, event_id % 3 AS f, event_id % 50 = 0 AS bad FROM events)""",
    "log_document_paths": """SELECT path, kind, count(*) AS n
      FROM (SELECT event_id % 3 AS f FROM events WHERE event_id % 50 <> 0) JOIN (VALUES
        (0, '$', 'object'), (0, '$.event_id', 'integer'), (0, '$.props', 'object'), (0, '$.props.k', 'integer'),
        (0, '$.ok', 'boolean'),
        (1, '$', 'object'), (1, '$.event_id', 'string'), (1, '$.tags', 'array'), (1, '$.tags[*]', 'string'),
        (1, '$.tags[*]', 'null'), (1, '$.tags[*]', 'object'), (1, '$.tags[*].n', 'integer'),
        (1, '$[''a key'']', 'number'),
        (2, '$', 'object'), (2, '$.event_id', 'integer'), (2, '$.props', 'null'), (2, '$.tags', 'array')
      ) AS v(form, path, kind) ON f = form GROUP BY path, kind""",
    "log_documents_schema": """SELECT DISTINCT 'OBJECT<`a key`: DECIMAL(2,1), event_id: VARIANT, ok: BOOLEAN, '
      || 'props: OBJECT<k: BIGINT>, tags: ARRAY<VARIANT>>' AS merged FROM events""",
    "stream_points": BASE + MEASURED + POINTS_V1,
    "stream_cells": BASE + MEASURED + IN_PARTS + _melt(CELLS_V1, ROW_KEY),
    "stream_replay": BASE + MEASURED + IN_PARTS + _melt(CELLS_V1, ROW_KEY),
    "stream_compacted_points": BASE + MEASURED + POINTS_V1,
    "merged_cells": BASE + MEASURED + IN_PARTS + _melt(CELLS_V1, ROW_KEY),
    "merged_quarantine": BASE
    + DAMAGED
    + f"""SELECT event_id AS "offset", event_id % 4 AS batch_id, decode_status FROM s WHERE {UNREADABLE}""",
    "merged_ledger": BASE
    + DAMAGED
    + f"""SELECT 'points' AS sink, 2 * count(*) AS rows, 4 AS batches FROM s WHERE NOT ({UNREADABLE})
      UNION ALL SELECT 'received', count(*), 4 FROM s
      UNION ALL SELECT 'cells', 12 * count(*), 4 FROM s WHERE NOT ({UNREADABLE})
      UNION ALL SELECT 'quarantine', count(*), 4 FROM s WHERE {UNREADABLE}""",
    "stream_batch_counts": """SELECT event_id % 4 AS batch_id, count(*) AS packets FROM events
      GROUP BY event_id % 4""",
    "stream_extra_sink": BASE
    + "SELECT event_id % 4 AS batch_id, type, count(*) AS packets FROM p GROUP BY ALL",
    "stream_interarrival": BASE
    + """SELECT * FROM (SELECT event_id AS "offset", port AS spw_port_name,
      ns - lag(ns) OVER (PARTITION BY port ORDER BY ns, event_id) AS delta_ns FROM p)
      WHERE delta_ns IS NOT NULL""",
    "stream_interarrival_records": BASE
    + """SELECT count(*) - count(DISTINCT port) AS gaps, 0 AS late, count(DISTINCT port) AS series
      FROM p""",
    "stream_quarantine": BASE
    + DAMAGED
    + f'SELECT event_id AS "offset", decode_status FROM s WHERE {UNREADABLE}',
    "stream_batch_ledger": BASE
    + DAMAGED
    + f"""SELECT 'points' AS sink, 2 * count(*) AS rows FROM s WHERE NOT ({UNREADABLE})
      UNION ALL SELECT 'received', count(*) FROM s
      UNION ALL SELECT 'cells', 12 * count(*) FROM s WHERE NOT ({UNREADABLE})
      UNION ALL SELECT 'quarantine', count(*) FROM s WHERE {UNREADABLE}""",
    "stream_captures": BASE
    + """SELECT ns AS spw_ts_nsec, pl AS spw_payload_length, type, raw FROM p""",
    "stream_capture_batches": """SELECT k AS batch_id, least((n + 3) // 4, n - k * ((n + 3) // 4)) AS packets
      FROM (SELECT count(*) AS n FROM events), (SELECT unnest(range(4)) AS k)
      WHERE n - k * ((n + 3) // 4) > 0""",
    "stream_archive": BASE + RAW_MESSAGES,
}
