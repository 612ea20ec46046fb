"""Binary packet -> typed columns, as one chain of built-in expressions.

    packets.transform(non_empty).transform(decode_packets)

The transform works the same on a batch and on a streaming frame, needs no
shuffle and no Python worker, and never fails on a malformed packet: unreadable
fields are null and `decode_status` names the first problem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm import schema as S
from linktm.functions.bytes import (
    bits,
    hex_text,
    high32,
    int32,
    latin1_bytes,
    low32,
    octets,
    swap32,
    text_until_nul,
    word,
)

OK = "ok"
TRUNCATED = "truncated_payload"
# A truncated packet is still decoded from the bytes that are there.
READABLE = (OK, TRUNCATED)


def raw_bytes(value: Column) -> Column:
    """Default message decoder: the value already holds the packet bytes."""
    return value


def latin1_value(value: Column) -> Column:
    """Message decoder for packets carried as ISO-8859-1 text."""
    return latin1_bytes(value)


def non_empty(packets: DataFrame) -> DataFrame:
    """Keep messages that carry at least one byte."""
    return packets.where(F.col("value").isNotNull() & (F.length("value") > 0))


def packet_values(packets: DataFrame) -> DataFrame:
    """The message values alone."""
    return packets.select("value")


def decode_packets(
    packets: DataFrame,
    *,
    variant: str = "v1",
    compat: bool = False,
    clock: Column | None = None,
    decoder: Callable[[Column], Column] = raw_bytes,
) -> DataFrame:
    """Decode `packets.value`; the other columns of `packets` are kept in front.

    variant  "v1" or "v2": the two revisions of the decoded columns.
    compat   reproduce the historical values: -1 instead of null for fields that
             do not apply, header flags always true, duration as a decimal
             concatenation and floating-point times.
    clock    timestamp recorded as `local_timestamp` (default: query time).
    decoder  turns the message value into packet bytes.
    """
    if variant not in ("v1", "v2"):
        raise ValueError(f"unknown variant {variant!r}")
    kept = [name for name in packets.columns if name != "value"]
    clock = F.current_timestamp() if clock is None else clock

    # Each stage names values that the next one uses more than once; the stages
    # run in one generated loop and unused columns are dropped from all of them.
    # The head is padded to a fixed size and the words are never null, which keeps
    # the generated code small enough for the JVM to compile; `when` guards turn
    # fields without bytes into null at the end.
    framed = packets.select(
        *kept, F.coalesce(decoder(F.col("value")), F.lit(b"")).alias("value")
    ).select(
        *kept,
        "value",
        F.length("value").alias("_size"),
        F.rpad("value", S.HEADER_BYTES + S.CCSDS_HEADER_BYTES, F.lit(b"\0")).alias("_head"),
    )
    head = F.col("_head")
    words = framed.select(
        "*",
        word(head, 0, 8).alias("_time_be"),
        word(head, 8, 8).alias("_lengths_be"),
        word(head, 16, 4).alias("_link_be"),
        word(head, 28, 8).alias("_wire_be"),
        word(head, 39, 1).alias("_msb"),
        word(head, 40, 8).alias("_start"),
        word(head, 48, 6).alias("_rest"),
        text_until_nul(octets(head, 20, 8)).alias("_port"),
    )
    swapped = words.select(
        "*",
        *(swap32(F.col(f"_{name}_be")).alias(f"_{name}") for name in ("time", "lengths", "wire")),
    )
    fields = swapped.select(
        "*",
        high32(F.col("_time")).alias("_sec"),
        low32(F.col("_time")).alias("_sub"),
        bits(F.col("_wire"), 32, S.PAYLOAD_LENGTH_BITS).cast("int").alias("_declared"),
        int32(F.col("_link_be")).alias("_link"),
        int32(high32(F.col("_start"))).alias("_lead"),
        int32(F.col("_start")).alias("_primary"),
        int32(F.col("_rest")).alias("_field"),
    ).withColumn("_protocol", bits(F.col("_lead"), 16, 8)).withColumn("_present", F.least(F.col("_declared"), F.col("_size") - S.HEADER_BYTES))

    shortest = S.CCSDS_HEADER_BYTES if compat else S.CCSDS_BYTES
    n_present, declared = F.col("_present"), F.col("_declared")
    ready = fields.select(
        "*",
        (F.col("_size") >= S.HEADER_BYTES).alias("_linked"),
        (n_present >= S.PROTOCOL_BYTES).alias("_carried"),
        ((F.col("_protocol") == S.PROTOCOL_CCSDS) & (n_present >= S.PROTOCOL_BYTES)).alias(
            "_is_ccsds"
        ),
        ((F.col("_protocol") == S.PROTOCOL_CCSDS) & (n_present >= shortest)).alias("_ccsds"),
    )

    link, lead = F.col("_link"), F.col("_lead")
    primary, field = F.col("_primary"), F.col("_field")
    linked, carried, ccsds = F.col("_linked"), F.col("_carried"), F.col("_ccsds")
    other = carried & ~F.col("_is_ccsds")
    payload = hex_text(octets(F.col("value"), S.HEADER_BYTES, n_present))
    data_start = S.HEADER_BYTES + S.CCSDS_HEADER_BYTES
    data = hex_text(octets(F.col("value"), data_start, n_present - S.CCSDS_BYTES))
    check = word(F.col("value"), F.lit(S.HEADER_BYTES - 2) + n_present, 2)

    def link_int(column: Column) -> Column:
        return F.when(linked, column)

    def payload_int(column: Column) -> Column:
        return F.when(carried, column)

    def ccsds_int(column: Column) -> Column:
        if compat:
            return F.when(ccsds, column).when(other, S.NOT_APPLICABLE)
        return F.when(ccsds, column)

    def ccsds_flag(column: Column) -> Column:
        return F.when(ccsds, F.lit(True) if compat else column == 1)

    nanos = F.col("_sec") * 1_000_000_000 + F.col("_sub")
    micros = F.expr("(_sec * 1000000000 + _sub) div 1000")
    ccsds_data = F.when(ccsds, F.when(n_present > S.CCSDS_BYTES, data).otherwise(""))
    if compat:
        ccsds_data = ccsds_data.when(other, str(S.NOT_APPLICABLE))

    if variant == "v1":
        spacewire_data = F.when(carried, payload)
        times = {
            "local_timestamp": F.unix_micros(clock),
            "spw_ts_usec": link_int(micros),
            "spw_ts_nsec": link_int(nanos),
        }
    else:
        spacewire_data = F.when(other, payload)
        if compat:
            spacewire_data = spacewire_data.when(F.col("_is_ccsds"), str(S.NOT_APPLICABLE))
            micros = F.expr("cast((cast(_sec as double) + _sub / 1e9D) * 1e6D as bigint)")
        times = {
            "local_timestamp": F.unix_millis(clock),
            "spw_ts_usec": link_int(F.col("_sub")),
            "spw_ts_msec": link_int(micros),
            "spw_ts_nsec": F.lit(None).cast("bigint") if compat else link_int(nanos),
            "spw_ts_sec": link_int(F.col("_sec")),
        }
    duration = (
        F.concat(F.col("_msb").cast("string"), low32(F.col("_wire")).cast("string")).cast("bigint")
        if compat
        else F.shiftleft(F.col("_msb"), 32).bitwiseOR(low32(F.col("_wire")))
    )
    type_bit = bits(primary, 28, 1)

    columns = {
        **times,
        "spw_incl_length": link_int(high32(F.col("_lengths"))),
        "spw_orig_length": link_int(low32(F.col("_lengths"))),
        # Three little-endian bytes, then the byte that holds the direction bit.
        "spw_frame_type": link_int(
            bits(link, 24, 8)
            .bitwiseOR(F.shiftright(link, 8).bitwiseAND(0xFF00))
            .bitwiseOR(F.shiftleft(link, 8).bitwiseAND(0xFF0000))
        ),
        "spw_port_name": link_int(F.col("_port")),
        "spw_payload_length": link_int(declared),
        "spw_duration": link_int(duration),
        "spw_protocol_id": payload_int(F.col("_protocol")),
        "spw_logical_addr": payload_int(bits(lead, 24, 8)),
        "spw_data_raw": spacewire_data,
        "spw_direction": link_int(bits(link, 5, 1)),
        "spw_ext_protocol_id": payload_int(bits(lead, 8, 8)),
        "ccsds_packet_ver_num": ccsds_int(bits(primary, 29, 3)),
        "ccsds_type": ccsds_int(type_bit),
        "ccsds_sec_header": ccsds_flag(bits(primary, 27, 1)),
        "ccsds_apid": ccsds_int(bits(primary, 16, 11)),
        "ccsds_seq_flags": ccsds_int(bits(primary, 14, 2)),
        "ccsds_seq_count": ccsds_int(bits(primary, 0, 14)),
        "ccsds_packet_len": ccsds_int(bits(F.col("_rest"), 32, 16).cast("int")),
        "ccsds_sec_header_flag": ccsds_flag(bits(field, 31, 1)),
        "ccsds_pus_ver_num": ccsds_int(bits(field, 28, 3)),
        "ccsds_ack": ccsds_int(bits(field, 24, 4)),
        "ccsds_service_type": ccsds_int(bits(field, 16, 8)),
        "ccsds_service_subtype": ccsds_int(bits(field, 8, 8)),
        "ccsds_source_id": ccsds_int(bits(field, 0, 8)),
        "ccsds_data_raw": ccsds_data,
        "ccsds_error_control": ccsds_int(check.cast("int")),
        "type": (
            F.when(ccsds & (type_bit == 1), S.TYPE_TELECOMMAND)
            .when(ccsds, S.TYPE_TELEMETRY)
            .when(other & (F.col("_protocol") == S.PROTOCOL_RMAP), S.TYPE_RMAP)
            .when(other, S.TYPE_RAW)
        ),
        "raw_packet_data": F.col("value"),
        "decode_status": (
            F.when(~linked, "short_header")
            .when(F.col("_port").isNull(), "bad_port")
            .when(~carried, "short_payload")
            .when(F.col("_is_ccsds") & ~ccsds, "short_ccsds")
            .when(n_present < declared, TRUNCATED)
            .otherwise(OK)
        ),
    }
    order = S.DECODED_V1 if variant == "v1" else S.DECODED_V2
    return ready.select(
        *kept, *(columns[name].alias(name) for name in order + ("decode_status",))
    )


def readable(decoded: DataFrame) -> DataFrame:
    """Packets whose fields could be read, cut payloads included."""
    return decoded.where(F.col("decode_status").isin(*READABLE))


def quarantine(decoded: DataFrame) -> DataFrame:
    """Packets that could not be read, with their bytes, the reason, and every column that stood
    beside the packet's value: its place in a topic or in a capture file."""
    of_packet = {*S.DECODED_V1, *S.DECODED_V2, "decode_status", "raw_packet_data"}
    kept = [c for c in decoded.columns if c not in of_packet]
    return decoded.where(~F.col("decode_status").isin(*READABLE)).select(
        *kept, "decode_status", "raw_packet_data"
    )


def project(decoded: DataFrame, variant: str = "v1") -> DataFrame:
    """The columns the sinks use."""
    return decoded.select(*(S.PROJECTED_V1 if variant == "v1" else S.PROJECTED_V2))


def select_present(frame: DataFrame, names: list[str] | tuple[str, ...]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return frame.select(*(name for name in names if name in frame.columns))
