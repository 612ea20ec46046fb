"""A packet builder and a plain decoder to test against, both on `struct`."""

from __future__ import annotations

import struct


def packet(
    *,
    sec=1522920989,
    nanos=746678112,
    incl=None,
    orig=None,
    frame=2,
    flags=0,
    port=b"SPW-4",
    payload=b"",
    declared=None,
    lsb=5,
    unused=b"\0\0\0",
    msb=0,
):
    declared = len(payload) if declared is None else declared
    incl = len(payload) + 24 if incl is None else incl
    orig = incl if orig is None else orig
    return (
        struct.pack("<IIII", sec, nanos, incl, orig)
        + frame.to_bytes(3, "little")
        + bytes([flags])
        + port.ljust(8, b"\0")
        + struct.pack("<II", declared, lsb)
        + unused
        + bytes([msb])
        + payload
    )


def ccsds(
    *,
    version=0,
    telecommand=0,
    secondary=1,
    apid=7,
    seq_flags=3,
    seq=9,
    length=12,
    flag=0,
    pus=1,
    ack=9,
    service=3,
    subtype=25,
    source=1,
    data=b"\x01\x02\x03",
    check=0xBEEF,
):
    identity = version << 13 | telecommand << 12 | secondary << 11 | apid
    return (
        bytes([0xFE, 2, 0, 0])
        + struct.pack(">HHH", identity, seq_flags << 14 | seq, length)
        + bytes([flag << 7 | pus << 4 | ack, service, subtype, source])
        + data
        + struct.pack(">H", check)
    )


def decode(value: bytes) -> dict:
    """Corrected-value decode of one packet, and its status."""
    if len(value) < 40:
        return {"decode_status": "short_header"}
    sec, nanos, incl, orig = struct.unpack_from("<IIII", value)
    word, lsb = struct.unpack_from("<II", value, 28)
    declared = word & 0x0FFFFFFF
    payload = value[40 : 40 + declared]
    try:
        port = value[20:28].decode("utf-8").split("\0")[0]
    except UnicodeDecodeError:
        port = None
    row = {
        "spw_ts_usec": (sec * 10**9 + nanos) // 1000,
        "spw_ts_nsec": sec * 10**9 + nanos,
        "spw_incl_length": incl,
        "spw_orig_length": orig,
        "spw_frame_type": int.from_bytes(value[16:19], "little"),
        "spw_direction": value[19] >> 5 & 1,
        "spw_port_name": port,
        "spw_payload_length": declared,
        "spw_duration": value[39] << 32 | lsb,
    }
    if len(payload) < 3:
        return row | {"decode_status": "bad_port" if port is None else "short_payload"}
    address, protocol, extended = payload[:3]
    row |= {
        "spw_logical_addr": address,
        "spw_protocol_id": protocol,
        "spw_ext_protocol_id": extended,
        "spw_data_raw": payload.hex(),
    }
    status = "truncated_payload" if len(payload) < declared else "ok"
    if protocol != 2:
        row["type"] = "RMAP" if protocol == 1 else "SPW_RAW"
    elif len(payload) < 16:
        status = "short_ccsds"
    else:
        identity, sequence, length = struct.unpack_from(">HHH", payload, 4)
        first, service, subtype, source = payload[10:14]
        row |= {
            "ccsds_packet_ver_num": identity >> 13,
            "ccsds_type": identity >> 12 & 1,
            "ccsds_sec_header": bool(identity >> 11 & 1),
            "ccsds_apid": identity & 0x7FF,
            "ccsds_seq_flags": sequence >> 14,
            "ccsds_seq_count": sequence & 0x3FFF,
            "ccsds_packet_len": length,
            "ccsds_sec_header_flag": bool(first >> 7),
            "ccsds_pus_ver_num": first >> 4 & 7,
            "ccsds_ack": first & 15,
            "ccsds_service_type": service,
            "ccsds_service_subtype": subtype,
            "ccsds_source_id": source,
            "ccsds_data_raw": payload[14:-2].hex(),
            "ccsds_error_control": int.from_bytes(payload[-2:], "big"),
            "type": "TC" if identity >> 12 & 1 else "TM",
        }
    return row | {"decode_status": "bad_port" if port is None else status}
