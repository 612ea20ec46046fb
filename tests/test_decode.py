import random

import pytest
from pyspark.sql import functions as F
from reference_decode import ccsds, decode, packet

from linktm import schema as S
from linktm.operators.decode import (
    decode_packets,
    latin1_value,
    non_empty,
    project,
    quarantine,
    readable,
    select_present,
)

SKIPPED = {"local_timestamp", "raw_packet_data"}


def frame(spark, values):
    return spark.createDataFrame(
        [(i, None if v is None else bytearray(v)) for i, v in enumerate(values)],
        "id int, value binary",
    )


def rows(spark, values, **options):
    decoded = decode_packets(frame(spark, values), **options)
    return [r.asDict() for r in decoded.orderBy("id").collect()]


EDGES = {
    "three bytes": b"\x01\x02\x03",
    "39 bytes": packet()[:39],
    "header only": packet(),
    "one payload byte": packet(payload=b"\xfe"),
    "two payload bytes": packet(payload=b"\xfe\x02"),
    "three payload bytes": packet(payload=b"\xfe\x01\x4c"),
    "cut payload": packet(payload=b"\xfe\x01\x4c\x55", declared=900),
    "cut ccsds": packet(payload=ccsds(data=b"abc")[:-1], declared=19),
    "bytes after payload": packet(payload=ccsds()) + b"trailing",
    "short with bytes after": packet(payload=b"\xfe\x02\x00\x00", declared=2),
    "top length bits": packet(payload=ccsds(), declared=0xF0000000 | len(ccsds())),
    "long duration": packet(payload=ccsds(), msb=1, lsb=5),
    "longest duration": packet(payload=ccsds(), msb=255, lsb=2**32 - 1, unused=b"\xff\xff\xff"),
    "latest time": packet(payload=ccsds(), sec=2**32 - 1, nanos=999_999_999),
    "high sub-second": packet(payload=ccsds(), sec=2**31, nanos=2**32 - 1),
    "long record": packet(payload=ccsds(), incl=2**31, orig=2**32 - 1),
    "full port": packet(payload=ccsds(), port=b"ABCDEFGH"),
    "port after nul": packet(payload=ccsds(), port=b"AB\0CD"),
    "utf-8 port": packet(payload=ccsds(), port="äö".encode()),
    "empty port": packet(payload=ccsds(), port=b""),
    "bad port": packet(payload=ccsds(), port=b"\xff\xfe"),
    "bad port after nul": packet(payload=ccsds(), port=b"AB\0\xff"),
    "bad port, no payload": packet(port=b"\xff"),
    "no secondary header": packet(payload=ccsds(secondary=0)),
    "all header bits": packet(
        payload=ccsds(
            version=7, telecommand=1, apid=2047, seq_flags=3, seq=16383, length=65535,
            flag=1, pus=7, ack=15, service=255, subtype=255, source=255, check=65535,
        )
    ),
    "no header bits": packet(
        payload=ccsds(
            secondary=0, apid=0, seq_flags=0, seq=0, length=0, pus=0, ack=0,
            service=0, subtype=0, source=0, check=0, data=b"",
        )
    ),
    "15 ccsds bytes": packet(payload=ccsds(data=b"")[:15]),
    "14 ccsds bytes": packet(payload=ccsds(data=b"")[:14]),
    "13 ccsds bytes": packet(payload=ccsds(data=b"")[:13]),
    "direction": packet(payload=ccsds(), flags=0x20),
    "other flags": packet(payload=ccsds(), flags=0xDF, frame=0xABCDEF),
    "all flags": packet(payload=ccsds(), flags=0xFF, frame=0xFFFFFF),
}


def check(spark, values):
    for value, row in zip(values, rows(spark, values)):
        expected = decode(value)
        for name in (*S.DECODED_V1, "decode_status"):
            if name not in SKIPPED:
                assert row[name] == expected.get(name), (name, value.hex())
        assert bytes(row["raw_packet_data"]) == value


def test_edge_packets(spark):
    check(spark, list(EDGES.values()))


def test_random_packets(spark):
    r = random.Random(3)
    values = []
    for _ in range(400):
        payload = r.choice([ccsds(data=r.randbytes(r.randint(0, 40))), r.randbytes(r.randint(0, 30))])
        value = bytearray(packet(payload=payload))
        for _ in range(r.randint(0, 12)):
            value[r.randrange(len(value))] = r.randrange(256)
        values.append(bytes(value[: r.randint(0, len(value)) or None] if r.random() < 0.3 else value))
    check(spark, values)


def test_schema(spark):
    decoded = decode_packets(frame(spark, [packet(payload=ccsds())]))
    assert decoded.columns == ["id", *S.DECODED_V1, "decode_status"]
    types = dict(decoded.dtypes)
    for name in ("local_timestamp", "spw_ts_usec", "spw_ts_nsec", "spw_duration"):
        assert types[name] == "bigint"
    assert types["spw_incl_length"] == types["spw_orig_length"] == "bigint"
    assert types["ccsds_sec_header"] == types["ccsds_sec_header_flag"] == "boolean"
    assert types["raw_packet_data"] == "binary"
    others = set(S.DECODED_V1) - {n for n, t in types.items() if t in ("bigint", "boolean", "binary", "string")}
    assert {types[n] for n in others} == {"int"}


def test_second_revision(spark):
    values = [packet(payload=ccsds()), packet(payload=b"\xfe\x01\x4c\x55")]
    clock = F.timestamp_micros(F.lit(1522920989746678))
    tm, rmap = rows(spark, values, variant="v2", clock=clock)
    assert tm["local_timestamp"] == 1522920989746
    assert (tm["spw_ts_sec"], tm["spw_ts_usec"]) == (1522920989, 746678112)
    assert tm["spw_ts_msec"] == 1522920989746678
    assert tm["spw_data_raw"] is None and rmap["spw_data_raw"] == "fe014c55"


def test_compat_values(spark):
    values = [
        packet(payload=ccsds(secondary=0, flag=0), msb=1, lsb=5),
        packet(payload=b"\xfe\x01\x4c\x55"),
        packet(payload=ccsds(data=b"")[:14]),
    ]
    tm, rmap, short = rows(spark, values, compat=True)
    assert tm["spw_duration"] == 15
    assert tm["ccsds_sec_header"] is True and tm["ccsds_sec_header_flag"] is True
    assert rmap["ccsds_apid"] == -1 and rmap["ccsds_ack"] == -1
    assert rmap["ccsds_data_raw"] == "-1" and rmap["ccsds_sec_header"] is None
    assert short["decode_status"] == "ok" and short["ccsds_data_raw"] == ""
    assert short["ccsds_error_control"] == 25 << 8 | 1
    tm, rmap, _ = rows(spark, values, compat=True, variant="v2")
    assert tm["spw_data_raw"] == "-1" and tm["spw_ts_nsec"] is None
    assert tm["spw_ts_msec"] == int((1522920989 + 746678112 / 10**9) * 10**6)


def test_empty_messages_are_dropped(spark):
    kept = non_empty(frame(spark, [None, b"", b"\x01", packet()]))
    assert [r.id for r in kept.orderBy("id").collect()] == [2, 3]


def test_missing_value_is_a_short_header(spark):
    assert rows(spark, [None])[0]["decode_status"] == "short_header"


def test_quarantine_and_readable_split_the_packets(spark):
    values = list(EDGES.values())
    decoded = decode_packets(frame(spark, values)).withColumn("offset", F.col("id").cast("bigint"))
    bad, good = quarantine(decoded), readable(decoded)
    assert bad.columns == ["id", "offset", "decode_status", "raw_packet_data"]
    assert bad.count() + good.count() == len(values)
    assert {r.decode_status for r in good.collect()} == {"ok", "truncated_payload"}


def test_latin1_text_values(spark):
    value = packet(payload=ccsds(data=bytes(range(256))))
    text = spark.createDataFrame([(value.decode("latin-1"),)], "value string")
    row = decode_packets(text, decoder=latin1_value).first()
    assert bytes(row["raw_packet_data"]) == value
    assert row["ccsds_data_raw"] == bytes(range(256)).hex()


def test_projections(spark):
    v1 = decode_packets(frame(spark, [packet()]))
    assert len(project(v1).columns) == 12
    v2 = decode_packets(frame(spark, [packet()]), variant="v2")
    assert len(project(v2, "v2").columns) == 14
    assert select_present(v1, ["type", "missing", "spw_ts_usec"]).columns == ["type", "spw_ts_usec"]


def test_unknown_variant(spark):
    with pytest.raises(ValueError):
        decode_packets(frame(spark, [packet()]), variant="v3")
