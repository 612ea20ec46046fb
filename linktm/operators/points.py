"""Decoded packets -> measurement points.

One pass turns each packet into one point per measurement; the measurement list is
data (`schema.MEASUREMENTS`), not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linktm import schema as S
from linktm.functions.bytes import hex_number
from linktm.functions.values import utc_from_micros, utc_from_millis

Measurements = tuple[tuple[str, str, str], ...]


def fan_out(
    frame: DataFrame, measurements: Measurements = S.MEASUREMENTS, *, ordinal: bool = False
) -> DataFrame:
    """One row per packet and measurement, with `measurement`, `value` and `unit`;
    `ordinal` adds the measurement's place in the list."""
    cells: list[Column] = []
    for place, (name, column, unit) in enumerate(measurements):
        cells += [F.lit(place), F.lit(name), F.col(column).cast("bigint"), F.lit(unit)]
    rows = frame.select(
        "*",
        F.stack(F.lit(len(measurements)), *cells).alias(
            "measurement_no", "measurement", "value", "unit"
        ),
    )
    return rows if ordinal else rows.drop("measurement_no")


def _columns_v1(optional: bool) -> dict[str, Column]:
    confid = {"confid": F.lit(S.CONFIGURATION_ID)}
    values = {
        "eng": F.col("value"),
        "dec": F.col("value"),
        "raw": hex_number(F.col("value")),
        "unit": F.col("unit"),
    }
    if not optional:
        return {"time": utc_from_micros(F.col("local_timestamp")), **confid, **values}
    return {
        "time": utc_from_micros(F.col("spw_ts_usec")),
        **details_v1(),
        **values,
    }


def details_v1() -> dict[str, Column]:
    """Dates, tags and literals of the full first-revision shape, in order."""
    local = F.col("local_timestamp")
    clear = F.lit(S.STATUS_CLEAR)
    return {
        "grounddate": local,
        "simulationdate": local,
        "localdate": local,
        "confid": F.lit(S.CONFIGURATION_ID),
        "appid": F.col("ccsds_apid"),
        "vcid": F.lit(S.CHANNEL_ID),
        "subsystem": F.col("spw_port_name"),
        "puss": F.col("ccsds_service_type"),
        "pusss": F.col("ccsds_service_subtype"),
        "status_processed": F.lit(S.STATUS_SET),
        "status_invalid": clear,
        "status_obsolete": clear,
        "status_caution": clear,
        "status_action": clear,
        "status_alarm": clear,
        "source": F.col("spw_port_name"),
        "sbd": F.lit(S.DATABASE_VERSION),
        "type": F.col("type"),
    }


def _columns_v2(optional: bool) -> dict[str, Column]:
    confid = {"confid": F.lit(S.CONFIGURATION_ID)}
    values = {
        "EngineeringValue": hex_number(F.col("value")),
        "DecodedValue": F.col("value"),
        "RawValue": hex_number(F.col("value")),
        "unit": F.col("unit"),
    }
    local = F.col("local_timestamp")
    if not optional:
        return {"time": utc_from_millis(local), **confid, **values}
    clear = F.lit(S.STATUS_CLEAR)
    return {
        # Microseconds, whatever the column's name says.
        "time": utc_from_micros(F.col("spw_ts_msec")),
        "Grounddate": local,
        "BoardDate": local,
        "localdate": local,
        "Apid": F.col("ccsds_apid"),
        "SequenceCount": F.col("ccsds_seq_count"),
        **confid,
        "MonitoringStatus": F.lit(S.MONITORING_STATUS),
        "ChannelId": F.lit(S.CHANNEL_ID),
        "ServiceType": F.col("ccsds_service_type"),
        "ServiceSubType": F.col("ccsds_service_subtype"),
        "Status_IsProcessed": F.lit(S.STATUS_SET),
        "Status_IsInvalid": clear,
        "Status_IsObsolete": clear,
        "Status_IsCaution": clear,
        "Status_IsOOR": clear,
        "Status_IsAction": clear,
        "Status_StateLevel": F.lit(S.STATE_LEVEL),
        "type": F.col("type"),
        "source": F.col("type"),
        "subsystem": F.lit(S.DATABASE_VERSION),
        **values,
    }


def points(
    decoded: DataFrame,
    *,
    variant: str = "v1",
    optional: bool = True,
    measurements: Measurements = S.MEASUREMENTS,
) -> DataFrame:
    """Measurement points of decoded packets (decoded with the same `variant`).

    optional  the full shape, or only time, configuration id and values.
    """
    columns = (_columns_v1 if variant == "v1" else _columns_v2)(optional)
    return fan_out(decoded, measurements).select(
        "measurement", *(column.alias(name) for name, column in columns.items())
    )


def tag_names(variant: str = "v1", optional: bool = True) -> tuple[str, ...]:
    """Names of the tag columns of a point shape; the others are fields."""
    if not optional:
        return ("confid",)
    return S.TAGS_V1 if variant == "v1" else S.TAGS_V2


def with_tags(frame: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Add the same tag values to every point of a frame."""
    return frame.withColumns({name: F.lit(value) for name, value in tags.items()})


# The declared point contracts (name, type); `any` keeps the type of
# the column that is there.
CONTRACT_MANDATORY = (
    ("eng", "any"),
    ("dec", "double"),
    ("timestamp", "timestamp"),
    ("confid", "string"),
)
CONTRACT_OPTIONAL = (
    ("groupdate", "bigint"),
    ("simulationdate", "bigint"),
    ("Localdate", "bigint"),
    ("eng", "any"),
    ("dec", "double"),
    ("raw", "string"),
    ("timestamp", "timestamp"),
    ("confid", "string"),
    ("appid", "int"),
    ("vcid", "int"),
    ("subsystem", "string"),
    ("puss", "int"),
    ("pusss", "int"),
    ("status_processed", "boolean"),
    ("status_invalid", "boolean"),
    ("status_obsolete", "boolean"),
    ("status_caution", "boolean"),
    ("status_action", "boolean"),
    ("status_alarm", "boolean"),
    ("source", "string"),
    ("sbd", "string"),
    ("unit", "string"),
    ("type", "string"),
)


def conform_points(
    frame: DataFrame,
    contract: tuple[tuple[str, str], ...] = CONTRACT_OPTIONAL,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """Cast a frame to a declared contract. Values that do not fit become null, and
    so do columns that are missing; `renames` maps contract names to frame names."""
    renames = renames or {}
    types: dict[str, T.DataType] = {f.name.lower(): f.dataType for f in frame.schema.fields}

    def conformed(name: str, wanted: str) -> Column:
        source = renames.get(name, name)
        if source.lower() not in types:
            return F.lit(None).cast("string" if wanted == "any" else wanted)
        column = F.col(source)
        return column if wanted == "any" else column.try_cast(wanted)

    return frame.select(*(conformed(name, wanted).alias(name) for name, wanted in contract))
