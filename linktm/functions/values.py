"""Time, text and typed-value conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("bigint"))


def utc_from_millis(millis: Column) -> Column:
    """Timestamp of epoch milliseconds; fractions are kept to the microsecond."""
    return F.timestamp_micros(F.round(millis * 1000).cast("bigint"))


def rounded_millis(seconds: Column, nanos: Column) -> Column:
    """Milliseconds of (seconds, nanoseconds) with the second's fraction rounded to
    four decimals, ties upwards; the rounding is done on integers."""
    tenths_of_millis = F.floor((nanos + 50_000) / 100_000)
    return (seconds + tenths_of_millis / 10_000.0) * 1000.0


def parse_timestamp(text: Column, pattern: str | None = None) -> Column:
    """Timestamp of a date-time text; null when it cannot be read."""
    return F.try_to_timestamp(text) if pattern is None else F.try_to_timestamp(text, F.lit(pattern))


def scaled_number(text: Column, factor: int = 1000) -> Column:
    """Number in a text times `factor`; null when the text is not a number."""
    return text.try_cast("double") * factor


def cell_text(column: Column, dtype: str, *, python_booleans: bool = False) -> Column:
    """Text stored in a cell. Bytes are kept as base64 so they can be read back."""
    if dtype == "binary":
        return F.replace(F.base64(column), F.lit("\r\n"), F.lit(""))
    if dtype == "boolean" and python_booleans:
        return F.initcap(column.cast("string"))
    return column.cast("string")


def typed_cell(text: Column, dtype: str) -> Column:
    """Typed value of a cell text, by catalogue dtype; null when it does not fit."""
    if dtype == "bytes":
        return F.unbase64(text)
    return text.try_cast(SPARK_TYPES[dtype])


# Catalogue dtype names and the types they stand for. `bytes` marks
# base64 text.
SPARK_TYPES = {
    "int64": "bigint",
    "int32": "int",
    "float64": "double",
    "float32": "float",
    "bool": "boolean",
    "object": "string",
    "bytes": "binary",
    "datetime64[ns, UTC]": "timestamp",
}
DTYPE_NAMES = {spark_type: name for name, spark_type in SPARK_TYPES.items()}


def dtype_name(spark_type: str) -> str:
    return DTYPE_NAMES.get(spark_type, "object")


def row_key(key: str, suffix: Column, width: int = 0) -> Column:
    """`<key>.Row<suffix>`; `width` pads numbers so that key order is number order."""
    text = suffix.cast("string")
    if width:
        text = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(f"{key}.Row"), text)


def qualified(family: str, name: str) -> str:
    return f"{family}:{name}"


def column_of(qualifier: Column) -> Column:
    """Column part of `family:column`."""
    return F.split_part(qualifier, F.lit(":"), F.lit(2))


def json_line(*columns: str) -> Column:
    """The given columns as one JSON document."""
    return F.to_json(F.struct(*columns))
