"""Sparse key/value cells: (row_key, family, qualifier, value as text).

Wide rows become one cell per non-null column; a catalogue of column types and
order, stored beside the cells, turns them back into typed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm import schema as S
from linktm.functions.values import cell_text, dtype_name, row_key, typed_cell
from linktm.operators.decode import select_present
from linktm.operators.points import details_v1, fan_out
from linktm.operators.slices import ROWS_PER_SLICE, dense_row_id

KEY, FAMILY = "_key", "_family"
TYPE_ROW, ORDER_ROW, DATA_ROW = "ColumnType", "ColumnOrder", "Row"
PROFILES = ("v1", "v1_optional", "v2")
KEY_V2 = "test"
# Column of a cell store that tells later writes from earlier ones.
VERSION = "write_version"


def cell_rows(decoded: DataFrame, profile: str = "v1", *, compat: bool = False) -> DataFrame:
    """Wide rows of a cell profile: one per packet and measurement, with its key and
    family in front. Columns of `decoded` that no profile names are dropped, except
    `_row` and `_rows` set by `number_rows`.

    compat  leave the packet time out of the first-revision cells.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    rows = fan_out(decoded, ordinal=True)
    numbers = [F.col(c) for c in ("_row", "_rows") if c in decoded.columns]
    family = F.col("measurement").alias(FAMILY)
    if profile == "v2":
        content = select_present(rows, S.CELL_COLUMNS_V2).columns
        return rows.select(
            F.lit(KEY_V2).alias(KEY), family, "measurement_no", *numbers, *content
        )
    time = {} if compat else {"timestamp": F.col("spw_ts_usec")}
    head = details_v1() if profile == "v1_optional" else {"confid": F.lit(S.CONFIGURATION_ID)}
    columns = {
        **time,
        **head,
        "eng": F.col("value"),
        "dec": F.col("value"),
        "raw_packet_data": F.col("raw_packet_data"),
        "unit": F.col("unit"),
    }
    return rows.select(
        F.col("measurement").alias(KEY),
        family,
        "measurement_no",
        *numbers,
        *(column.alias(name) for name, column in columns.items()),
    )


def content_columns(rows: DataFrame) -> list[str]:
    """Data columns of a wide row frame, in order."""
    fixed = {KEY, FAMILY, "measurement_no", "_row", "_rows", "row_key"}
    return [name for name in rows.columns if name not in fixed]


def number_rows(
    decoded: DataFrame,
    order: list[str],
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """Give packets their place (`_row`) and count (`_rows`) in the order of `order`."""
    return dense_row_id(
        decoded, order, name="_row", total="_rows", rows_per_slice=rows_per_slice, stored=stored
    )


def profile_inputs(profile: str) -> set[str]:
    """Decoded columns that the cells of a profile are made from."""
    measured = {column for _, column, _ in S.MEASUREMENTS}
    if profile == "v2":
        return measured | set(S.CELL_COLUMNS_V2)
    details = {"local_timestamp", "ccsds_apid", "spw_port_name", "ccsds_service_type", "ccsds_service_subtype", "type"}
    return measured | {"spw_ts_usec", "raw_packet_data"} | (details if profile == "v1_optional" else set())


def numbered_cell_rows(
    decoded: DataFrame,
    order: list[str],
    profile: str = "v1",
    *,
    compat: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """Wide rows of a profile with the packets' places. Only columns that the profile uses are put in order; `stored` as
    in `slices.slice_by`."""
    wanted = profile_inputs(profile) | set(order)
    narrow = decoded.select(*(c for c in decoded.columns if c in wanted))
    numbered = number_rows(narrow, order, rows_per_slice=rows_per_slice, stored=stored)
    return cell_rows(numbered, profile, compat=compat)


def sequential_keys(rows: DataFrame, *, start: int | Column = 0, width: int = 0) -> DataFrame:
    """Row keys `<key>.Row<n>` with one counter that runs through the measurements:
    all packets of the first measurement, then all of the second, and so on."""
    start = F.lit(start) if isinstance(start, int) else start
    number = start + F.col("measurement_no") * F.col("_rows") + F.col("_row")
    return rows.withColumn("row_key", _keyed(number, width))


def index_keys(rows: DataFrame, index: str) -> DataFrame:
    """Row keys `<key>.Row<value of the index column>`."""
    return rows.withColumn("row_key", _keyed(F.col(index), 0))


def _keyed(suffix: Column, width: int) -> Column:
    return F.concat(F.col(KEY), row_key("", suffix, width))


def melt(
    rows: DataFrame,
    columns: list[str] | None = None,
    *,
    family: Column | str = FAMILY,
    python_booleans: bool = False,
) -> DataFrame:
    """Wide rows with a `row_key` -> one cell per non-null column."""
    columns = content_columns(rows) if columns is None else columns
    types = dict(rows.dtypes)
    family = F.col(family) if isinstance(family, str) else family
    texts = rows.select(
        "row_key",
        family.alias("family"),
        *(
            cell_text(F.col(c), types[c], python_booleans=python_booleans).alias(c)
            for c in columns
        ),
    )
    return texts.unpivot(["row_key", "family"], columns, "qualifier", "value").where(
        F.col("value").isNotNull()
    )


def packet_cells(
    decoded: DataFrame,
    order: list[str],
    profile: str = "v1",
    *,
    start: int = 0,
    width: int = 0,
    compat: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    stored: bool = False,
) -> DataFrame:
    """Decoded packets -> numbered cells of a profile."""
    rows = numbered_cell_rows(
        decoded, order, profile, compat=compat, rows_per_slice=rows_per_slice, stored=stored
    )
    return melt(sequential_keys(rows, start=start, width=width), python_booleans=compat)


def catalog(
    spark: SparkSession,
    columns: list[tuple[str, str]],
    key: str,
    family: str,
    *,
    compat: bool = False,
) -> DataFrame:
    """Catalogue cells of one key and family: a type row and an order row. `columns`
    are (name, Spark type) pairs in order.

    compat  the historical type names: every whole number is `int64`.
    """

    def type_name(kind: str) -> str:
        if compat and kind in ("tinyint", "smallint", "int"):
            kind = "bigint"
        return "bytes" if kind == "binary" else dtype_name(kind)

    rows = [(f"{key}.{TYPE_ROW}", family, name, type_name(kind)) for name, kind in columns]
    rows += [
        (f"{key}.{ORDER_ROW}", family, str(place), name)
        for place, (name, _) in enumerate(columns)
    ]
    return spark.createDataFrame(rows, S.CELL_SCHEMA)


def profile_catalog(rows: DataFrame, profile: str = "v1", *, compat: bool = False) -> DataFrame:
    """Catalogue of a profile's wide row frame for every measurement's key and family."""
    kinds = dict(rows.dtypes)
    columns = [(name, kinds[name]) for name in content_columns(rows)]
    parts = [
        catalog(
            rows.sparkSession, columns, KEY_V2 if profile == "v2" else name, name, compat=compat
        )
        for name, _, _ in S.MEASUREMENTS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def catalog_columns(catalog_cells: DataFrame, key: str, family: str) -> list[tuple[str, str]]:
    """(column, dtype) in catalogue order. A catalogue has one entry per column."""
    entries = catalog_cells.where(
        (F.col("family") == family)
        & F.col("row_key").isin(f"{key}.{TYPE_ROW}", f"{key}.{ORDER_ROW}")
    ).collect()
    types = {e.qualifier: e.value for e in entries if e.row_key.endswith(TYPE_ROW)}
    order = {int(e.qualifier): e.value for e in entries if e.row_key.endswith(ORDER_ROW)}
    return [(order[place], types[order[place]]) for place in sorted(order)]


def range_scan(
    cells: DataFrame,
    start: str | None = None,
    stop: str | None = None,
    family: str | None = None,
) -> DataFrame:
    """Cells with start <= row_key < stop of one family. The bounds are plain
    comparisons, so a stored table skips files and row groups by their key range."""
    if start is not None:
        cells = cells.where(F.col("row_key") >= start)
    if stop is not None:
        cells = cells.where(F.col("row_key") < stop)
    if family is not None:
        cells = cells.where(F.col("family") == family)
    return cells


def get_row(cells: DataFrame, key: str, family: str | None = None) -> DataFrame:
    """All cells of one row."""
    row = cells.where(F.col("row_key") == key)
    return row if family is None else row.where(F.col("family") == family)


def data_rows(cells: DataFrame, key: str, family: str | None = None) -> DataFrame:
    """Cells of a key's data rows, without its catalogue rows."""
    prefix = f"{key}.{DATA_ROW}"
    return range_scan(cells, prefix, prefix[:-1] + chr(ord(prefix[-1]) + 1), family)


def key_ordered(cells: DataFrame) -> DataFrame:
    """Cells in key order. Keys compare as text: `Row10` comes before `Row2`."""
    return cells.orderBy("row_key", "family", "qualifier")


def restore(
    cells: DataFrame,
    columns: list[tuple[str, str]],
    key: str,
    family: str,
    *,
    version: str | None = None,
) -> DataFrame:
    """Cells of one key and family -> typed wide rows in catalogue order. When a cell
    was written more than once the newest write wins: the largest value of the column `version`, by
    default the write version that the store keeps; of equal ones the largest value."""
    names = [name for name, _ in columns]
    version = version or next((c for c in (VERSION, "batch_id") if c in cells.columns), None)
    kept = data_rows(cells, key, family)
    cell = F.struct("qualifier", *([] if version is None else [F.col(version).alias("version")]), "value")
    # Cells of a row lie together in a store, so a row is put together before it moves, and moves as one.
    rows = kept.groupBy("row_key").agg(F.collect_list(cell).alias("cells"))
    all_cells = F.col("cells")
    once = F.size(F.array_distinct(F.array_compact(all_cells["qualifier"]))) == F.size(all_cells)
    # In order of column, version and value the last cell of a column is its newest.
    last = F.filter(
        F.col("sorted"),
        lambda c, i: c["qualifier"].isNotNull() & ~F.get(F.col("sorted"), i + 1)["qualifier"].eqNullSafe(c["qualifier"]),
    )
    rows = rows.select("row_key", "cells", F.when(~once, F.sort_array(all_cells)).alias("sorted"))
    rows = rows.select("row_key", F.coalesce(last, all_cells).alias("cells"))
    newest = F.map_from_arrays(all_cells["qualifier"], all_cells["value"])
    wide = rows.select("row_key", newest.alias("cells"))
    return wide.select(
        "row_key", *(typed_cell(F.col("cells")[name], dtype).alias(name) for name, dtype in columns)
    )
