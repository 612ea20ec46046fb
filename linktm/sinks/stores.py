"""Writers of points, cells, catalogues, archives, topics and text lines.

A write with a `batch_id` owns the folder `batch_id=<n>` and replaces it, so that
replaying a micro-batch leaves the store as it was. Without one it appends.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linktm.functions.values import json_line
from linktm.operators.cells import FAMILY, VERSION
from linktm.operators.points import with_tags
from linktm.sources.messages import TOPIC

# Key of the column metadata that marks a tag.
TAG = "tag"


def _save(frame: DataFrame, path: str, by: list[str], batch_id: int | None) -> None:
    target, mode = (path, "append") if batch_id is None else (f"{path}/batch_id={batch_id}", "overwrite")
    frame.write.mode(mode).partitionBy(*by).parquet(target)


def write_points(
    points: DataFrame,
    path: str,
    *,
    tags: dict[str, object] | None = None,
    tag_columns: tuple[str, ...] = (),
    batch_id: int | None = None,
) -> None:
    """Points in one folder per measurement, in time order inside each file so that a
    time filter skips row groups. `tags` are constants added to every point. These and `tag_columns` are stored as
    strings and marked as tags in the schema; all other columns are fields."""
    if tags:
        points = with_tags(points, tags)
    for name in (*tag_columns, *(tags or ())):
        if name in points.columns:
            points = points.withColumn(name, F.col(name).cast("string")).withMetadata(name, {TAG: True})
    _save(points.sortWithinPartitions("measurement", "time"), path, ["measurement"], batch_id)


def write_cells(
    cells: DataFrame,
    path: str,
    *,
    batch_id: int | None = None,
    version: int | None = None,
    observed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    melted: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Cells in one folder per family. A file holds one range of row keys, in order, and the ranges of a
    family's files do not overlap, so a range of keys opens only the files it needs. Every cell bears the `version` of its write, by default
    the batch's number or else the time in microseconds: where a cell was written twice, the larger one holds. `observed` is
    applied to the rows as they are written; what comes before is also run to place the ranges. With `melted`, `cells` are wide
    rows with their `row_key`, which are ranged and moved as such; `melted` makes cells of them in the task that writes them."""
    if version is None:
        version = time.time_ns() // 1000 if batch_id is None else batch_id
    if melted is not None:
        # Wide rows in order leave next to nothing to do for the sort of the cells below.
        cells = melted(cells.repartitionByRange(FAMILY, "row_key").sortWithinPartitions(FAMILY, "row_key"))
    else:
        cells = cells.repartitionByRange("family", "row_key")
    ordered = cells.withColumn(VERSION, F.lit(version).cast("bigint")).sortWithinPartitions("family", "row_key")
    _save(observed(ordered), path, ["family"], batch_id)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Catalogue rows, one small file per row; rows that exist are replaced."""
    # A catalogue has two rows per key and family: one task writes it.
    catalog.coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("family", "row_key").parquet(path)


def write_archive(packets: DataFrame, path: str, *, batch_id: int | None = None) -> None:
    """Raw (key, value) segments. Segments are never changed: more data is more files."""
    _save(packets.select("key", "value"), path, [], batch_id)


def write_topic(
    packets: DataFrame,
    fmt: str = "kafka",
    *,
    path: str | None = None,
    topic: str = TOPIC,
    **options: str,
) -> None:
    """Send packet values, unkeyed; missing packets are skipped."""
    values = packets.where(F.col("value").isNotNull()).select("value")
    writer = values.write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", topic).save()
    else:
        writer.mode("append").save(path)


def write_json_lines(frame: DataFrame, path: str) -> None:
    """One JSON document per row, as text part files."""
    frame.select(json_line(*frame.columns).alias("value")).write.text(path)


def write_text_lines(documents: DataFrame, path: str, column: str = "document") -> None:
    """One line per document, as text part files."""
    documents.select(F.col(column).alias("value")).write.text(path)
