"""Lines that many documents share: which lines each document keeps.

Line keys are hashed, ranged over the partitions by (key, document) and sorted by document and
position behind the key, so that a partition reads each key's documents as one run: the run gives
the first occurrence and the positions in one pass, and a key that fills many partitions is cut
between documents. What leaves a document is a compressed bitmap of dropped lines, never text.

Nulls: a null text is one empty line; a null id is an id like any other. Repeated rows: rows equal
in id and text count as one document and get the same result. Empty table: no rows. Keys shorter
than `min_code_points` are never dropped, so empty lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm.llm.skew import join_counted
from linktm.llm.text import WHITE, ascii_lower, lines, rows_of, same_row
from linktm.scratch import materialize

MIN_DOCS = 10
MIN_CODE_POINTS = 1
_KEY = ("h1", "h2")


def line_runs(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """A row per line key and document: `h1`, `h2`, `id`, `version`, `positions` (ascending). The
    key is a 128-bit hash of the stripped, lower-cased line."""
    each = rows_of(docs).select("id", "version", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(WHITE)))
    keyed = each.select("id", "version", "pos", key.alias("key")).where(
        F.char_length("key") >= min_code_points
    )
    hashed = keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "version", "pos"
    )
    ranged = hashed.repartitionByRange(*_KEY, "id", "version").sortWithinPartitions(
        *_KEY, "id", "version", "pos"
    )
    return ranged.groupBy(*_KEY, "id", "version").agg(
        F.array_sort(F.collect_set("pos")).alias("positions")
    )


def key_counts(runs: DataFrame) -> DataFrame:
    """Per key: the number of documents and the first occurrence."""
    return runs.groupBy(*_KEY).agg(
        F.count("*").alias("n_docs"),
        F.min(F.struct("id", "version", F.col("positions")[0].alias("pos"))).alias("first"),
    )


def dropped_bitmaps(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_code_points: int = MIN_CODE_POINTS,
    keep_first: bool = False,
) -> DataFrame:
    """`id`, `version` and `dropped`, the bitmap of lines to drop, for documents that lose any:
    (word number, 64 bits) in ascending order, words without a bit left out. With `keep_first` the first
    occurrence of a line, in the document with the smallest id, stays."""
    runs = materialize(line_runs(docs, min_code_points), "line-runs")
    common = materialize(
        key_counts(runs)
        .where(F.col("n_docs") >= min_docs)
        .select(*_KEY, "first", F.col("n_docs").alias("rows_here")),
        "common-lines",
    )
    met = join_counted(runs, common, list(_KEY), runs.count())
    gone = F.col("positions")
    if keep_first:
        is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("version") == F.col("first.version"))
        gone = F.when(is_first, F.slice(gone, 2, F.size(gone) - 1)).otherwise(gone)
    lost = met.select("id", "version", F.explode(gone).alias("pos"))
    bits = lost.groupBy("id", "version", F.expr("pos div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return bits.groupBy("id", "version").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped")
    )


def bitmap_positions(bitmap: Column) -> Column:
    """Ascending positions of the bits set in a compressed bitmap."""
    return F.flatten(
        F.transform(
            bitmap,
            lambda w: F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.lit(63)),
                    lambda b: F.call_function("getbit", w["bits"], b) == 1,
                ),
                lambda b: (w["word"] * 64 + b).cast("int"),
            ),
        )
    )


def dedup_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_code_points: int = MIN_CODE_POINTS,
    keep_first: bool = False,
) -> DataFrame:
    """Every row of `docs` as `row` (all its columns), with `n_lines`, `n_dropped`, `dropped` (the
    bitmap, null when nothing goes) and `kept_text`. A document without lines left has an empty text."""
    rows = rows_of(docs, F.struct("*").alias("row"))
    bitmaps = dropped_bitmaps(docs, min_docs, min_code_points, keep_first)
    joined = rows.join(bitmaps, same_row(rows, bitmaps), "left").select(
        "row", "text", "dropped", lines(F.col("text")).alias("lines")
    )
    gone = joined.select(
        "row",
        "text",
        "dropped",
        "lines",
        F.size("lines").alias("n_lines"),
        F.coalesce(bitmap_positions(F.col("dropped")), F.array().cast("array<int>")).alias("gone"),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("gone"))
    kept_lines = F.transform(kept, lambda i: F.get(F.col("lines"), i))
    return gone.select(
        "row",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        "dropped",
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(kept_lines, "\n"))
        .alias("kept_text"),
    )
