"""Parallel reading of capture files of any size.

Packet starts are known only by following the lengths from the start of the file, so
a file cannot simply be cut. Instead every chunk guesses a packet and frames
from there; each guess is an entry whose exit from the chunk is then known. Every chunk
is also framed from the exit of the one before, up to its guess as a rule, and each
file's entries and exits are chained from its start. Where a chain needs an entry that was not framed, it goes on
from there, by STRIDE chunks a round at most and up to the next guess that holds. The rows equal one sequential scan,
whatever the guesses were, and the work grows with the file alone: every chunk is framed from its guess, from one more entry before
the chains are made, and from those that a broken chain needs, all of which lie on the chain itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linktm.scratch import full_uri, materialize
from linktm.sources.capture import (
    GLOBAL_HEADER,
    RANGE_SCHEMA,
    SCHEMA,
    SPLIT,
    bridge_ranges,
    follow_file,
    frame_ranges,
    probe_ranges,
)

MAX_CHUNK = 128 << 20
MIN_CHUNK = 64 << 10
# Chunks that a task may frame in a row where a file's chain broke off.
STRIDE = 64


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of a capture file or of the files below a folder, listed by Spark; hidden ones are left out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select("path", F.col("length").alias("size"))


def chunk_size(spark: SparkSession, sizes: list[int]) -> int:
    """Chunks small enough to give every core several, within fixed bounds."""
    share = sum(sizes) // (4 * spark.sparkContext.defaultParallelism)
    return min(MAX_CHUNK, max(MIN_CHUNK, share))


def _spread(frame: DataFrame, rows: int, total: int) -> DataFrame:
    """Rows that stand for chunks of files dealt out to tasks: one a task, or several where chunks are finer than SPLIT
    bytes, so the driver keeps track of a number of tasks that follows the `total` bytes and not the chunks."""
    least = 4 * frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(max(1, min(rows, max(least, -(-total // SPLIT)))))


def _bridged(entries: DataFrame, guessed: DataFrame, chunks: int, masked: Column, total: int) -> DataFrame:
    """Chunks framed from `entries` (path, from_chunk, entry), each on through `chunks` chunks at most, stored."""
    here = F.col("chunk").between(F.col("from_chunk"), F.col("from_chunk") + chunks - 1)
    guesses = guessed.withColumnRenamed("entry", "guess")
    given = F.array_sort(F.collect_list(F.struct("chunk", "stop", "guess", "records", "following")))
    near = guesses.join(entries, "path").where(here)
    if chunks == 1:
        near = guesses.join(entries.withColumn("chunk", F.col("from_chunk")), ["path", "chunk"])
    wanted = near.groupBy("path", "from_chunk", "entry").agg(given.alias("chunks"))
    wanted = _spread(wanted.withColumn("masked", masked), entries.count(), total)
    return materialize(wanted.mapInArrow(bridge_ranges, RANGE_SCHEMA), "capture-bridges")


def capture_index(
    spark: SparkSession, path: str, *, chunk_bytes: int | None = None, compat: bool = False
) -> DataFrame:
    """(path, chunk, entry, stop, first, records): exact record ranges of every file."""
    files = materialize(list_captures(spark, full_uri(spark, path)), "capture-files")
    total = files.agg(F.sum("size")).first()[0] or 0
    chunk_bytes = chunk_bytes or chunk_size(spark, [total])
    masked = F.lit(not compat).alias("masked")
    chunks = files.where(F.col("size") > GLOBAL_HEADER).select(
        "path",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / chunk_bytes))).alias("chunk"),
        "size",
    )
    planned = chunks.select(
        "path",
        "chunk",
        (F.col("chunk") * chunk_bytes).alias("start"),
        F.least((F.col("chunk") + 1) * chunk_bytes, "size").alias("stop"),
        F.when(F.col("chunk") == 0, F.lit(GLOBAL_HEADER)).cast("bigint").alias("entry"),
        masked,
    )
    guessed = materialize(
        _spread(planned, planned.count(), total).mapInArrow(probe_ranges, RANGE_SCHEMA), "capture-index"
    )
    # One row per chunk: a file's chunks are few, whatever its size.
    in_file = Window.partitionBy("path").orderBy("chunk")
    entries = guessed.select("path", "chunk", F.lag("following").over(in_file).alias("entry"), "stop", F.col("entry").alias("guess"))
    unmet = entries.where(F.col("entry").isNotNull() & ~F.col("entry").eqNullSafe(F.col("guess")) & (F.col("entry") < F.col("stop")))
    unmet = unmet.select("path", F.col("chunk").alias("from_chunk"), "entry")
    framed = guessed.unionByName(_bridged(unmet, guessed, 1, masked, total))
    while True:
        chains = materialize(framed.groupBy("path").applyInArrow(follow_file, RANGE_SCHEMA), "capture-chains")
        missing = chains.where(F.col("records").isNull()).select("path", F.col("chunk").alias("from_chunk"), "entry")
        if not missing.limit(1).count():
            break
        framed = framed.unionByName(_bridged(missing, guessed, STRIDE, masked, total))
    ranges = chains
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(
        "path",
        "chunk",
        "entry",
        "stop",
        F.coalesce(F.sum("records").over(before), F.lit(0)).cast("bigint").alias("first"),
        "records",
        masked,
    )


def read_captures(
    spark: SparkSession,
    path: str,
    *,
    chunk_bytes: int | None = None,
    compat: bool = False,
    first: int | None = None,
) -> DataFrame:
    """Packets of a capture file or folder: (path, record_no, byte_offset, value). The
    rows of `read_whole_files`, with large files read by many tasks. `first` reads that many packets of each
    file and no chunk behind them. A join with the packets is a merge join unless the other side bears a hint of its own:
    Spark would take the packets for as small as the table of ranges that they are read from, and send all to the driver."""
    index = materialize(
        capture_index(spark, path, chunk_bytes=chunk_bytes, compat=compat), "capture-ranges"
    )
    ranges = index.where(F.col("records") > 0)
    if first is not None:
        ranges = ranges.where(F.col("first") < first)
    bounded = ranges.withColumn("before", F.lit(first).cast("bigint"))
    # No range reaches further than its chunk, but for its last packet.
    sizes = bounded.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.greatest(F.col("stop") - F.col("entry"), F.lit(0))).alias("total")).first()
    packets = _spread(bounded, sizes.rows, sizes.total or 0).mapInArrow(frame_ranges, SCHEMA)
    return packets.hint("merge")
