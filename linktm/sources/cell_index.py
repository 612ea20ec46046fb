"""Point gets on a cell store: the files that can hold a key are known before any of them is opened.

The index of a store has one row per file with its range of row keys, and a Bloom filter of the file's
different keys, kept as the 64-bit words that have a bit set. Both are much smaller than the cells. A file the index
does not know yet is a candidate for every key, and one that is gone is never opened, so a get is right
whatever was written, merged or retired since the index was.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm.scratch import materialize
from linktm.sources.stores import read_cells

# About 1 in 2,000 keys of a file's range that are absent opens the file in vain.
BITS_PER_KEY = 16
HASHES = 8
_SPANS = "file string, low string, high string, words bigint"
_FILTERS = "file string, word bigint, bits bigint"


def _positions(key: Column, words: Column) -> Column:
    """The bits of a key in a filter of `words` words, from two hashes."""
    one, two = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    # The low halves alone: sums of whole hashes would leave the range of a long.
    low = F.lit(0xFFFFFFFF)
    return F.transform(
        F.sequence(F.lit(0), F.lit(HASHES - 1)),
        lambda i: (one.bitwiseAND(low) + i * two.bitwiseAND(low)) % (words * 64),
    )


def _bits(keys: DataFrame) -> DataFrame:
    """`word` and `bit` of every key of `keys` (row_key, words, ...) in its file's filter."""
    at = keys.withColumn("at", F.explode(_positions(F.col("row_key"), F.col("words"))))
    return at.withColumns({"word": F.floor(F.col("at") / 64), "bit": (F.col("at") % 64).cast("int")}).drop("at", "words")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of a store's data files, as Spark lists them to plan any scan."""
    return read_cells(spark, path).inputFiles()


def _unknown(spark: SparkSession, files: list[str], index: str) -> list[str]:
    listed = spark.createDataFrame([(f,) for f in files], "file string")
    known = _stored(spark, f"{index}/spans", _SPANS)
    return [r.file for r in listed.join(known, "file", "left_anti").collect()]


def _read_files(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    """Cells of some files of a store; of none, no rows and no file opened."""
    whole = read_cells(spark, path)
    if not files:
        return whole.where(F.lit(False))
    # Names are listed as URIs.
    names = [unquote(f) for f in files]
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*names)


def index_cells(spark: SparkSession, path: str, index: str) -> int:
    """Add the files of the store `path` that the index does not have; their number. What a run that broke off left
    is not used or used once more: a file is known when its range is, and that is written last."""
    new = _unknown(spark, _listed(spark, path), index)
    if not new:
        return 0
    cells = _read_files(spark, path, new)
    keys = materialize(cells.select(F.input_file_name().alias("file"), "row_key").distinct(), "file-keys")
    spans = keys.groupBy("file").agg(
        F.min("row_key").alias("low"),
        F.max("row_key").alias("high"),
        F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64).alias("words"),
    )
    spans = materialize(spans, "file-spans")
    bits = _bits(keys.join(spans.select("file", "words"), "file"))
    filters = bits.groupBy("file", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    filters.repartitionByRange("file", "word").sortWithinPartitions("file", "word").write.mode("append").parquet(
        f"{index}/filters"
    )
    # Files without a row have no span yet; they would be looked at again each time.
    listed = spark.createDataFrame([(f,) for f in new], "file string")
    listed.join(spans, "file", "left").select(
        "file", "low", "high", F.coalesce("words", F.lit(0)).cast("bigint").alias("words")
    ).coalesce(1).write.mode("append").parquet(f"{index}/spans")
    return len(new)


def files_of_keys(spark: SparkSession, path: str, index: str, keys: Sequence[str]) -> list[str]:
    """The store's files that can hold one of the keys: at most a few per key and family for files with
    separate key ranges, however many the store has. No data file is opened for it."""
    wanted = sorted(set(keys))
    listed = _listed(spark, path)
    if not wanted or not listed:
        return []
    unknown = _unknown(spark, listed, index)
    inside = F.filter(F.lit(wanted), lambda k: (k >= F.col("low")) & (k <= F.col("high")))
    spans = _stored(spark, f"{index}/spans", _SPANS).where(
        (F.col("high") >= wanted[0]) & (F.col("low") <= wanted[-1])
    )
    near = materialize(
        spans.select("file", "words", F.explode(inside).alias("row_key")).distinct(), "keys-in-ranges"
    )
    candidates = [r.file for r in near.select("file").distinct().collect()]
    if not candidates:
        return unknown
    # The filters lie in order of their files: this reads those of the candidates only.
    filters = _stored(spark, f"{index}/filters", _FILTERS).where(F.col("file").isin(candidates))
    hit = _bits(near).join(filters, ["file", "word"]).where(
        F.expr("(bits & shiftleft(1L, bit)) != 0")
    )
    # Two hashes of a key can fall on one bit, and a file can be in the index twice.
    asked = _bits(near).groupBy("file", "row_key").agg(F.count_distinct("word", "bit").alias("asked"))
    found = hit.groupBy("file", "row_key").agg(F.count_distinct("word", "bit").alias("found"))
    holding = asked.join(found, ["file", "row_key"]).where(F.col("asked") == F.col("found"))
    still = set(listed)
    return unknown + [r.file for r in holding.select("file").distinct().collect() if r.file in still]


def get_rows(
    spark: SparkSession, path: str, index: str, keys: Sequence[str], family: str | None = None
) -> DataFrame:
    """All cells of the rows `keys`, of one family or all. Absent keys have none; repeated ones count once."""
    cells = _read_files(spark, path, files_of_keys(spark, path, index, keys))
    rows = cells.where(F.col("row_key").isin(list(keys))) if keys else cells.where(F.lit(False))
    return rows if family is None else rows.where(F.col("family") == family)
