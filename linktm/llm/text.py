"""Column helpers on document texts: words, lines, keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six ASCII white-space characters; every other character is part of a word.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rows_of(docs: DataFrame, *columns: str) -> DataFrame:
    """`id`, `text` (null as empty), `version` and the named columns, nothing else, so that other
    columns of the table cannot clash with a name used here. (`id`, `version`) tells
    documents apart: rows that repeat an id with another text are documents of their own, and
    rows that repeat both get the same results."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("id"),
        text.alias("text"),
        F.xxhash64(text).alias("version"),
        *columns,
    )


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (`id`, `version`), null ids included."""
    return left["id"].eqNullSafe(right["id"]) & (left["version"] == right["version"])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` says the same of pure ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_RUN), lambda w: w != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)
