"""Quality rules: repetition and symbol counts of each document, and lines that a host repeats.

A line that many different texts of one host carry is boilerplate. Lines are normalised and hashed,
the different texts per host and line are counted, lines above the limit are removed, and a
document that keeps too few of its words is rejected. The limit is a number of texts, whatever the size
of the host. Exact copies of a document count once, so a text copied a thousand times is left to the
deduplication and is no boilerplate.

Nulls: a null text has no words and fails; a null host is a host of its own. Repeated rows are
counted once and get the same result. Empty table: no rows. Window and line hashes have 64 and 128
bits; two windows of one text are taken as equal when their hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm.llm.skew import join_counted
from linktm.llm.text import WHITE, WHITE_RUN, WORD, ascii_lower, lines, rows_of, words
from linktm.scratch import materialize

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

# A line is boilerplate when more different texts of its host carry it.
LINE_TEXTS = 20
# A document is depleted when less than this percentage of its words is left.
MIN_LEFT_PERCENT = 30


def _covered(positions: Column) -> Column:
    """Words in windows that start at the ascending `positions`."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        positions,
        start,
        lambda acc, p: F.struct(
            (acc["n"] + WINDOW - F.greatest(F.lit(0), acc["end"] - p)).alias("n"),
            (p + WINDOW).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def base_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """`id`, `text`, `version`, the named columns, `n_words`, `word_chars`, `n_symbols`,
    `n_dup_lines`, `n_repeat_words`, `base_failed`; a row per row of `docs`."""
    text = F.col("text")
    rows = rows_of(docs, *columns)
    kept = [F.col(c) for c in rows.columns]
    split = rows.select(
        *kept,
        words(text).alias("words"),
        F.filter(lines(text), lambda x: x.rlike(WORD)).alias("lines"),
    )
    n_windows = F.size("words") - (WINDOW - 1)
    hashed = split.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n_windows > 1,
            F.transform(
                F.sequence(F.lit(1), n_windows),
                lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # Sorted by hash, equal windows are neighbours; texts without any skip the sort.
    ordered = hashed.select(
        *kept,
        *counts,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(
                F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("windows"),
    )
    n = F.size("windows")
    before = F.concat(
        F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("windows", 1, n - 1)
    )
    after = F.concat(F.slice("windows", 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    equal = F.zip_with(
        F.zip_with(
            "windows",
            before,
            lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), a["h"].eqNullSafe(b["h"]).alias("d")),
        ),
        after,
        lambda a, b: F.when(a["d"] | a["h"].eqNullSafe(b["h"]), a["i"]),
    )
    repeated = F.when(n == 0, F.lit(0)).otherwise(
        _covered(F.sort_array(F.filter(equal, lambda i: i.isNotNull())))
    )
    counted = ordered.select(*kept, *counts, repeated.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def text_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row per different line of each different text of a host: `host`, `version`, `h1`, `h2` (a hash of host and
    line) and `n_words` (of all its occurrences, in all copies of the text). Lines without a word have none."""
    each = rows_of(docs, F.col(host).alias("host")).select(
        "version", "host", F.explode(lines(F.col("text"))).alias("line")
    )
    key = F.regexp_replace(ascii_lower(F.btrim("line", F.lit(WHITE))), WHITE_RUN, " ")
    keyed = each.select("version", "host", key.alias("key")).where(F.col("key") != "")
    n_words = F.char_length("key") - F.char_length(F.replace("key", F.lit(" "), F.lit(""))) + 1
    # A null host is told from every text.
    of_host = (F.col("host").isNull(), F.col("host"))
    hashed = keyed.select(
        "host",
        "version",
        F.xxhash64(*of_host, "key").alias("h1"),
        F.xxhash64(F.lit(1), *of_host, "key").alias("h2"),
        n_words.alias("n_words"),
    )
    return hashed.groupBy("host", "h1", "h2", "version").agg(F.sum("n_words").alias("n_words"))


def boilerplate(per_text: DataFrame, line_texts: int = LINE_TEXTS) -> DataFrame:
    """`h1`, `h2`, `n_texts` of the lines of `text_lines` that more than `line_texts` texts of their host carry."""
    per_line = per_text.groupBy("h1", "h2").agg(F.count("*").alias("n_texts"))
    return per_line.where(F.col("n_texts") > line_texts)


def lost_words(per_text: DataFrame, removed: DataFrame) -> DataFrame:
    """`host`, `version`, `lost`, `total`: words in removed lines and in all lines, for the texts
    that lose any. Copies of a text count in both, so only their quotient means something. A line that very many texts
    carry is sent to the tasks and moves no row; what is shuffled besides the lines met is a sum per text."""
    met = join_counted(
        per_text, removed.withColumnRenamed("n_texts", "rows_here"), ["h1", "h2"], per_text.count()
    )
    lost = met.groupBy("host", "version").agg(F.sum("n_words").alias("lost")).alias("l")
    totals = per_text.groupBy("host", "version").agg(F.sum("n_words").alias("total")).alias("t")
    same = (F.col("l.version") == F.col("t.version")) & F.col("l.host").eqNullSafe(F.col("t.host"))
    return lost.join(totals, same).select("l.host", "l.version", "lost", "total")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    line_texts: int = LINE_TEXTS,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """A row per row of `docs`: `doc_id`, the base counts, `base_failed`, `n_boilerplate_words`
    (in lines above the limit) and `kept`."""
    per_text = materialize(text_lines(docs, host), "text-lines")
    removed = materialize(boilerplate(per_text, line_texts), "boilerplate")
    lost = lost_words(per_text, removed).alias("p")
    counted = base_counts(docs, F.col(host).alias("host")).drop("text").alias("c")
    joined = counted.join(
        lost,
        (F.col("c.version") == F.col("p.version")) & F.col("c.host").eqNullSafe(F.col("p.host")),
        "left",
    )
    gone = F.coalesce(F.expr("n_words * lost div total"), F.lit(0))
    depleted = 100 * (F.col("n_words") - gone) < min_left_percent * F.col("n_words")
    return joined.select(
        F.col("c.id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        gone.cast("long").alias("n_boilerplate_words"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )
