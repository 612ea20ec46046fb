"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letters.

A word's letters are a multiset, that is a binary vector over (letter, which of its occurrences). One
inserted or deleted letter moves that vector by a Hamming distance of one, a replaced letter by two. The
letters are dealt over PARTS parts; two vectors within LIMIT agree on all of at least PARTS - LIMIT parts,
so each choice of that many parts, with the letters that a word has in them, is a signature, and near words
share one exactly. A lone edit also leaves two thirds of a word in place, so a signature takes the
letters of one third and bears the other two as they are: near words still share one (with the third that
holds the edit), and anagrams no longer do. Words are equi-joined by signature and verified.

Words are counted in the tasks before anything moves. A word's form is its near word of the largest
count, at least RATIO times its own; roots follow forms by doubling the way each round, as
written tables. Counts at least double on the way, so chains are short and have no cycle.

Nulls: a null text has no words, a null id is the empty string in the hash. Repeated rows count again. Ties
between near words go to the smaller word in code-point order. Texts are read whole, whatever their length,
one at a time. Empty table: no rows. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm.scratch import materialize

PARTS = 3
LIMIT = 2
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
MARK = 97
# Entries of a task's table of counts before it is handed on.
TABLE = 400_000

# In Latin-1 every letter of a run is one byte; all other bytes are blanks, and only A-Z are lower-cased.
_LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
_RUNS = bytes(
    c if c in _LETTERS else c + 32 if ord("A") <= c <= ord("Z") else 32 for c in range(256)
)


def marked(run: bytes, seed: int) -> bytes:
    """The word that a run (Latin-1) of the document with this CRC-32 seed stands for."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % MARK:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """`word`, `n` for every word of all texts, the empty one left out."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in found], pa.string())
            rows = pa.record_batch([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return rows

        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text")):
                runs = Counter(text.as_py().encode("latin-1", "replace").translate(_RUNS).split())
                seed = zlib.crc32(f"{name.as_py()}:".encode())
                for run, n in runs.items():
                    found[marked(run, seed)] += n
                if len(found) >= TABLE:
                    yield flush()
        if found:
            yield flush()

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    texts = docs.where(F.col("text").isNotNull()).select(name, "text")
    part = texts.mapInArrow(count, "word string, n long")
    return part.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _signatures(words: DataFrame, longer: int) -> DataFrame:
    """`key`, `word`, `n` of every signature that a word shares with near words of its length and above
    (`longer` = 0), or of the length below (1)."""
    size = F.char_length("word") - longer
    first = F.floor(size / 3).cast("int")
    second = size - first

    def cut(start: Column, length: Column) -> Column:
        return F.substring(F.col("word"), start + 1, length)

    # The two thirds that stay, and the third that holds the edit.
    ways = [
        (cut(first + longer, size - first), cut(F.lit(0), first + longer)),
        (F.concat_ws(" ", cut(F.lit(0), first), cut(second + longer, first)), cut(first, second - first + longer)),
        (cut(F.lit(0), second), cut(second, first + longer)),
    ]
    thirds = words.where(size >= LEAST_LENGTH).select(
        "word",
        "n",
        size.alias("size"),
        *[keep.alias(f"keep{w}") for w, (keep, _) in enumerate(ways)],
        *[F.array_join(F.array_sort(F.split(rest, "")), "").alias(f"rest{w}") for w, (_, rest) in enumerate(ways)],
    )
    keys = []
    for way in range(len(ways)):
        for number, parts in enumerate(combinations(range(PARTS), PARTS - LIMIT)):
            others = "".join(chr(c) for c in _LETTERS if c % PARTS not in parts)
            letters = F.translate(F.col(f"rest{way}"), others, "")
            keys.append(F.xxhash64("size", F.lit(way), F.lit(number), f"keep{way}", letters))
    return thirds.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """`word`, `near`, `near_n`: both directions of every pair of `words` (word, n; each word once)
    that differ by one inserted, deleted or replaced character."""
    same = _signatures(words, 0)
    below = _signatures(words, 1)
    left = same.toDF("key", "word", "n")
    right = same.withColumn("longer", F.lit(False)).union(below.withColumn("longer", F.lit(True)))
    right = right.toDF("key", "near", "near_n", "longer")
    pairs = (
        left.join(right, "key")
        .where(F.col("longer") | (F.col("word") < F.col("near")))
        .where(F.levenshtein("word", "near", 1) == 1)
        .select("word", "n", "near", "near_n")
    )
    ways = pairs.select(
        F.explode(
            F.array(
                F.struct("word", "near", "near_n"),
                F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
            )
        ).alias("way")
    )
    # Dealt by word alone: the next count by word needs no further shuffle.
    return ways.select("way.*").repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` for every row of `forms` (word, form; form is never null and differs from word)."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(
            steps.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
        if not steps.where("moved").limit(1).count():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` of every word of all texts with at least LEAST_LENGTH
    characters and LEAST_COUNT occurrences."""
    enough = (F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)
    words = materialize(word_counts(docs).where(enough), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= RATIO * F.col("n")
    table = materialize(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(table.where(F.col("form").isNotNull()))
    return table.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
