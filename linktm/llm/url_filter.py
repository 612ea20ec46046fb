"""URL filter: rules by host and path, and a model of the words in host and path for the rest.

Names such as `cheappills` are split into words by a unigram Viterbi over word counts of the pages
themselves; a multinomial naive Bayes then weighs the words. Nothing labels the pages, so the
model's training labels are a fixed list of seed words: a page whose host holds one of them as a
word counts as blocked, every other page as allowed, and the model carries that over to the words
which go along with them. Word counts, labels and model counts cover all pages.

Every word of the pages counts, however rare or long: the substrings of the different names are joined with
the whole table of word counts, and each name is split by its own words. Labels, counts and odds are joined
by word, by name and by row. What a task holds is bounded by one name's words, by CACHE while it counts
words, and by the hot keys of `skew`.

Nulls: a null url, or one without `://`, has an empty host and path and no words; the model then has
only its prior. A null html adds no words. Repeated rows count as often as they occur. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm.llm.skew import join_counted
from linktm.llm.text import ascii_lower
from linktm.scratch import materialize

# Host and path prefix, and what the rule says.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
# Words of hosts that stand for a blocked page when the model is trained.
SEEDS = (
    "ad ads adult bet bets bonus casino cheap gambling loan loans lottery pills poker porn sex "
    "spam track tracker viagra win xxx"
).split()
CACHE = 200_000
# Words up to this length are met as substrings of names.
SHORT = 32
# A seed is as likely as this share of all words at least, so that names are split at seeds.
SEED_SHARE = 1e-4
UNKNOWN = "?"
SMOOTHING = 0.1

_NAMES = r"[a-z]+"
_HTML_WORDS = re.compile(r"[A-Za-z]+")
_TAGS = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>|&\w+;", re.S)


def parsed(pages: DataFrame) -> DataFrame:
    """`page_id`, `host`, `path` of every row."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        ascii_lower(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule and its verdict as a struct, or null. The list of rules is part of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(
            path, F.lit(slash + prefix)
        )
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _flush(counts: Counter, schema: pa.Schema) -> pa.RecordBatch:
    batch = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema)
    counts.clear()
    return batch


def page_words(pages: DataFrame) -> DataFrame:
    """`word`, `n`: the ASCII words of all page texts, tags left out. Each task sums its own pages
    in a table of bounded size before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                text = _TAGS.sub(" ", html or "").lower()
                counts.update(w for w in _HTML_WORDS.findall(text) if len(w) >= 2)
                if len(counts) > CACHE:
                    yield _flush(counts, schema)
        yield _flush(counts, schema)

    return pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """`words` (word, n): all words of the pages and the seeds, with the sum and the least of `n` and the
    letters of the longest."""

    words: DataFrame
    whole: float
    least: float
    longest: int


def lexicon(pages: DataFrame) -> Lexicon:
    words = materialize(page_words(pages), "page-words")
    is_seed = F.col("word").isin(list(SEEDS))
    found = {r.word: r.n for r in words.where(is_seed).collect()}
    others = words.where(~is_seed)
    sums = others.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("n").alias("least"), F.max(F.length("word")).alias("longest")
    ).first()
    share = max(1.0, SEED_SHARE * (sums.n + sum(found.values())))
    seeds = {s: float(max(share, found.get(s, 0))) for s in SEEDS}
    table = words.sparkSession.createDataFrame(list(seeds.items()), "word string, n double")
    return Lexicon(
        others.select("word", F.col("n").cast("double").alias("n")).unionByName(table),
        sums.n + sum(seeds.values()),
        min(seeds.values()) if sums.least is None else min(sums.least, *seeds.values()),
        max(sums.longest or 0, *map(len, SEEDS)),
    )


def segment(name: str, logs: dict[str, float], least: float | None = None) -> list[str]:
    """The most probable split of `name` into words. A letter outside every word is UNKNOWN and
    costs more than the rarest word, of log-probability `least` (of `logs` if None); equal splits take the
    longer last word."""
    if not name:
        return []
    rare = (min(logs.values(), default=0.0) if least is None else least) - 5.0
    lengths = sorted({1, *map(len, logs)}, reverse=True)
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        score, start = -math.inf, end - 1
        for begin in (end - n for n in lengths if n <= end):
            piece = logs.get(name[begin:end], 2 * rare if end - begin == 1 else None)
            if piece is not None and best[begin] + piece > score:
                score, start = best[begin] + piece, begin
        best.append(score)
        back.append(start)
    pieces, end = [], len(name)
    while end:
        word = name[back[end] : end]
        pieces.append(word if word in logs else UNKNOWN)
        end = back[end]
    return pieces[::-1]


def url_names(urls: DataFrame) -> DataFrame:
    """`urls` (page_id, host, path) with a number `row` and the names of host and path, `hosts` and
    `paths`. Digits and signs part names and are dropped."""
    return urls.select(
        "page_id",
        "host",
        "path",
        F.regexp_extract_all("host", F.lit(_NAMES), F.lit(0)).alias("hosts"),
        F.regexp_extract_all(F.lower("path"), F.lit(_NAMES), F.lit(0)).alias("paths"),
        F.monotonically_increasing_id().alias("row"),
    )


def split_names(names: DataFrame, known: Lexicon) -> DataFrame:
    """`names` (different names, rows_here) with their `words` and `seed`, whether one of these is a seed."""
    keyed = names.withColumns({"k1": F.xxhash64("name"), "k2": F.xxhash64(F.lit(1), "name")})
    letters = F.length("name")
    begins = keyed.where(letters >= 2).select("*", F.explode(F.sequence(F.lit(1), letters - 1)).alias("begin"))
    longest = F.least(F.lit(SHORT), F.lit(known.longest), letters - F.col("begin") + 1)
    short = begins.select(
        "k1", "k2", F.explode(F.transform(
            F.sequence(F.lit(2), F.greatest(F.lit(2), longest)),
            lambda n: F.substring("name", F.col("begin"), n))).alias("word")
    )
    # Longer words are met by their beginning and then compared, so a name gives SHORT substrings a letter at most.
    long_words = known.words.where(F.length("word") > SHORT).select(
        "word", F.substring("word", 1, SHORT).alias("beginning")
    )
    met = begins.where(letters - F.col("begin") >= SHORT).withColumn(
        "beginning", F.substring("name", F.col("begin"), F.lit(SHORT))
    ).join(long_words, "beginning")
    long = met.where(F.substring("name", F.col("begin"), F.length("word")) == F.col("word")).select("k1", "k2", "word")
    parts = short.unionByName(materialize(long, "long-words"))
    here = parts.groupBy("word").agg(F.count("*").alias("rows_here"))
    needed = materialize(known.words.join(here, "word"), "words-in-names")
    n_rows = needed.agg(F.sum("rows_here")).first()[0] or 0
    own = (
        join_counted(parts, needed, ["word"], n_rows)
        .groupBy("k1", "k2")
        .agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("counts"))
    )
    seeds = frozenset(SEEDS)
    whole, least = known.whole, math.log(known.least / known.whole)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [
                segment(name, {w: math.log(n / whole) for w, n in counts or ()}, least)
                for name, counts in zip(batch.column("name").to_pylist(), batch.column("counts").to_pylist())
            ]
            yield pa.record_batch(
                [
                    batch.column("name"),
                    batch.column("rows_here"),
                    pa.array(words, pa.list_(pa.string())),
                    pa.array([not seeds.isdisjoint(w) for w in words], pa.bool_()),
                ],
                ["name", "rows_here", "words", "seed"],
            )

    return keyed.join(own, ["k1", "k2"], "left").mapInArrow(
        split, "name string, rows_here long, words array<string>, seed boolean"
    )


def naive_bayes(pieces: DataFrame) -> DataFrame:
    """`word`, `odds`, `rows_here`: log-odds (blocked against allowed) of each word, with SMOOTHING added to
    its counts, and the number of its rows in `pieces` (name, word, bad, good)."""
    counts = materialize(
        pieces.groupBy("word").agg(
            F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("rows_here")
        ),
        "url-word-counts",
    )
    sums = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("n")).first()
    bad, good = ((sums[k] or 0) + SMOOTHING * (sums.n + 1) for k in ("bad", "good"))
    odds = F.log((F.col("bad") + SMOOTHING) / bad) - F.log((F.col("good") + SMOOTHING) / good)
    # Sums of decimals do not depend on their order.
    return counts.select("word", odds.cast("decimal(28,15)").alias("odds"), "rows_here")


def log_odds(urls: DataFrame, known: Lexicon) -> DataFrame:
    """`urls` (page_id, host, path) with the `log_odds` of being blocked."""
    rows = materialize(url_names(urls), "url-names")
    each = rows.select("row", F.explode(F.concat("hosts", "paths")).alias("name"))
    names = materialize(each.groupBy("name").agg(F.count("*").alias("rows_here")), "names")
    n_each = names.agg(F.sum("rows_here")).first()[0] or 0
    parted = materialize(split_names(names, known), "split-names")
    seeded = join_counted(
        rows.select("row", F.explode("hosts").alias("name")),
        parted.where("seed").select("name", "rows_here"),
        ["name"],
        n_each,
    )
    labels = materialize(seeded.select("row").distinct(), "seeded-rows")
    labelled = rows.join(labels.withColumn("seeded", F.lit(1)), "row", "left")
    n_bad = labels.count()
    prior = math.log((n_bad + 1) / (rows.count() - n_bad + 1))
    per_name = (
        labelled.select("seeded", F.explode(F.concat("hosts", "paths")).alias("name"))
        .groupBy("name")
        .agg(F.count("seeded").alias("bad"), (F.count("*") - F.count("seeded")).alias("good"))
    )
    pieces = materialize(
        parted.join(per_name, "name").select("name", "bad", "good", F.explode("words").alias("word")), "name-words"
    )
    met = join_counted(pieces.select("name", "word"), naive_bayes(pieces), ["word"], pieces.count())
    of_name = met.groupBy("name").agg(F.sum("odds").alias("odds"))
    of_names = materialize(names.join(of_name, "name"), "name-odds")
    of_row = join_counted(each, of_names, ["name"], n_each).groupBy("row").agg(F.sum("odds").alias("odds"))
    total = F.coalesce(F.col("odds").cast("double"), F.lit(0.0))
    return rows.join(of_row, "row", "left").select(
        "page_id", "host", "path", (F.lit(prior) + total).alias("log_odds")
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """A row per row of `pages`: `page_id`, `host`, `path`, `rule` (null when none fits), `verdict`
    (the rule's, else the model's) and `log_odds` of being blocked."""
    scored = log_odds(parsed(pages), lexicon(pages))
    found = scored.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    model = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", model).alias("verdict"),
        "log_odds",
    )
