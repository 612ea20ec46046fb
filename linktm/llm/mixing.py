"""Mixing sources to target weights.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of
`BLOCK` words (the last one may be shorter). A source gets a number of slots from its target. Every
slot draws its output shard by a hash, which makes the counts of a source over the shards
multinomial, and takes the block that a pseudorandom permutation of the source's blocks assigns to
it; slots beyond the number of blocks begin a second permutation. Blocks are joined to the slots by
(source, block number). Everything is a hash of keys and a seed, so reruns agree.

The permutation is a swap-or-not shuffle: exact on any number of blocks, no table, no sort.

Nulls: a null text has size 0 and is never taken; a null source is the last source. Repeated
rows are documents of their own. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktm.llm.text import WHITE, WHITE_RUN, rows_of
from linktm.scratch import materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
BLOCK = 128
SHARD_WORDS = 1_000_000
SEED = 20
ROUNDS = 16
# Groups of documents per source whose sizes are summed one by one; a source's words are then
# numbered group by group, so that no task orders a whole source.
GROUPS = 1024


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE_RUN))).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """`id`, `version`, `source`, `size` of every row."""
    rows = rows_of(docs, F.col("source").alias("source"))
    return rows.select("id", "version", "source", word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row per source: `s` (its number by code point, null last), `source`, `source_size`,
    `target`, and `n_shards`, the number of output shards of the whole mixture. A source above MAX_EPOCHS times its size stops there and the others share the rest
    by weight: every other source gets one common rate times its weight, which the cumulative sums
    over the sources in order of size per weight give at once. One row per source is ordered in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w).cast("double") for w in WEIGHTS])
    named = per.select("source", "source_size", number.alias("s")).select(
        "s", "source", "source_size", F.get(weights, F.col("s") % len(WEIGHTS)).alias("weight")
    )
    limit = (MAX_EPOCHS * F.col("source_size")).cast("double")
    ordered = Window.orderBy(limit / F.col("weight"), "s").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sums = named.select(
        "*",
        limit.alias("limit"),
        (F.sum(limit).over(ordered) - limit).alias("limits_before"),
        (F.sum("weight").over(ordered) - F.col("weight")).alias("weights_before"),
        F.sum("weight").over(whole).alias("weights"),
        (F.sum("source_size").over(whole) * SHARE_PERCENT / 100).alias("wanted"),
    )
    rate = (F.col("wanted") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before"))
    rated = sums.withColumn("rate", rate)
    # The first source whose limit the rate keeps to fixes the rate of it and all after it.
    fits = F.when(
        F.col("rate") * F.col("weight") <= F.col("limit"),
        F.struct(F.col("limit") / F.col("weight"), "s", "rate"),
    )
    common = F.min(fits).over(whole)["rate"]
    aimed = rated.withColumn("common", common).select(
        "s",
        "source",
        "source_size",
        F.least("limit", F.coalesce(F.col("common") * F.col("weight"), F.col("limit"))).alias("target"),
    )
    shards = F.greatest(F.lit(1), F.ceil(F.sum("target").over(whole) / shard_words)).cast("long")
    return aimed.withColumn("n_shards", shards)


def placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """`sizes` with `s`, `source_size`, `target` and `start`: the words of the same source that
    stand before the document in the source's pseudorandom order."""
    numbered = sizes.alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    )
    keyed = numbered.select(
        "d.id",
        "d.version",
        "d.source",
        "size",
        "s",
        "source_size",
        "target",
        "n_shards",
        F.xxhash64(F.lit(SEED), "d.id", "d.version").alias("order"),
    ).withColumn("group", F.pmod(F.xxhash64(F.lit(SEED + 1), "order"), F.lit(GROUPS)))
    inside = Window.partitionBy("s", "group").orderBy("order", "id", "version")
    offsets = Window.partitionBy("s").orderBy("group")
    groups = (
        keyed.groupBy("s", "group")
        .agg(F.sum("size").alias("total"))
        .select("s", "group", (F.sum("total").over(offsets) - F.col("total")).alias("offset"))
    )
    rows = Window.unboundedPreceding, Window.currentRow
    local = keyed.withColumn("local", F.sum("size").over(inside.rowsBetween(*rows)) - F.col("size"))
    return local.join(groups, ["s", "group"]).select(
        "id",
        "version",
        "source",
        "size",
        "s",
        "source_size",
        "target",
        "n_shards",
        (F.col("offset") + F.col("local")).alias("start"),
    )


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Place of `x` (0 <= x < n) under the pseudorandom permutation of [0, n) named by `key`."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - at, n)
        swap = F.xxhash64(F.lit(SEED + 2), key, r, F.greatest(at, partner)) < 0
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def block_parts(place: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and block it has words in: the columns of `place`, `block`, `n_blocks`
    (of the source), `first` (its first word there, from 0) and `n` (how many)."""
    parts = place.where(F.col("size") > 0).select(
        "*",
        F.explode(
            F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
        ).alias("block"),
    )
    begin = F.greatest(F.col("block") * block, F.col("start"))
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return parts.select(
        "*",
        F.expr(f"(source_size + {block - 1}) div {block}").alias("n_blocks"),
        (begin - F.col("start")).alias("first"),
        (end - begin).alias("n"),
    )


def slots(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture, a row per slot: `shard`, `s`, `slot`, `epoch`, `block`. Slots are counted from
    the blocks (slot j of an epoch stands where block j begins), so no row unfolds into a source."""
    begun = parts.where(F.col("block") * block >= F.col("start")).select(
        "s",
        "n_blocks",
        "n_shards",
        F.col("block").alias("j"),
        F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long").alias("n_slots"),
    )
    each = begun.select(
        "s",
        "n_blocks",
        "n_shards",
        "n_slots",
        "j",
        F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))).alias("epoch"),
    ).withColumn("slot", F.col("j") + F.col("epoch") * F.col("n_blocks"))
    return each.where(F.col("slot") < F.col("n_slots")).select(
        F.pmod(F.xxhash64(F.lit(SEED + 3), "s", "slot"), F.col("n_shards")).alias("shard"),
        "s",
        "slot",
        "epoch",
        permuted(F.col("j"), F.col("n_blocks"), F.xxhash64("s", "epoch")).alias("block"),
    )


def shard_counts(mixture: DataFrame) -> DataFrame:
    """`shard`, `s`, `n`: the multinomial counts of each source in each output shard."""
    return mixture.groupBy("shard", "s").agg(F.count("*").alias("n"))


def mix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, parts, mixture): every row with its source's target and place, the parts of
    documents in each block, and the slots that take blocks."""
    sizes = materialize(sized(docs), "mix-sizes")
    targets = materialize(source_targets(sizes), "mix-targets")
    place = materialize(placed(sizes, targets), "mix-places")
    parts = block_parts(place, block)
    return place, parts, slots(parts, block)


def taken_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per row of `docs`: `doc_id`, `size`, `source_size`, `target`, `taken`."""
    place, parts, mixture = mix(docs, block)
    times = mixture.groupBy("s", "block").agg(F.count("*").alias("times"))
    used = parts.join(times, ["s", "block"])
    per_doc = used.groupBy("id", "version", "s", "start", "size", "source_size", "target").agg(
        F.sum(F.col("n") * F.col("times")).alias("taken")
    )
    got = per_doc.select("s", "start", "taken").withColumnRenamed("start", "begin")
    return place.join(
        got.withColumnRenamed("s", "source_no"),
        (F.col("s") == F.col("source_no")) & (F.col("start") == F.col("begin")) & (F.col("size") > 0),
        "left",
    ).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents of the mixture, with all columns of `docs`: a row per document and epoch that
    takes words of it, with those words (and the white space before each) as `text` and their
    length as `n_chars`. A document taken whole keeps its text as it is. Rows equal in id, text and
    source are copies of one document and show the other columns of one of them."""
    _, parts, mixture = mix(docs, block)
    used = parts.join(mixture.select("s", "block", "epoch"), ["s", "block"])
    runs = used.groupBy("id", "version", "source", "start", "size", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("first", "n"))).alias("runs"),
        F.sum("n").alias("taken"),
    )
    rows = rows_of(docs, F.col("source").alias("source"), F.struct("*").alias("row"))
    one = rows.groupBy("id", "version", "source").agg(F.first("row").alias("row"))
    joined = runs.alias("r").join(
        one.alias("o"),
        F.col("r.id").eqNullSafe(F.col("o.id"))
        & (F.col("r.version") == F.col("o.version"))
        & F.col("r.source").eqNullSafe(F.col("o.source")),
    )
    spaced = joined.select(
        "row",
        "size",
        "taken",
        "runs",
        F.expr(r"regexp_extract_all(row.text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)").alias("units"),
    )
    part = F.array_join(
        F.flatten(F.transform("runs", lambda r: F.slice(F.col("units"), r["first"] + 1, r["n"]))), ""
    )
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(part)
    new = spaced.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return new.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
