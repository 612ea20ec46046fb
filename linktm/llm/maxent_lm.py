"""Language model: hashed maximum entropy with a class-factored softmax.

A word belongs to one of CLASSES classes by its first bytes: the most frequent beginnings have
classes of their own, the others share some by hash. The model is P(class | history) P(word | class). The first
factor is a softmax over hashed features of the history: the word before, the two words before
together (n-grams), the second and the third word before (skips). The second is the maximum-entropy
distribution whose features are the word, and the word together with the word before it, which is hashed to one of
HISTORIES. It has a closed form: q, add-one counts within the class with one more share standing for all unknown words of
the class, times a weight of each pair met in training, times what makes it sum to one for that history and class. With
n of the pair, N of the history's words in the class and D different ones among them, that is
(n - DISCOUNT + DISCOUNT * D * q) / N, without the first two terms where the pair was not met. Both factors sum to one.

Counts cover all training texts. The softmax starts at the class frequencies and is trained in ROUNDS
rounds that together read every training text once: in a round each task takes gradient steps on its
texts from the weights it was sent, and the weights' changes are averaged by the number of tokens, with partial
sums before the shuffle. These weights (2^FEATURE_BITS rows of CLASSES numbers) have a fixed size; the table of pairs
grows with the corpus.

Counts of words and weights of pairs are looked up in two ways: the HOT most frequent words and of their pairs the HOT_PAIRS
most frequent are sent to the tasks, all others are joined by word. Either way each token has its exact count and weight.

Nulls: a null text is empty and has only its end; a null id is never held out. Repeated rows count
and are scored as often as they occur. Without training texts every token has probability 1 of an empty
vocabulary's unknown share. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linktm.llm.frequent import least_step, most_frequent, step_of
from linktm.scratch import materialize

FOLDS, HELD_OUT = 7, 2
CLASSES = 48
SHARED_CLASSES = 8
BEGINNING = 3
# At most 16.
FEATURE_BITS = 13
ROUNDS = 3
STEP = 2048
RATE = 0.3
# Scores up to this size need no shift before their exponential is taken.
FITS = 60
# Histories of a word within its class: at most 64, the bits of one long. No word before is history 0.
HISTORIES = 64
DISCOUNT = 0.75
HOT = 250_000
HOT_PAIRS = 2_000_000
# Entries of a worker's tables of words.
CACHE = 300_000
# Tokens whose pairs a worker holds before it sums and sends them.
HELD = 2_000_000
# Texts' tokens that are scored or trained on at once.
CHUNK = 32_768
# Words whose different ones are looked up at once, and bytes of the texts that are split at once.
BLOCK = 1_000_000
SPLIT_BYTES = 1 << 22
END_CLASS = 0


def in_fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """`word` (bytes), `n`, `pairs` (n by history) over the column `text`. Each task sums in tables of
    bounded size; a word's rows move once."""
    schema = pa.schema([("word", pa.binary()), ("before", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Words(lambda word: zlib.crc32(word) << 8)
        held: list[np.ndarray] = []

        def summed() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            words = pa.array(list(table), pa.binary())
            for at in range(0, len(pairs), 2 * CHUNK):
                some = pairs[at : at + 2 * CHUNK]
                columns = [
                    words.take(pa.array(some // HISTORIES)),
                    pa.array(some % HISTORIES, pa.int32()),
                    pa.array(n[at : at + 2 * CHUNK], pa.int64()),
                ]
                yield pa.record_batch(columns, schema=schema)

        for _, _, words, sizes in blocks(batches, "text"):
            found = looked_up(words, table)
            for begin, end, word in runs(sizes):
                numbers, codes, place, _ = laid_out(found[word : word + sizes[begin:end].sum()], sizes[begin:end], table)
                known = numbers >= 0
                held.append(numbers[known] * HISTORIES + history(codes, place)[known])
            if len(table) > CACHE or sum(map(len, held)) > HELD:
                yield from summed()
                held.clear()
                table.refill()
        if held:
            yield from summed()

    pairs = texts.select("text").mapInArrow(count, "word binary, before int, n long").repartition("word")
    return (
        pairs.groupBy("word", "before")
        .agg(F.sum("n").alias("n"))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("before", "n"))).alias("pairs"))
    )


@dataclass
class Vocabulary:
    """What every task needs to know of the words; of bounded size."""

    beginnings: dict[bytes, int]
    log_rest: np.ndarray
    n_texts: int
    n_tokens: int
    n_words: int

    def class_of(self, word: bytes) -> int:
        begin = word[:BEGINNING]
        own = self.beginnings.get(begin)
        return own if own is not None else CLASSES - SHARED_CLASSES + zlib.crc32(begin) % SHARED_CLASSES

    def code(self, word: bytes) -> int:
        return zlib.crc32(word) << 8 | self.class_of(word)


@dataclass
class Within:
    """The factor within the class, of bounded size. By cell (history * CLASSES + class): `log_norm`, log10 of what an
    unmet pair's word takes of its q, and `factor`, size of the class / (DISCOUNT * D), 0 for cells not met. The hot words with their
    codes and log10(n + 1), and of their pairs (number * HISTORIES + history, in order) those that are sent, with log10 of
    their weights; `unsent` has a bit for each history of a word's other pairs."""

    log_norm: np.ndarray
    factor: np.ndarray
    hot: list[bytes]
    codes: np.ndarray
    logs: np.ndarray
    pairs: np.ndarray
    weights: np.ndarray
    unsent: np.ndarray


def vocabulary(counts: DataFrame, n_texts: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the number of training tokens in each class."""
    begin = F.substring("word", 1, BEGINNING)
    per_begin = counts.groupBy(begin.alias("begin")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    own = CLASSES - SHARED_CLASSES - 1
    top = per_begin.orderBy(F.desc("n"), "begin").limit(own).collect()
    beginnings = {bytes(r.begin): i + 1 for i, r in enumerate(top)}
    listed = per_begin.where(~F.col("begin").isin([bytearray(b) for b in beginnings])) if beginnings else per_begin
    shared = listed.groupBy((F.crc32("begin") % SHARED_CLASSES).alias("h")).agg(
        F.sum("n").alias("n"), F.sum("words").alias("words")
    )
    mass, words = np.zeros(CLASSES), np.zeros(CLASSES)
    mass[END_CLASS], words[END_CLASS] = n_texts, min(n_texts, 1)
    for r in top:
        mass[beginnings[bytes(r.begin)]], words[beginnings[bytes(r.begin)]] = r.n, r.words
    for r in shared.collect():
        mass[own + 1 + r.h], words[own + 1 + r.h] = r.n, r.words
    log_rest = -np.log10(mass + words + 1)
    return Vocabulary(beginnings, log_rest, n_texts, int(mass.sum()), int(words.sum())), mass


def within(counts: DataFrame, words: Vocabulary) -> Within:
    spark = counts.sparkSession
    listed = [(bytearray(b), c) for b, c in words.beginnings.items()]
    own = F.broadcast(spark.createDataFrame(listed, "begin binary, own int"))
    classed = counts.withColumn("begin", F.substring("word", 1, BEGINNING)).join(own, "begin", "left")
    shared = CLASSES - SHARED_CLASSES + F.crc32("begin") % SHARED_CLASSES
    cell = F.col("before") * CLASSES + F.coalesce("own", shared)
    per_cell = (
        classed.select("begin", "own", F.explode("pairs").alias("before", "n"))
        .groupBy(cell.cast("int").alias("cell"))
        .agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    )
    log_norm, factor = np.zeros(HISTORIES * CLASSES), np.zeros(HISTORIES * CLASSES)
    for r in per_cell.collect():
        log_norm[r.cell] = math.log10(DISCOUNT * r.words / r.n)
        factor[r.cell] = 10 ** -words.log_rest[r.cell % CLASSES] / (DISCOUNT * r.words)
    hot = most_frequent(counts, HOT)
    least = least_step(hot.select(F.explode("pairs").alias("before", "n")), HOT_PAIRS)
    pairs = F.map_entries("pairs").cast("array<struct<before:int,n:bigint>>")
    sent = F.filter(pairs, lambda p: step_of(p["n"]) >= F.lit(least))
    left = F.filter(pairs, lambda p: step_of(p["n"]) < F.lit(least))
    one = F.lit(1).cast("long")
    unsent = F.aggregate(left, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", one, p["before"])))
    table = hot.select("word", "n", sent.alias("sent"), unsent.alias("unsent")).toArrow()
    names, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    lists = table.column("sent").combine_chunks()
    number = np.repeat(np.arange(len(names)), np.diff(lists.offsets.to_numpy()))
    before, n_pair = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
    codes = np.fromiter(map(words.code, names), np.int64, len(names))
    pairs = number * HISTORIES + before
    weights = np.log10(1 + (n_pair - DISCOUNT) * factor[before * CLASSES + (codes[number] & 255)] / (n[number] + 1))
    order = np.argsort(pairs)
    return Within(
        log_norm,
        factor,
        names,
        codes,
        np.log10(n + 1.0),
        pairs[order].astype(np.int32),
        weights[order].astype(np.float32),
        table.column("unsent").to_numpy(),
    )


class _Words(dict):
    """Numbers of words, hot ones first, and the words' codes (hash << 8 | class) by number."""

    def __init__(self, code: Callable[[bytes], int], hot: Iterable[bytes] = (), hot_codes: np.ndarray | None = None):
        super().__init__()
        self.code, self.hot = code, {word: i for i, word in enumerate(hot)}
        self.hot_codes = b"" if hot_codes is None else hot_codes.tobytes()
        self.refill()

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.codes)
        self.codes.append(self.code(word))
        return number

    def refill(self) -> None:
        self.clear()
        self.update(self.hot)
        self.codes = array("q", self.hot_codes)

    def trim(self) -> None:
        """Keeps the table's size bounded; numbers given before no longer hold."""
        if len(self) > CACHE + len(self.hot):
            self.refill()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def history(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The history of each token within its class: the word before, hashed; 0 where there is none."""
    earlier = np.zeros(len(codes), np.uint64)
    earlier[1:] = (codes[:-1] >> 8).astype(np.uint64) + np.uint64(1)
    earlier[place == 0] = 0
    return ((earlier * _MIX >> np.uint64(32)) * np.uint64(HISTORIES) >> np.uint64(32)).astype(np.int64)


def features(codes: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Rows of the weight table for each token: `codes` of texts laid end to end, `place` of each token in its text."""
    words = (codes >> 8).astype(np.uint64) + np.uint64(1)

    def back(k: int) -> np.ndarray:
        earlier = np.zeros(len(words), np.uint64)
        earlier[k:] = words[:-k]
        earlier[place < k] = 0
        return earlier

    def row(value: np.ndarray, kind: int) -> np.ndarray:
        mixed = (value * np.uint64(8) + np.uint64(kind)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * _MIX) >> np.uint64(64 - FEATURE_BITS)).astype(np.uint16)

    one, two, three = back(1), back(2), back(3)
    return [row(one, 1), row(one + two * _MIX, 2), row(two, 3), row(three, 4)]


def _scores(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Scores of the classes for each token, with an exponential that fits."""
    scores = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        scores += np.take(weights, r, axis=0)
    scores += bias
    if scores.size and max(scores.max(), -scores.min()) > FITS:
        scores -= scores.max(axis=1, keepdims=True)
    return scores


_ONES = np.ones(CLASSES, np.float32)


def log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's class probability."""
    scores = _scores(weights, bias, rows)
    own = scores[np.arange(len(scores)), label]
    return own - np.log(np.exp(scores, out=scores) @ _ONES)


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    scores = _scores(weights, bias, rows)
    np.exp(scores, out=scores)
    scores /= (scores @ _ONES)[:, None]
    return scores


def laid_out(found: np.ndarray, sizes: np.ndarray, table: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, codes, place, sizes) of texts with the words `found`, each closed by its end, whose number is -1."""
    size = sizes + 1
    ends = np.cumsum(size)
    word = np.ones(ends[-1], bool)
    word[ends - 1] = False
    numbers, codes = np.full(ends[-1], -1), np.full(ends[-1], END_CLASS)
    numbers[word] = found
    if len(found):
        codes[word] = np.frombuffer(table.codes, np.int64)[found]
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    return numbers, codes, place, size


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    some = rows[order]
    new = np.r_[True, some[1:] != some[:-1]]
    begins, more = np.flatnonzero(new), np.flatnonzero(~new)
    # Most rows come once and are their own sum.
    sums = np.take(values, order[begins], axis=0)
    width = values.shape[1]
    to = ((np.cumsum(new)[more] - 1)[:, None] * width + np.arange(width)).ravel()
    np.add.at(sums.reshape(-1), to, np.take(values, order[more], axis=0).ravel())
    return some[begins], sums


def train_on(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, codes: np.ndarray, place: np.ndarray) -> None:
    """Gradient steps (each row's rate falls with its squared gradients) over laid-out texts, in place."""
    rows = features(codes, place)
    label = codes & 255
    for at in range(0, len(codes), STEP):
        step = [r[at : at + STEP] for r in rows]
        error = probabilities(weights, bias, step)
        error[np.arange(len(error)), label[at : at + STEP]] -= 1
        for r in step:
            touched, gradient = _sums(r, error)
            size = np.take(squares, touched, axis=0)
            size += gradient * gradient
            squares[touched] = size
            size += 1
            np.sqrt(size, out=size)
            gradient *= -RATE
            gradient /= size
            moved = np.take(weights, touched, axis=0)
            moved += gradient
            weights[touched] = moved


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as `tokens` has them, and their number in each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    # White space at the ends of a text splits off an empty word.
    some = pc.greater(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    offsets = lists.offsets.to_numpy()
    return flat.filter(some), np.diff(upto[offsets - offsets[0]])


def runs(sizes: np.ndarray, whole: bool = True) -> Iterator[tuple[int, int, int]]:
    """Runs of texts of about CHUNK tokens: the first text, the one behind the last, and the words before; with `whole` also
    what is left at the end."""
    begin = words = total = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n + 1
        total += n
        if size >= CHUNK:
            yield begin, i + 1, words
            begin, words, size = i + 1, total, 0
    if whole and size:
        yield begin, len(sizes), words


def blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, pa.Array, np.ndarray]]:
    """The batch, the first row, the words and their number in each row, for rows of about BLOCK words; a batch's runs lie
    in one block each."""
    for batch in batches:
        texts = batch.column(column)
        at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SPLIT_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        first, words, sizes = 0, pa.array([], pa.string()), np.empty(0, np.int64)
        for low, high in zip(cuts, cuts[1:]):
            more, numbers = split(texts.slice(low, high - low))
            words, sizes = pa.concat_arrays([words, more]), np.r_[sizes, numbers]
            closed = [end for _, end, _ in runs(sizes, whole=False)] if len(words) >= BLOCK and high < len(texts) else []
            if closed:
                n = int(sizes[: closed[-1]].sum())
                yield batch, first, words.slice(0, n), sizes[: closed[-1]]
                first, words, sizes = first + closed[-1], words.slice(n), sizes[closed[-1] :]
        if len(sizes):
            yield batch, first, words, sizes


def looked_up(words: pa.Array, table: _Words) -> np.ndarray:
    """The numbers of words; each different one is looked up once."""
    coded = words.dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    each = np.fromiter(map(table.__getitem__, different), np.int64, len(different))
    return each[coded.indices.to_numpy()]


def chunks(
    batches: Iterable[pa.RecordBatch], column: str, table: _Words
) -> Iterator[tuple[pa.RecordBatch, int, pa.Array, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK tokens: the batch, the first row, the rows' words, their numbers, and how many each row has."""
    for batch, first, words, sizes in blocks(batches, column):
        table.trim()
        found = looked_up(words, table)
        for begin, end, word in runs(sizes):
            n = int(sizes[begin:end].sum())
            yield batch, first + begin, words.slice(word, n), found[word : word + n], sizes[begin:end]


def train(texts: DataFrame, words: Vocabulary, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and class bias from `texts` (id, text)."""
    spark = texts.sparkSession
    bias = np.log((mass + 1) / (mass.sum() + CLASSES)).astype(np.float32)
    weights = np.zeros((1 << FEATURE_BITS, CLASSES), np.float32)
    sent_words = spark.sparkContext.broadcast(words)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            new, squares = sent.value.copy(), np.zeros_like(sent.value)
            table = _Words(sent_words.value.code)
            seen = 0
            for _, _, _, found, sizes in chunks(batches, "text", table):
                _, codes, place, _ = laid_out(found, sizes, table)
                train_on(new, squares, bias, codes, place)
                seen += len(codes)
            if seen:
                moved = np.flatnonzero(squares.any(axis=1))
                change = (new[moved] - sent.value[moved]) * np.float32(seen)
                offsets = pa.array(np.arange(len(moved) + 1) * CLASSES, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(change.ravel()))
                # Row -1 carries the number of tokens.
                yield pa.record_batch([pa.array(moved), lists], ["row", "change"])
                yield pa.record_batch(
                    [pa.array([-1]), pa.array([[float(seen)] * CLASSES], pa.list_(pa.float32()))], ["row", "change"]
                )

        mine = texts.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == turn)
        moves = mine.mapInArrow(learn, "row long, change array<float>")
        sums = moves.groupBy("row").agg(*[F.sum(F.col("change")[i]).alias(f"s{i}") for i in range(CLASSES)])
        table = sums.toPandas()
        total = table.loc[table["row"] == -1, "s0"].sum()
        changed = table[table["row"] >= 0]
        if total:
            weights = weights.copy()
            weights[changed["row"].to_numpy()] += (changed.drop(columns="row").to_numpy() / total).astype(np.float32)
    return weights, bias


def _partial_scores(texts: DataFrame, words: Vocabulary, inside: Within, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """Per row of `texts` (id, text): `id`, `n_tokens`; `model` (log10 of the class factors, the class sizes, the
    norms of the histories and the weights of pairs looked up here), `log_counts` (sum of log10(count + 1) of words looked up here and
    end), `known` (their number); and `rest`, the other words with their cells and number of times."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((words, inside, weights, bias))
    end_log, end_known = math.log10(words.n_texts + 1), int(words.n_texts > 0)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, inside, weights, bias = sent.value
        table = _Words(words.code, inside.hot, inside.codes)
        # The sent pairs of a word lie together in the order of its histories, which are the bits of one number.
        one = np.uint64(1)
        sent_bits = np.zeros(len(inside.hot), np.uint64)
        np.bitwise_or.at(sent_bits, inside.pairs // HISTORIES, one << (inside.pairs % HISTORIES).astype(np.uint64))
        sent_from = np.searchsorted(inside.pairs, np.arange(len(inside.hot)) * HISTORIES)
        for batch, begin, run, found, sizes in chunks(batches, "text", table):
            numbers, codes, place, size = laid_out(found, sizes, table)
            label, before = codes & 255, history(codes, place)
            cell = before * CLASSES + label
            rows = features(codes, place)
            logp = np.empty(len(codes))
            for at in range(0, len(codes), STEP):
                step = slice(at, at + STEP)
                logp[step] = log_probabilities(weights, bias, [r[step] for r in rows], label[step])
            model = logp / math.log(10) + words.log_rest[label] + inside.log_norm[cell]
            hot = np.flatnonzero((numbers >= 0) & (numbers < len(inside.hot)))
            number, past = numbers[hot], before[hot]
            bits, bit = sent_bits[number], one << past.astype(np.uint64)
            met = bits & bit != 0
            at = sent_from[number] + np.bitwise_count(bits & (bit - one))
            here = met | (inside.unsent[number] >> past & 1 == 0)
            model[hot[met]] += inside.weights[at[met]]
            counted, known, rest = np.zeros(len(codes)), np.zeros(len(codes), np.int64), numbers >= 0
            counted[numbers < 0], known[numbers < 0] = end_log, end_known
            counted[hot[here]], known[hot[here]], rest[hot[here]] = inside.logs[number[here]], 1, False
            begins = np.cumsum(size) - size
            others = np.flatnonzero(rest)
            text_no = np.repeat(np.arange(len(size)), size)[others]
            each = (text_no * len(table) + numbers[others]) * HISTORIES + before[others]
            _, first, times = np.unique(each, return_index=True, return_counts=True)
            rare = run.take(pa.array(others[first] - text_no[first])).cast(pa.binary())
            columns = [rare, pa.array(cell[others[first]], pa.int32()), pa.array(times, pa.int64())]
            offsets = np.searchsorted(text_no[first], np.arange(len(size) + 1))
            yield pa.record_batch(
                [
                    batch.column("id").slice(begin, len(size)),
                    pa.array(size),
                    pa.array(np.add.reduceat(model, begins)),
                    pa.array(np.add.reduceat(counted, begins)),
                    pa.array(np.add.reduceat(known, begins)),
                    pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["word", "cell", "times"])
                    ),
                ],
                ["id", "n_tokens", "model", "log_counts", "known", "rest"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        score,
        f"id {kind}, n_tokens long, model double, log_counts double, known long, "
        "rest array<struct<word:binary,cell:int,times:bigint>>",
    )


def score_texts(docs: DataFrame) -> DataFrame:
    """A row per row of `docs`: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`
    and `score`, log10 probabilities of the whole text and its end."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    learnt = texts.where(~in_fold(F.col("id")))
    counts = materialize(word_counts(learnt), "word-counts")
    words, mass = vocabulary(counts, learnt.select("id").count())
    inside = within(counts, words)
    weights, bias = train(learnt, words, mass)
    partial = materialize(
        _partial_scores(texts, words, inside, weights, bias).withColumn("row", F.monotonically_increasing_id()),
        "partial-scores",
    )
    cells = spark.createDataFrame([(i, float(f)) for i, f in enumerate(inside.factor)], "cell int, factor double")
    pair = F.try_element_at("pairs", F.expr(f"int(cell div {CLASSES})"))
    weight = F.log10(1 + (pair - DISCOUNT) * F.col("factor") / (F.col("n") + 1))
    met = (
        partial.select("row", F.inline("rest"))
        .join(counts, "word")
        .join(F.broadcast(cells), "cell")
        .select("row", "times", F.log10(F.col("n") + 1).alias("log"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.col("log")).alias("rare_logs"),
            F.sum(F.col("times") * F.col("weight")).alias("rare_weights"),
            F.sum("times").alias("rare_known"),
        )
    )
    joined = partial.drop("rest").join(met, "row", "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    base = math.log10(words.n_tokens + words.n_words + 1)
    return joined.select(
        F.col("id").alias("doc_id"),
        in_fold(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.n_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + logs + F.coalesce("rare_weights", F.lit(0.0))).alias("score"),
    )
