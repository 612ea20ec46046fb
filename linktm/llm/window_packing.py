"""Packing token ids into windows by non-negative least squares over length combinations.

A text is tokenized once and cut at whole windows; those fill a sequence each. The rests fall into BINS of equal
width (a length is rounded up), and only the histogram of bins reaches the driver. All combinations of at
most DEPTH bins that fill a window exactly are columns of a matrix; non-negative least squares gives how
often each is used, weighted by length, and the counts are rounded and held to what is there. The residual
histogram is packed greedily: the largest bin left, then the largest that fits, as often as all its
pieces last, where that wastes at most SLACK of the window. What is still left is one run of ids, cut where
windows end, so all padding but the last window's is that of rounding.

The plan is a table of ranges: "pieces a..b of this bin go to sequences s.., place p". Pieces are numbered
within their bin by task and place in it (counts per task and bin are summed, no sort of the pieces), so the
plan is joined by bin and range and no piece passes through the driver. Ids are stored once, with the pieces, in
the shared folder; only documents that are cut late, and readers of the packed ids, look at them again.

Nulls: a null text is empty and has the closing id only; a null doc_id is a document like others. Repeated rows are
documents of their own, each with all its pieces. Texts are tokenized whole. Strings of special tokens in a text become
their ids, as the library does by itself. Empty table: no rows. Other columns are never read, so their
names cannot clash.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linktm.scratch import materialize

WINDOW = 4096
BINS = 512
DEPTH = 3
END = 2
# Share of a window that a greedy combination may leave empty.
SLACK = 0.01
# Entries of a worker's cache of encoded words, and the longest word kept there.
CACHE = 300_000
CACHED_WORD = 64
# Texts whose words are looked up together, and words that the library is asked for together.
GROUP = 128
ASKED = 20_000
_SIGNS = b".,;:!?()\"#$%&*<>|-"
ID = np.dtype("<u4")


class WordEncoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library that drops white space and never joins what
    it parts: texts are cut at ASCII white space, and words are kept in a bounded cache. Where the tokenizer marks
    word ends, new words go through the library in one text and are told apart by their last ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ask(self, words: list[bytes]) -> None:
        """Put words that the cache lacks into it."""
        plain, others = [], []
        for word in words:
            (plain if word.decode().isalpha() else others).append(word)
        ids = self.tokenizer.encode(b" ".join(plain).decode(), add_special_tokens=False).ids
        tokens = np.array(ids, ID)
        ends = (np.flatnonzero(self.ends[tokens]) + 1).tolist()
        if len(ends) == len(plain) and (not plain or ends[-1] == len(tokens)):
            raw, at = tokens.tobytes(), 0
            for word, end in zip(plain, ends):
                self.known[word] = raw[4 * at : 4 * end]
                at = end
        else:
            others = words
        found = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        for word, one in zip(others, found):
            self.known[word] = np.array(one.ids, ID).tobytes()

    def _learn(self, words: Iterable[bytes]) -> None:
        stems: dict[bytes, tuple[bytes, bytes]] = {}
        new: dict[bytes, None] = {}
        for word in words:
            if word in self.known:
                continue
            if word in self.older:
                self.known[word] = self.older[word]
                continue
            # Letters are never joined with the signs behind them; other words are asked for as they are.
            stem = word.rstrip(_SIGNS)
            if len(stem) < len(word) and stem.decode().isalpha():
                stems[word] = stem, word[len(stem) :]
                new.update(dict.fromkeys(w for w in stems[word] if w not in self.known))
            else:
                new[word] = None
        asked = list(new)
        for at in range(0, len(asked), ASKED):
            self._ask(asked[at : at + ASKED])
        for word, (stem, signs) in stems.items():
            self.known[word] = self.known[stem] + self.known[signs]

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode()
        if self.lowers:
            low = raw.lower()
            # Lower case must not make a special token of what is none.
            if not any(s in low for s in self.special):
                raw = low
        return raw.split()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), GROUP):
            split = [self._words(t) for t in texts[at : at + GROUP]]
            self._learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))
            if len(self.known) >= CACHE:
                self.older = {w: i for w, i in self.known.items() if len(w) <= CACHED_WORD}
                self.known = {}


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """A row per piece, stored: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `ids` (4 bytes each), `bin` and
    `part`, `place`: the task and the piece's number among those of its bin there. Whole windows have bin `bins`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    closing = np.array([END], ID).tobytes()
    width = window // bins

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # One core a task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer).encode
        places = [0] * (bins + 1)
        for batch in batches:
            names = batch.column("doc_id")
            row, ids, start, sums, total, of_bin, place = ([] for _ in range(7))
            for n, tokens in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                tokens += closing
                for at in range(0, len(tokens), 4 * window):
                    piece = tokens[at : at + 4 * window]
                    b = -(-len(piece) // (4 * width))
                    row.append(n)
                    ids.append(piece)
                    start.append(at // 4)
                    sums.append(zlib.crc32(piece))
                    total.append(len(tokens) // 4)
                    of_bin.append(b)
                    place.append(places[b])
                    places[b] += 1
            yield pa.record_batch(
                [
                    names.take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(of_bin, pa.int32()),
                    pa.array(place, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "bin", "place"],
            )

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, bin int, place long"
    )
    found = docs.select("doc_id", "text").mapInArrow(cut, schema)
    return materialize(found.withColumn("part", F.spark_partition_id()), "pieces")


def combinations(window: int, have: np.ndarray, depth: int) -> np.ndarray:
    """Rows of bin numbers (ascending, 0 for none) of at most `depth` bins with pieces that together are `window`."""
    sizes = np.flatnonzero(have > 0)
    rows = [[0] * (depth - 1) + [window]] if have[window] else []

    def extend(chosen: list[int], left: int) -> None:
        if len(chosen) == depth - 1:
            if left >= chosen[-1] and have[left]:
                rows.append([*chosen, left])
            return
        if chosen and left >= chosen[-1] and have[left]:
            rows.append([0] * (depth - 1 - len(chosen)) + [*chosen, left])
        for s in sizes[(sizes >= (chosen[-1] if chosen else 1)) & (sizes * 2 <= left)]:
            extend([*chosen, int(s)], left - int(s))

    extend([], window)
    return np.unique(np.array(rows, np.int64).reshape(-1, depth), axis=0)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|: columns join the active set one by one, largest gradient first, and leave
    where their value would turn negative. The number of steps is bounded by the rows."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram_b = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gram_b).max(initial=0)))
    for _ in range(4 * a.shape[0] + 10):
        gradient = gram_b - a.T @ (a[:, active] @ x[active])
        gradient[active] = -np.inf
        best = int(gradient.argmax()) if n else 0
        if not n or active.all() or gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            columns = a[:, at]
            try:
                solved = np.linalg.solve(columns.T @ columns, gram_b[at])
            except np.linalg.LinAlgError:
                solved = np.linalg.lstsq(columns, b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[at] = solved
                break
            low = solved <= 0
            step = (x[at][low] / np.maximum(x[at][low] - solved[low], 1e-300)).min()
            x[at] += min(1.0, step) * (solved - x[at])
            out = at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]
            if not len(out):
                out = at[low][:1]
            active[out], x[out] = False, 0
            if not active.any():
                break
    return x


def plan_windows(histogram: dict[int, int], bins: int = BINS, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """[({bin: pieces of it in a window}, number of windows)]. Pieces that no window of the plan takes are left."""
    left = np.zeros(bins + 1, np.int64)
    for b, n in histogram.items():
        left[b] = n
    plan: list[tuple[dict[int, int], int]] = []

    def use(chosen: dict[int, int], times: int) -> None:
        times = min([times, *(int(left[b]) // m for b, m in chosen.items())])
        if times > 0:
            plan.append((chosen, times))
            for b, m in chosen.items():
                left[b] -= m * times

    # Whole windows need no partner.
    use({bins: 1}, int(left[bins]))
    rows = combinations(bins, left, depth)
    if len(rows):
        a = np.zeros((bins + 1, len(rows)))
        for column in range(depth):
            np.add.at(a, (rows[:, column], np.arange(len(rows))), 1)
        a[0] = 0
        weight = np.arange(bins + 1) / bins
        solved = non_negative_least_squares(a * weight[:, None], left * weight)
        for k in np.argsort(-solved, kind="stable"):
            if solved[k] >= 0.5:
                kinds, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
                use(dict(zip(kinds.tolist(), times.tolist())), int(solved[k] + 0.5))
    for b in range(bins, 0, -1):
        while left[b]:
            room, chosen = bins, {}
            rest = left.copy()
            for c in range(b, 0, -1):
                m = min(room // c, int(rest[c]))
                if m:
                    chosen[c] = m
                    room -= m * c
            if room > SLACK * bins:
                break
            use(chosen, int(left[b]))
    return plan


def _ranges(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """(bin, from, until, pieces a window, first sequence, first slot) of every range of pieces; number of sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for chosen, times in plan:
        slot = 0
        for b, m in sorted(chosen.items(), reverse=True):
            at = used.get(b, 0)
            rows.append((b, at, at + m * times, m, sequence, slot))
            used[b] = at + m * times
            slot += m
        sequence += times
    return rows, sequence


def _before(counts: DataFrame, of: str, by: list[str]) -> Column:
    """Sum of `of` over the tasks before, by group."""
    return F.coalesce(F.sum(of).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """A row per piece: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` and `ids`."""
    spark = docs.sparkSession
    pieces = pieces_of(docs, tokenizer, window, bins)
    counts = materialize(pieces.groupBy("part", "bin").agg(F.count("*").alias("n")), "bins")
    histogram = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    rows, n_sequences = _ranges(plan_windows(histogram, bins, depth))
    base = counts.select("part", "bin", _before(counts, "n", ["bin"]).alias("base"))
    # At most one row a task and bin, and one a bin of every combination in use.
    ranked = pieces.join(base, ["part", "bin"]).withColumn("rank", F.col("base") + F.col("place"))
    ranges = spark.createDataFrame(rows, "bin int, `from` long, until long, m long, first long, slot long")
    in_range = (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("until"))
    placed = ranked.join(F.broadcast(ranges), "bin").where(in_range)
    nth = F.col("rank") - F.col("from")
    order = Window.partitionBy("sequence_id").orderBy("slot")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = placed.select(
        *columns,
        F.expr("first + (rank - `from`) div m").alias("sequence_id"),
        (F.col("slot") + nth % F.col("m")).alias("slot"),
        "ids",
    ).withColumn("offset", (F.sum("length").over(order) - F.col("length")))
    return whole.drop("slot").unionByName(_run_on(ranked, ranges, n_sequences, window))


def _run_on(ranked: DataFrame, ranges: DataFrame, n_sequences: int, window: int) -> DataFrame:
    """The pieces that no range takes, as one run of ids cut where windows end."""
    kind = ranked.schema["doc_id"].dataType.simpleString()
    taken = ranges.groupBy("bin").agg(F.max("until").alias("taken"))
    rest = ranked.join(F.broadcast(taken), "bin", "left").where(F.col("rank") >= F.coalesce("taken", F.lit(0)))
    rest = materialize(rest.select("doc_id", "start", "length", "doc_tokens", "ids", "bin", "place", "part"), "rest")
    sums = rest.groupBy("part").agg(F.sum("length").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("bin", "place")
    run = rest.join(base, "part").withColumn("at", F.col("base") + F.sum("length").over(inside) - F.col("length"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, sums, sequence, offset, ids = ([] for _ in range(7))
            columns = (batch.column(c).to_pylist() for c in ("start", "at", "ids"))
            for n, (first, at, tokens) in enumerate(zip(*columns)):
                done, size = 0, len(tokens) // 4
                while done < size:
                    step = min(size - done, window - (at + done) % window)
                    piece = tokens[4 * done : 4 * (done + step)]
                    row.append(n)
                    start.append(first + done)
                    length.append(step)
                    sums.append(zlib.crc32(piece))
                    sequence.append(n_sequences + (at + done) // window)
                    offset.append((at + done) % window)
                    ids.append(piece)
                    done += step
            rows = pa.array(row, pa.int64())
            yield pa.record_batch(
                [
                    batch.column("doc_id").take(rows),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(sums, pa.int64()),
                    batch.column("doc_tokens").take(rows),
                    pa.array(sequence, pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return run.select("doc_id", "start", "doc_tokens", "at", "ids").mapInArrow(cut, schema)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """`sequence_id`, `ids` (4 bytes each, without padding), `ends`: the sequences themselves, and where pieces end."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"))
