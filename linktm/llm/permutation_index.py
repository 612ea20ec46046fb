"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, and posted in the inverted files of the
first of them. A query reads the files of a constant share of all pivots, its own first ones, ranks all it
finds there by the footrule distance of the two orders, and takes the inner product with the best ranked only:
a first pass over the files counts each query's distances, a second takes those within its limit.
Largest inner products are nearest neighbours once every vector gets one more component that
brings it to the largest norm, so pivots are compared in that space.

Pivots are a bounded sample: PIVOTS_PER_ROOT times the square root of the number of different vectors, at
most MAX_PIVOTS, chosen by hash. Every vector is indexed. Equal vectors are one entry that carries its
smallest ids, one more than an answer can hold, so a vector that fills a third of the table is one
posting. Files and the queries that read one are cut into pieces of at most PIECE rows. A query that found
fewer than it should reads all files.

Vectors that are null, empty, zero or of another length than most, or hold null or non-finite components
take no part; nor do rows without an id. Rows equal in id and vector count once. Rows that share an id
are all left out for the query of that id. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linktm.scratch import materialize

NEAREST = 20
PIVOTS_PER_ROOT = 1.0
MAX_PIVOTS = 4096
# Length of the order kept of a vector; files it is posted in; files a query reads, at least and as a share of all.
ORDER = 32
POSTED = 8
READ = 24
READ_SHARE = 1 / 6
# Share of what a query finds in all its files, in order of footrule distance, that gets an inner product, and
# the number for each file read that gets one in any case.
RERANKED = 0.5
AT_LEAST = 100
PIECE = 4096


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`id`, `v` (array of double) of the rows that take part, each once."""
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(
        v, lambda x: x != 0
    )
    # -0.0 and 0.0 are one value.
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    rows = vectors.where(F.col(id_column).isNotNull() & good).select(
        F.col(id_column).cast("long").alias("id"), plain.alias("v")
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (most.n if most else 0)).distinct()


def classes(vectors: DataFrame, nearest: int) -> DataFrame:
    """A row per different vector: `v`, and `ids`, the smallest ids that carry it (one more than an answer
    holds, as a query leaves itself out)."""
    first = Window.partitionBy("v").orderBy("id")
    kept = vectors.withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest + 1)
    return kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


class Pivots:
    """Sampled vectors, brought to one norm by a further component."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.norm = norm
        self.points = np.hstack([vectors, self._missing(vectors)])

    def _missing(self, vectors: np.ndarray) -> np.ndarray:
        left = self.norm**2 - np.einsum("ij,ij->i", vectors, vectors)
        return np.sqrt(np.maximum(left, 0))[:, None]

    def order(self, vectors: np.ndarray, stored: bool, length: int) -> np.ndarray:
        """The `length` nearest pivots of each vector, nearest first; queries have no further component."""
        extra = self._missing(vectors) if stored else np.zeros((len(vectors), 1))
        near = -(np.hstack([vectors, extra]) @ self.points.T)
        length = min(length, near.shape[1])
        head = np.argpartition(near, length - 1, axis=1)[:, :length]
        within = np.argsort(np.take_along_axis(near, head, 1), axis=1, kind="stable")
        return np.take_along_axis(head, within, 1).astype(np.int32)


def choose_pivots(entries: DataFrame, count: int) -> Pivots:
    norm = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    n = min(MAX_PIVOTS, count, max(ORDER, math.ceil(PIVOTS_PER_ROOT * math.sqrt(count))))
    rows = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(n).collect()
    return Pivots(np.array([r.v for r in rows]), math.sqrt(norm))


def files_read(n_pivots: int) -> int:
    return min(n_pivots, max(READ, math.ceil(READ_SHARE * n_pivots)))


def with_order(rows: DataFrame, pivots: Pivots, stored: bool, files: int) -> DataFrame:
    """`rows` with `order` (nearest pivots), and a row for each of the first `files` of all pivots, with
    `pivot`, its `rank` and `reads`, the bits of all these pivots (queries only)."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_pivots = len(sent.value.points)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                order = sent.value.order(_matrix(part.column("v")), stored, max(ORDER, files))
                bits = [None] * len(part)
                if not stored:
                    read = np.zeros((len(part), n_pivots), bool)
                    np.put_along_axis(read, order[:, :files], True, 1)
                    bits = [r.tobytes() for r in np.packbits(read, axis=1)]
                yield pa.record_batch(
                    [*part.columns, _lists(order[:, :ORDER]), _lists(order[:, :files]), pa.array(bits, pa.binary())],
                    [*part.schema.names, "order", "files", "reads"],
                )

    lists = T.ArrayType(T.IntegerType())
    new = [T.StructField("order", lists), T.StructField("files", lists), T.StructField("reads", T.BinaryType())]
    ordered = rows.mapInArrow(add, T.StructType([*rows.schema.fields, *new]))
    kept = [c for c in ordered.columns if c != "files" and not (stored and c == "reads")]
    return ordered.select(*kept, F.posexplode("files").alias("rank", "pivot"))


def _cut(rows: DataFrame, other: DataFrame, key: Column, name: str, other_name: str) -> DataFrame:
    """`rows` with the number `name` of its piece, once for every piece `other_name` of the other side.
    `other` and the own counts have one row per pivot."""
    pieces = other.select("pivot", f"n_{name}", f"n_{other_name}")
    joined = rows.join(pieces, "pivot")
    return joined.select(
        *rows.columns,
        F.pmod(F.xxhash64(key), F.col(f"n_{name}")).alias(name),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other_name}") - 1)).alias(other_name),
    )


def _costs(order: np.ndarray, n_pivots: int, length: int) -> np.ndarray:
    """What a pivot at each place of a stored order adds to its footrule distance from `order`, by
    pivot and place. A pivot that an order lacks stands behind its end; the sum over
    what only the query has is the same for all stored orders but for the pivots both have, and is taken off here."""
    place = np.full(n_pivots, length)
    place[order] = np.arange(len(order))
    ranks = np.arange(length)
    both = np.abs(place[:, None] - ranks) - (length - place[:, None])
    return np.where(place[:, None] < length, both, length - ranks).astype(np.int32)


class _Piece:
    """The queries and the entries of one piece of a file."""

    def __init__(self, queries: pa.Table, stored: pa.Table, n_pivots: int):
        self.n_pivots = n_pivots
        self.q_order, self.x_order = _matrix(queries.column("order")), _matrix(stored.column("order"))
        self.reads = queries.column("reads").to_pylist()
        self.length = self.x_order.shape[1]
        self.cell = self.x_order * self.length + np.arange(self.length)
        self.posted = self.x_order[:, :POSTED]
        self.before = np.arange(self.posted.shape[1]) < stored.column("rank").to_numpy()[:, None]

    def met(self, i: int) -> np.ndarray:
        """Entries that query `i` looks at here: what it meets in several files, it looks at in the
        first of the entry's."""
        bits = np.frombuffer(self.reads[i], np.uint8)
        read = np.unpackbits(bits, count=self.n_pivots).astype(bool)
        return np.flatnonzero(~(read[self.posted] & self.before).any(axis=1))

    def distances(self, i: int, at: np.ndarray) -> np.ndarray:
        """Footrule distances but for what is the same for all entries."""
        return np.take(_costs(self.q_order[i], self.n_pivots, self.length), self.cell[at]).sum(axis=1)


def _count(queries: pa.Table, stored: pa.Table, n_pivots: int) -> pa.Table:
    """For each query that meets any in one piece of a file: `ask`, `distances` and how many have each."""
    piece = _Piece(queries, stored, n_pivots)
    asks, distances, counts = [], [], []
    for i, ask in enumerate(queries.column("ask").to_pylist()):
        far, n = np.unique(piece.distances(i, piece.met(i)), return_counts=True)
        if len(far):
            asks.append(ask)
            distances.append(far.astype(np.int32))
            counts.append(n.astype(np.int64))
    columns = [
        pa.array(asks, pa.int64()),
        pa.array(distances, pa.list_(pa.int32())),
        pa.array(counts, pa.list_(pa.int64())),
    ]
    return pa.table(columns, ["ask", "distances", "counts"])


def _limit(counted: pa.Table, nearest: int, files: int) -> pa.Table:
    """`ask`, `most`: the distance up to which a query's candidates of all files get an inner product."""
    far = counted.column("distances").combine_chunks().flatten().to_numpy()
    n = counted.column("counts").combine_chunks().flatten().to_numpy()
    order = np.argsort(far, kind="stable")
    running = np.cumsum(n[order])
    kept = min(running[-1], max(nearest, AT_LEAST * files, math.ceil(RERANKED * running[-1])))
    most = far[order][np.searchsorted(running, kept)]
    return pa.table([counted.column("ask")[:1], pa.array([most], pa.int32())], ["ask", "most"])


def _find(queries: pa.Table, stored: pa.Table, n_pivots: int, nearest: int) -> pa.Table:
    """The `nearest` of each query in one piece of a file, among those within its `most` if it has one."""
    piece = _Piece(queries, stored, n_pivots)
    q_ids, most = queries.column("id").to_pylist(), queries.column("most").to_pylist()
    q, x = _matrix(queries.column("v")), _matrix(stored.column("v"))
    members = stored.column("ids").to_pylist()
    found: list[tuple[int, int, float]] = []
    for i, own in enumerate(q_ids):
        at = piece.met(i)
        if most[i] is not None:
            at = at[piece.distances(i, at) <= most[i]]
        if not len(at):
            continue
        score = (x @ q[i])[at]
        if len(at) > nearest:
            # Scores to the last bit for all that may be among the nearest.
            least = np.partition(score, len(at) - nearest)[len(at) - nearest]
            at = at[score >= least - 1e-9 * abs(least)]
        score = (x[at] * q[i]).sum(axis=1)
        some = sorted((-s, m) for s, j in zip(score.tolist(), at.tolist()) for m in members[j] if m != own)
        found += [(own, m, -s) for s, m in some[:nearest]]
    columns = list(zip(*found)) or [(), (), ()]
    types = pa.int64(), pa.int64(), pa.float64()
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["query_id", "vec_id", "score"])


def _search(queries: DataFrame, entries: DataFrame, pivots: Pivots, nearest: int, everything: bool) -> DataFrame:
    n_pivots = len(pivots.points)
    posted = with_order(entries, pivots, True, min(POSTED, n_pivots))
    # A query row is told from others of its id by its vector.
    asks = queries.withColumn("ask", F.xxhash64("id", "v"))
    files = n_pivots if everything else files_read(n_pivots)
    asked = with_order(asks, pivots, False, files)
    per_file = posted.groupBy("pivot").agg(F.ceil(F.count("*") / PIECE).alias("n_piece"))
    per_ask = asked.groupBy("pivot").agg(F.ceil(F.count("*") / PIECE).alias("n_asked"))
    counts = materialize(per_file.join(per_ask, "pivot"), "file-pieces")
    left = _cut(asked, counts, F.col("id"), "asked", "piece")
    right = _cut(posted, counts, F.col("v"), "piece", "asked")
    keys = ["pivot", "piece", "asked"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return _count(left, right, n_pivots)

    def limit(counted: pa.Table) -> pa.Table:
        return _limit(counted, nearest, files)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        return _find(left, right, n_pivots, nearest)

    if everything:
        limited = left.withColumn("most", F.lit(None).cast("int"))
    else:
        met = left.drop("v").groupBy(*keys).cogroup(right.drop("v", "ids").groupBy(*keys))
        counted = met.applyInArrow(count, "ask long, distances array<int>, counts array<long>")
        limits = materialize(counted.groupBy("ask").applyInArrow(limit, "ask long, most int"), "distance-limits")
        limited = left.join(limits, "ask")
    met = limited.groupBy(*keys).cogroup(right.groupBy(*keys))
    return met.applyInArrow(find, "query_id long, vec_id long, score double")


def _best(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= nearest)


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `nearest` found for every row of `vectors` (vec_id,
    embedding) that `is_query`, a condition on `id`, selects; all candidates where there are fewer."""
    usable_rows = materialize(usable(vectors), "vectors")
    entries = materialize(classes(usable_rows, nearest), "vector-classes")
    count = entries.count()
    spark = vectors.sparkSession
    if count == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = choose_pivots(entries, count)
    queries = usable_rows.where(is_query)
    found = materialize(_best(_search(queries, entries, pivots, nearest, False), nearest), "neighbours")
    n_ids = usable_rows.select(F.count_distinct("id")).first()[0]
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(nearest, n_ids - 1))
    short = materialize(
        queries.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short-queries"
    )
    whole = found.join(enough.select("query_id"), "query_id", "left_semi")
    again = _best(_search(short, entries, pivots, nearest, True), nearest)
    return whole.select("query_id", "rank", "vec_id", "score").unionByName(again)
