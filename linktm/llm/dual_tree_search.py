"""Ranked lexical search: exact top k documents of every item, by a dual-tree search.

One pass over the texts leaves, per document, its length and the counts of those of its terms that some item
has; document frequencies and corpus sizes come from that table. Scores are sums over an item's terms of a
weight of the term times a value of the document, so both sides are sparse vectors. Each side has a hierarchy
whose nodes hold the maximum per term: of items (LEAF, then FAN leaves, by their most common term) and, in each
batch of a task, of documents (in the order of their strongest term). The product of two nodes is a bound
on every score below the pair; where it is below the weakest k-th score of the node's items, all
pairs below are left out. Nothing else is, so results are those of scoring every pair.

The k-th scores start from rounds: documents are dealt by hash into shares, each SHARE times the one before,
and the k-th scores of the shares searched so far bound the next. A task returns at most k rows an item.

Items are taken in blocks of about BLOCK bytes of text; only a block and its terms (and numbers per item and term of
it) reach the driver and the tasks. Documents are never collected.

Nulls: a null text has no terms, a null doc_id ranks before others of its score. Repeated documents are
documents of their own with ranks of their own; items equal in id and text count once, items of one id and
different texts are ranked apart. An item without terms, and any item of an empty table of documents, has
no rows. Texts are read whole, one at a time. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linktm.scratch import materialize, new_path

TOP = 50
BLOCK = 8 << 20
LEVELS = 3
SHARE = 20
FIRST = 20_000
LEAF, FAN = 8, 8
DOC_LEAF, DOC_FAN = 32, 32
# Entries of a dense table of bounds, and of one step of filling it.
CELLS = 4 << 20

# Bytes of UTF-8 that belong to terms: digits, letters (A-Z lower-cased) and all of a character beyond ASCII.
_TERMS = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(item_id, its different terms) of all items that have terms, a block at a time."""
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK)
    for block in range(n):
        of_block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        block = [(r.item_id, sorted(set(terms_of(r.text)))) for r in of_block.collect()]
        yield [item for item in block if item[1]]


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """`id`, `n` (terms of the text), `terms`, `counts` (of those in the vocabulary) and `level`, the share that a
    document is dealt to; stored by level."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(vocabulary)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py() or "")
                found = Counter(words)
                mine = sorted((number[w], found[w]) for w in found.keys() & number.keys())
                sizes.append(len(words))
                terms.append([t for t, _ in mine])
                counts.append([n for _, n in mine])
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                    batch.column("level"),
                ],
                ["id", "n", "terms", "counts", "level"],
            )

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARE**LEVELS))
    level = sum(((draw % SHARE**k == 0).cast("int") for k in range(1, LEVELS + 1)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", level.alias("level"))
    schema = "id long, n long, terms array<int>, counts array<long>, level int"
    path = new_path(spark, "document-terms")
    rows.mapInArrow(read, schema).write.partitionBy("level").parquet(path)
    return spark.read.schema(schema).parquet(path)


class ItemTree:
    """Items and their hierarchy: for each level, from the root down, the nodes that hold a term."""

    def __init__(self, items: list[list[int]], weights: np.ndarray):
        self.n = len(items)
        self.weights = weights
        common = [min(terms, key=lambda t: (weights[t], t), default=-1) for terms in items]
        # Item numbers by place in the hierarchy.
        self.order = np.array(sorted(range(self.n), key=lambda i: (common[i], i)), np.int64)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        term = np.concatenate([np.array(t, np.int64) for t in items])
        item = np.repeat(place, [len(t) for t in items])
        self.sizes = (LEAF * FAN, LEAF, 1)
        self.holders = []
        for size in self.sizes:
            pairs = np.unique(np.stack([term, item // size], 1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))
            self.holders.append((starts, pairs[:, 1]))

    def nodes(self, level: int) -> int:
        return -(-self.n // self.sizes[level])

    def weakest(self, level: int, least: np.ndarray) -> np.ndarray:
        """The smallest of `least` (by place) in every node."""
        return np.minimum.reduceat(least, np.arange(0, self.n, self.sizes[level]))


def _maxima(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """The largest value per node and term."""
    by = np.lexsort((term, node))
    node, term, value = node[by], term[by], value[by]
    new = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])])
    return node[new], term[new], np.maximum.reduceat(value, new)


def _products(tree: ItemTree, level: int, node, term, value, alive: np.ndarray) -> np.ndarray:
    """Products of document nodes and item nodes where `alive`, 0 elsewhere."""
    out = np.zeros(alive.size, np.int64)
    some = alive.any(1)[node]
    node, term, value = node[some], term[some], value[some]
    starts, holder = tree.holders[level]
    count = starts[term + 1] - starts[term]
    value = value * tree.weights[term]
    ends = np.cumsum(count)
    lo = 0
    while lo < len(node):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + CELLS, "right")))
        c = count[lo:hi]
        shift = np.repeat(starts[term[lo:hi]] - (ends[lo:hi] - c - base), c)
        with_item = holder[np.arange(len(shift)) + shift]
        cell = np.repeat(node[lo:hi], c) * alive.shape[1] + with_item
        here = alive.ravel()[cell]
        np.add.at(out, cell[here], np.repeat(value[lo:hi], c)[here])
        lo = hi
    return out.reshape(alive.shape)


def search_batch(tree: ItemTree, doc, term, value, n_docs: int, least: np.ndarray):
    """(document, place of item, score) of every pair whose score is above 0 and not below `least` of the item.
    `doc`, `term`, `value` are the documents' entries. Also the number of pairs that were scored."""
    # Documents in the order of their strongest term, so that those below a node have terms in common.
    strength = value * tree.weights[term]
    by = np.lexsort((-strength, doc))
    first = np.flatnonzero(np.r_[True, doc[by][1:] != doc[by][:-1]])
    strongest = np.full(n_docs, -1)
    strongest[doc[by][first]] = term[by][first]
    order = np.argsort(strongest, kind="stable")
    place = np.empty(n_docs, np.int64)
    place[order] = np.arange(n_docs)
    at = place[doc]
    alive = None
    for level, size in enumerate((DOC_LEAF * DOC_FAN, DOC_LEAF, 1)):
        n_nodes, n_items = -(-n_docs // size), tree.nodes(level)
        if alive is None:
            alive = np.ones((n_nodes, n_items), bool)
        else:
            up = np.arange(n_nodes) * size // last[0], np.arange(n_items) * tree.sizes[level] // last[1]
            alive = alive[up[0]][:, up[1]]
        last = size, tree.sizes[level]
        scored = int(alive.sum())
        bound = _products(tree, level, *_maxima(at // size, term, value), alive)
        alive &= (bound > 0) & (bound >= tree.weakest(level, least))
    found = np.nonzero(alive)
    return order[found[0]], found[1], bound[found], scored


class Best:
    """The best k of every item among those seen."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least, k
        self.item = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.named = np.empty(0, bool)

    def add(self, item, score, ids, named) -> None:
        item, score = np.r_[self.item, item], np.r_[self.score, score]
        ids, named = np.r_[self.id, ids], np.r_[self.named, named]
        by = np.lexsort((ids, named, -score, item))
        item, score, ids, named = item[by], score[by], ids[by], named[by]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.least = self.least.copy()
        self.least[item[full]] = np.maximum(self.least[item[full]], score[full])
        keep = rank < self.k
        self.item, self.score, self.id, self.named = item[keep], score[keep], ids[keep], named[keep]


def search(table: DataFrame, tree: ItemTree, least: np.ndarray, n_docs: int, n_terms: int, k: int = TOP) -> DataFrame:
    """`item`, `score`, `id`: for each task the best k documents of every item, those below `least` (by item)
    left out. `table` is that of `document_terms`."""
    known = table.sparkSession.sparkContext.broadcast((tree, least))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, least = known.value
        best = Best(least[tree.order], k)
        step = max(DOC_LEAF, min(DOC_LEAF * DOC_FAN * 2, CELLS // tree.n))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.slice(start, step)
                ids = batch.column("id")
                lists = batch.column("terms")
                doc = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = batch.column("counts").flatten().to_numpy()
                m = 100 - 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
                value = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                row, item, score, _ = search_batch(tree, doc, term, value, len(batch), best.least)
                if len(row):
                    named = ids.is_valid().to_numpy(zero_copy_only=False)
                    best.add(item, score, ids.fill_null(0).to_numpy()[row], named[row])
        if len(best.item):
            ids = pa.array(best.id, pa.int64(), mask=~best.named)
            yield pa.record_batch([pa.array(tree.order[best.item]), pa.array(best.score), ids], ["item", "score", "id"])

    return table.where(F.size("terms") > 0).mapInArrow(run, "item long, score long, id long")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """`item_id`, `rank`, `doc_id`, `score`: the k highest-scoring documents of every item, scores above 0
    only, equal scores by ascending doc_id."""
    kind = items.schema["item_id"].dataType.simpleString()
    ranked = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items):
        if block:
            ranked = ranked.unionByName(_rank_block(docs, block, kind, k))
    return ranked


def _rank_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    names = spark.createDataFrame([(p, i) for p, (i, _) in enumerate(block)], f"item long, item_id {kind}")
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    table = document_terms(docs, vocabulary)
    per_level = {
        r.level: r for r in table.groupBy("level").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).collect()
    }
    n_docs = sum(r.docs for r in per_level.values())
    n_terms = sum(r.terms for r in per_level.values())
    holding = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        holding[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    tree = ItemTree([[vocabulary[t] for t in terms] for _, terms in block], weights)

    least = np.zeros(tree.n, np.int64)
    found = spark.createDataFrame([], "item long, rank int, score long, id long")
    levels, waiting = sorted(per_level, reverse=True), []
    for level in levels:
        waiting.append(level)
        if sum(per_level[x].docs for x in waiting) < FIRST and level != levels[-1]:
            continue
        near = search(table.where(F.col("level").isin(waiting)), tree, least, n_docs, n_terms, k)
        found = materialize(_best_of(found.drop("rank").unionByName(near), k), "best")
        for r in found.where(F.col("rank") == k).select("item", "score").collect():
            least[r.item] = r.score
        waiting = []
    named = found.join(F.broadcast(names), "item")
    return named.select("item_id", "rank", F.col("id").alias("doc_id"), "score")
