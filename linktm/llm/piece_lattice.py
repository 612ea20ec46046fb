"""SentencePiece encoding and decoding over a relational lattice of words.

Texts are cut into words at places that no piece of the model spans: before white space, and
between letters and other characters. The different words of all texts become a table; their
substrings of bounded length are exploded and equi-joined to the piece table, the matching edges are
grouped by word, and a higher-order aggregate folds each word's edges into its cuts, a bit mask. Documents
then take the cuts of their words: those of the HOT most frequent words are sent to the tasks, all
others are joined by word, so that a text moves once, as compressed ids.

Two folds: for a unigram model the Viterbi recursion over the edges in order of their end. For a BPE
model, where the highest sum of scores is not what the model means, the edges in order of their rank,
each joining two neighbours that it spans at that time; as no piece ranks before its parts, that
is the model's own encoding. Words above LONGEST characters go through the model's library.

Nulls: a null text is empty and has no pieces. Repeated rows get equal ids. Empty table: no rows.
U+2581, the model's sign for a space, decodes as a space, as with the model itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktm.llm.frequent import most_frequent
from linktm.llm.text import rows_of
from linktm.scratch import materialize

SPACE = "▁"
HOT = 400_000
# Characters of a word in the lattice: its cuts are the bits of one long.
LONGEST = 60
# Entries of a worker's tables of words.
CACHE = 300_000
# Fixed value: the first of the 256 byte pieces' names, `<0x00>` to `<0xFF>`.
_BYTE = "<0x%02X>"
# Words of the lattice per task and shuffle partition.
_SPREAD = 4
# Stands in a sequence for a word whose cuts come by the join; its number follows in two halves.
_HOLE = 0xFFFF

# A run of spaces with the letters, or with the other characters, behind it.
_WORD = re.compile(r"▁*[^\W\d_]+|▁*(?:[^▁\w]+|[\d_]+)+|▁+")


@dataclass
class Pieces:
    """Piece table of a model file: ordinary pieces with their scores, byte pieces, and the kind."""

    path: str
    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    longest: int
    names: list[bytes] = field(default_factory=list)

    def cut(self, word: str, mask: int) -> bytes:
        """Ids of a word's pieces, as 16-bit integers."""
        out: list[int] = []
        begin = 0
        for end in range(1, len(word) + 1):
            if mask >> end & 1:
                piece = word[begin:end]
                found = self.ids.get(piece)
                if found is not None:
                    out.append(found)
                elif self.byte_ids:
                    out += [self.byte_ids[b] for b in piece.encode()]
                else:
                    out.append(self.unknown)
                begin = end
        return np.array(out, "<u2").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.names.__getitem__, ids.tolist())).decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2

    model = library(path)
    size = len(model)
    if size >= _HOLE:
        raise ValueError("ids above 16 bits are not supported")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    if proto.normalizer_spec.name != "identity" or not proto.normalizer_spec.add_dummy_prefix:
        raise ValueError("only models with the identity normaliser and a space before each text")
    names = [model.id_to_piece(i) for i in range(size)]
    byte_of = {_BYTE % b: b for b in range(256)}
    plain = [
        i
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    for i in plain:
        rest = names[i].lstrip(SPACE)
        if SPACE in rest or any(c.isalpha() for c in rest) and not rest.isalpha():
            raise ValueError(f"piece {names[i]!r} spans a place where words are cut")
    return Pieces(
        path,
        {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type],
        {names[i]: i for i in plain},
        {names[i]: model.get_score(i) for i in plain},
        [names.index(n) for n in byte_of] if model.is_byte(names.index(_BYTE % 0) if _BYTE % 0 in names else 0) else [],
        model.unk_id(),
        max(len(names[i]) for i in plain),
        [
            bytes([byte_of[n]]) if model.is_byte(i) else b"" if model.is_control(i) else n.encode()
            for i, n in enumerate(names)
        ],
    )


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []


def text_words(docs: DataFrame) -> DataFrame:
    """`word`, `n` of all texts, words of at most LONGEST characters. Each task sums in a table of bounded size."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flush(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
        counts.clear()
        return pa.record_batch([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], schema=schema)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(split_words(text.as_py()))
                if len(counts) > CACHE:
                    yield flush(counts)
        yield flush(counts)

    parts = _SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """`piece`, `score`; as long as the model's vocabulary."""
    rows = [(p, float(s)) for p, s in pieces.scores.items()]
    return spark.createDataFrame(rows, "piece string, score double")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """`word`, `n`, `edges` (score, start, length) of the pieces in each word. Words are
    dealt out once, and the groups are formed where they already are."""
    shortest = 1 if pieces.kind == "unigram" else 2
    size = F.char_length("word")
    starts = F.sequence(F.lit(0), size - shortest)
    spans = F.flatten(
        F.transform(
            F.when(size >= shortest, starts),
            lambda s: F.transform(
                F.sequence(F.lit(shortest), F.least(size - s, F.lit(pieces.longest))),
                lambda k: F.struct(s.alias("start"), k.alias("length")),
            ),
        )
    )
    each = words.select("word", "n", F.explode_outer(spans).alias("span")).select(
        "word", "n", "span.start", "span.length"
    )
    cut = each.withColumn("piece", F.substring("word", F.col("start") + 1, F.col("length")))
    # The vocabulary of a model bounds the size of its piece table.
    met = cut.join(F.broadcast(piece_table(words.sparkSession, pieces)), "piece", "left")
    found = F.col("score").isNotNull()
    if pieces.kind == "unigram":
        # A character without a piece is an edge below every piece.
        least = min(pieces.scores.values()) - 10
        met = met.withColumn("score", F.when(found | (F.col("length") > 1), F.col("score")).otherwise(least))
        found = F.col("score").isNotNull()
    first = F.col("start").isNull() | ((F.col("start") == 0) & (F.col("length") == shortest))
    edge = F.when(found, F.struct("score", "start", "length"))
    return met.where(found | first).groupBy("word").agg(
        F.max("n").alias("n"), F.collect_list(edge).alias("edges")
    )


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def merged(size: Column, edges: Column) -> Column:
    """Cuts of a word under a BPE model: its edges in order of rank (equal ones from the left), each
    removing the cut inside it when it begins and ends at cuts and has just one between."""
    ordered = F.sort_array(
        F.transform(
            edges, lambda e: F.struct((-e["score"]).alias("rank"), e["start"].alias("start"), e["length"].alias("length"))
        )
    )

    def step(mask: Column, e: Column) -> Column:
        begin, end = _bit(e["start"]), _bit(e["start"] + e["length"])
        inside = mask.bitwiseAND(end - begin - begin)
        ends = begin.bitwiseOR(end)
        joins = (mask.bitwiseAND(ends) == ends) & (F.bit_count(inside) == 1)
        return F.when(joins, mask - inside).otherwise(mask)

    return F.aggregate(ordered, _bit(size + 1) - 1, step)


def best_path(size: Column, edges: Column) -> Column:
    """Cuts of a word under a unigram model: the path with the highest sum of scores (Viterbi)."""

    def step(acc: Column, end: Column) -> Column:
        here = F.filter(edges, lambda e: e["start"] + e["length"] == end)
        paths = F.transform(
            here,
            lambda e: F.struct(
                (F.get(acc, e["start"])["score"] + e["score"]).alias("score"),
                F.get(acc, e["start"])["mask"].bitwiseOR(_bit(end)).alias("mask"),
            ),
        )
        return F.concat(acc, F.array(F.array_max(paths)))

    empty = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("mask")))
    return F.aggregate(F.sequence(F.lit(1), size), empty, step, lambda acc: F.get(acc, size)["mask"])


def word_cuts(words: DataFrame, pieces: Pieces) -> DataFrame:
    """`word`, `n`, `mask`: bit i is set where a piece begins or ends at character i."""
    fold = best_path if pieces.kind == "unigram" else merged
    size = F.char_length("word")
    return lattice(words, pieces).select("word", "n", fold(size, F.col("edges")).alias("mask"))


class _Ids(dict):
    """Ids of words by their cuts, None for words without; a table of bounded size in front of the hot words' cuts."""

    def __init__(self, masks: dict[str, int], pieces: Pieces):
        super().__init__()
        self.masks, self.pieces = masks, pieces

    def __missing__(self, word: str) -> bytes | None:
        mask = self.masks.get(word)
        if mask is not None:
            ids = self.pieces.cut(word, mask)
        elif len(word) <= LONGEST:
            return None
        else:
            ids = _by_library(word, self.pieces.path)
            return ids
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


def _by_library(word: str, path: str) -> bytes:
    """Ids of an over-long word: the library puts a space before a text, here one before an extra line end,
    which is a piece of its own or bytes and never joins the word."""
    model = library(path)
    lead = model.encode("\n")
    return np.array(model.encode("\n" + word)[len(lead) :], "<u2").tobytes()


def _sequences(docs: DataFrame, path: str, hot, wanted: str) -> DataFrame:
    """Per row: `id`, `version` and either `rest`, its different words without cuts here in order, or
    `packed`, its compressed ids with holes for them, and `n_bytes`, `text_crc` of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pieces = load_pieces(path)
        known = _Ids(hot.value, pieces)
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rests, packed, sizes, sums = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                words = split_words(text)
                found = list(map(known.__getitem__, words))
                rest: dict[str, int] = {}
                if None in found:
                    for i, ids in enumerate(found):
                        if ids is None:
                            at = rest.setdefault(words[i], len(rest))
                            found[i] = np.array([_HOLE, at & 0xFFFF, at >> 16], "<u2").tobytes()
                if wanted == "rest":
                    rests.append(list(rest))
                else:
                    raw = text.replace(SPACE, " ").encode()
                    packed.append(pack(b"".join(found)))
                    sizes.append(len(raw))
                    sums.append(zlib.crc32(raw))
            keys = [batch.column("id"), batch.column("version")]
            if wanted == "rest":
                yield pa.record_batch([*keys, pa.array(rests, pa.list_(pa.string()))], ["id", "version", "rest"])
            else:
                columns = [pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.record_batch([*keys, *columns], ["id", "version", "packed", "n_bytes", "text_crc"])

    rows = rows_of(docs)
    kind = rows.schema["id"].dataType.simpleString()
    fields = "rest array<string>" if wanted == "rest" else "packed binary, n_bytes long, text_crc long"
    return rows.mapInArrow(run, f"id {kind}, version long, {fields}")


def _filled(packed: bytes, fills: dict[int, bytes]) -> np.ndarray:
    import zstandard

    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<u2")
    holes = np.flatnonzero(ids == _HOLE)
    if not len(holes):
        return ids
    # The number behind a hole may look like a hole itself.
    parts, begin = [], 0
    for at in holes.tolist():
        if at < begin:
            continue
        parts.append(ids[begin:at])
        parts.append(np.frombuffer(fills[int(ids[at + 1]) | int(ids[at + 2]) << 16], "<u2"))
        begin = at + 3
    parts.append(ids[begin:])
    return np.concatenate(parts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """A row per row of `docs`: `doc_id`, `pieces` (array of ids), `n_pieces`, `ids_crc32` (of the ids as
    32-bit little-endian integers) and `round_trip`, whether the ids decode to the text."""
    spark = docs.sparkSession
    pieces = load_pieces(path)
    cuts = materialize(word_cuts(text_words(docs), pieces), "word-cuts")
    top = most_frequent(cuts, HOT).select("word", "mask").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("mask").to_pylist())))
    rest = _sequences(docs, path, hot, "rest").select(
        "id", "version", F.posexplode("rest").alias("k", "word")
    )
    fills = (
        rest.join(cuts.select("word", "mask"), "word")
        .groupBy("id", "version")
        .agg(F.collect_set(F.struct("k", "word", "mask")).alias("fills"))
    )
    packed = _sequences(docs, path, hot, "packed")
    joined = packed.join(
        fills.withColumnsRenamed({"id": "i", "version": "v"}),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")),
        "left",
    ).select("id", "packed", "n_bytes", "text_crc", "fills")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_pieces(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                each = zip(*(part.column(c) for c in ("packed", "n_bytes", "text_crc", "fills")))
                lists, sums, same = [], [], []
                for packed, n_bytes, text_crc, fills in each:
                    ids = _filled(
                        packed.as_py(), {f["k"]: table.cut(f["word"], f["mask"]) for f in fills.as_py() or ()}
                    )
                    back = table.decode(ids).encode()
                    lists.append(ids.astype(np.int32))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    same.append(len(back) == n_bytes.as_py() and zlib.crc32(back) == text_crc.as_py())
                sizes = np.array([len(x) for x in lists], np.int64)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
                flat = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int32))
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array(sizes),
                        pa.array(sums, pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "pieces", "n_pieces", "ids_crc32", "round_trip"],
                )

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(
        fill, f"doc_id {kind}, pieces array<int>, n_pieces long, ids_crc32 long, round_trip boolean"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id`, `text` of rows with `doc_id` and `pieces`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_pieces(path)
        for batch in batches:
            texts = [table.decode(np.array(p.as_py() or [], np.int64)) for p in batch.column("pieces")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")
