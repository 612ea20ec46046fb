"""Token ids in binary files: Arrow IPC files of equal-length sequences and their masks.

A file holds record batches of BATCH sequences; a sequence is a fixed-size list of SEQUENCE ids with
a fixed-size list of SEQUENCE booleans, false where the last sequence of a file is filled up. The
n-th id of a file therefore stands at a place that follows from n alone, and a reader maps the
file and views the ids where they lie. Documents run on across sequences, each closed by END.

Documents are ranged by id over the tasks, and a task writes one file, so the files in order
hold the ids in ascending order of documents. The index (a Parquet table) says where each document
lies. A repeated attempt writes a file of another name; only files that the index names are part of the set.

Nulls: a null text is empty, a null id comes first. Repeated rows are documents of their own, one
after the other. Empty table: no files, an empty index. Strings of special tokens in a text become their ids, as the library
does by itself.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linktm.llm.text import rows_of
from linktm.scratch import full_uri, materialize, new_path

SEQUENCE = 2048
BATCH = 64
END = 0
# Entries in each half of a worker's cache of encoded words.
CACHE = 300_000
# Words longer than this are encoded each time.
CACHED_WORD = 64

# The characters with the Unicode property White_Space.
_WHITE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WIDE = re.compile(f"[{_WHITE}]{{2}}")
_UNIT = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_SIGNS = ".,;:!?()\"#$%&*<>|-"


class _Known(dict):
    """Ids of words, learnt when first asked for. When it is full it becomes the older half of the
    cache and begins anew, so words in use stay. Each word is looked up without `lead` and encoded with it."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead
        self.signs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._learn(word)
        if len(word) <= CACHED_WORD:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        # A byte-level BPE never joins letters with the signs behind them.
        stem = word.rstrip(_SIGNS)
        if stem and len(stem) < len(word) and stem[-1].isalpha():
            tail = word[len(stem) :]
            if tail not in self.signs:
                if len(self.signs) >= CACHE or len(tail) > CACHED_WORD:
                    return self[stem] + self.encode(tail)
                self.signs[tail] = self.encode(tail)
            return self[stem] + self.signs[tail]
        return self.encode(self.lead + word)


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as little-endian 16- or 32-bit
    integers. The tokenizer never joins a word with white space behind it, so texts are cut there
    and words are kept in bounded caches; the ids are those of the tokenizer on the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain = _Known(self._encode, "")
        self.spaced = _Known(self._encode, " ")
        self.line_end = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        if any(token in text for token in self.special):
            # Their strings become their ids and part the text around them.
            return self._encode(text)
        if _WIDE.search(text):
            # Runs of white space belong to the word behind them as a whole.
            return b"".join(map(plain, _UNIT.findall(text)))
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            if words[0]:
                out.append(plain(words[0]))
            del words[0]
            out += map(spaced, words)
            out.append(self.line_end)
        out.pop()
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_schema(kind: np.dtype) -> pa.Schema:
    ids = pa.list_(pa.from_numpy_dtype(kind), SEQUENCE)
    return pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), SEQUENCE))])


class _Writer:
    """Writes ids to one file batch by batch; holds at most one batch and one document."""

    def __init__(self, uri: str, kind: np.dtype):
        self.files, path = pa.fs.FileSystem.from_uri(uri)
        self.sink = self.files.open_output_stream(path)
        self.schema = file_schema(kind)
        self.kind = kind
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.open = bytearray()
        self.batch_bytes = BATCH * SEQUENCE * kind.itemsize

    def add(self, ids: bytes) -> None:
        self.open += ids
        while len(self.open) >= self.batch_bytes:
            self._write(bytes(self.open[: self.batch_bytes]))
            del self.open[: self.batch_bytes]

    def _write(self, ids: bytes) -> None:
        flat = np.frombuffer(ids, self.kind)
        n = -(-len(flat) // SEQUENCE) * SEQUENCE
        full = np.zeros(n, self.kind)
        full[: len(flat)] = flat
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(full), SEQUENCE),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n) < len(flat)), SEQUENCE),
        ]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.open:
            self._write(bytes(self.open))
        self.file.close()
        self.sink.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write the ids of all texts below `folder` and return the index, a row per row of `docs`:
    `doc_id`, `file`, `part` (order of the files), `place` (first id within the file) and `n_tokens`.
    `folder` must be a URI that the tasks' file systems can open, and shared by them."""
    rows = rows_of(docs).select("id", "text", "version")
    ranged = rows.repartitionByRange("id", "version").sortWithinPartitions("id", "version")
    numbered = ranged.select("id", "text", F.spark_partition_id().alias("part"))
    kind = rows.schema["id"].dataType.simpleString()
    end = END

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        closing = np.array([end], encode.kind).tobytes()
        out = None
        place = 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                name = f"part-{batch.column('part')[0].as_py():06d}-{uuid.uuid4().hex}.arrow"
                out = _Writer(f"{folder}/{name}", encode.kind)
            places, sizes = [], []
            for text in batch.column("text"):
                ids = encode.encode(text.as_py()) + closing
                out.add(ids)
                places.append(place)
                sizes.append(len(ids) // encode.kind.itemsize)
                place += sizes[-1]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([name] * len(batch)),
                    batch.column("part"),
                    pa.array(places, pa.int64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "file", "part", "place", "n_tokens"],
            )
        if out is not None:
            out.close()

    index = numbered.mapInArrow(
        write, f"doc_id {kind}, file string, part int, place long, n_tokens long"
    )
    return materialize(index, "token-index")


class TokenFile:
    """Random access to the ids of one file. On a local file system nothing is copied."""

    def __init__(self, uri: str):
        files, path = pa.fs.FileSystem.from_uri(uri)
        if files.type_name == "local":
            self.source = pa.memory_map(path)
        else:
            self.source = files.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.batches: dict[int, np.ndarray] = {}

    def _batch(self, number: int) -> np.ndarray:
        if number not in self.batches:
            self.batches = {number: self.file.get_batch(number).column("ids").flatten().to_numpy()}
        return self.batches[number]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch = self.file.get_batch(number // BATCH)
        at = number % BATCH
        ids, mask = (batch.column(c)[at].values for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def pieces(self, place: int, n: int) -> Iterator[np.ndarray]:
        """Ids place..place+n, one view per record batch."""
        size = BATCH * SEQUENCE
        while n > 0:
            at = place % size
            view = self._batch(place // size)[at : at + n]
            yield view
            place += len(view)
            n -= len(view)


def starts(index: DataFrame) -> DataFrame:
    """The index with `start`: ids of all documents before. Files are summed, a row each."""
    per_file = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("total"))
    ordered = Window.orderBy("part", "file")
    before = per_file.select("file", (F.sum("total").over(ordered) - F.col("total")).alias("before"))
    return index.join(before, "file").withColumn("start", F.col("before") + F.col("place")).drop("before")


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """The index with `ids_crc32`, the unsigned CRC-32 of each document's ids as 32-bit
    little-endian integers, read back from the files. Rows come file by file and in their order there."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            sums = []
            for file, place, n in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "n_tokens"))):
                if file != name:
                    name, source = file, TokenFile(f"{folder}/{file}")
                crc = 0
                for view in source.pieces(place, n):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.record_batch(
                [*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "ids_crc32"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    near = index.repartitionByRange("file", "place").sortWithinPartitions("file", "place")
    return near.mapInArrow(read, f"{fields}, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    path = new_path(spark, "tokens")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return full_uri(spark, path)
