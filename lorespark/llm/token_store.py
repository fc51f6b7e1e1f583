"""Token ids of documents in a compressed store with one shared dictionary.

A store is a folder with two Parquet tables, so any file system that Spark knows can hold it and a lost task leaves
nothing half-written:

* ``dictionary``: one row, ``hash`` (first 16 bytes of its SHA-256) and ``content``: a zstandard dictionary trained on
  serialised id arrays of a bounded set of documents. It changes sizes only, never contents.
* ``shards``: ``part, seq, n_tokens, doc_ids, shard``. Documents are in ascending id order by (part, seq, place);
  documents with the same id in order of their text, null ids first.

A shard is: magic ``LTS1``; dictionary hash (16 bytes); item width in bytes (u32: 2 while the vocabulary fits, else 4);
number of documents (u32); tokens of the part before this shard (u64); then the offset index, a pair of u64 for each
document: where its frame begins after the index, and its number of tokens; then the frames. Every document has a
zstandard frame of its own, so one short document is read without its neighbours (:func:`read_documents`).

Whole texts are encoded with the ``tokenizers`` library, cut at ASCII white space, which no token crosses in the
vocabularies with word ends, each distinct piece once per batch of texts. Null texts count as empty; empty tables make
an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace, prepare
from lorespark.llm.words import gathered, held, slices, split_words

END_ID = 2
#: The dictionary is trained on so many documents at most (least hash of the id first), so many ids of each.
TRAINED_ON = 1000
TRAINED_IDS = 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHARD_BYTES = 2 << 20
MAGIC = b"LTS1"
HEAD = struct.Struct("<4s16sIIQ")
#: Pieces kept per Python worker; emptied when full, which changes nothing but speed.
KEEP = 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters of ASCII and Latin-1, in lower case as far as ASCII goes, and marks that may follow them at a piece's end.
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))
MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Words encoded in one call.
TOGETHER = 4096


class Encoder:
    """The library's ids of texts, with the ids of white-space pieces kept.

    Where the tokenizer lower-cases, ASCII is lower-cased before pieces are looked up; where its splitter parts letters
    from marks (tried at the start), a word and the marks after it are kept apart; where its words end in a token with a
    suffix of its own, new words are encoded in one text and told apart by that suffix. All this only saves calls.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.form = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = struct.calcsize(f"<{self.form}")
        self.marks = {t.content[:1] for t in self.tokenizer.get_added_tokens_decoder().values()}
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.folds = normalizer is not None and normalizer.normalize_str("AZ") == "az"
        self.trims = self.folds and splitter is not None and [w for w, _ in splitter.pre_tokenize_str("ab.!")] == ["ab", ".!"] and "<" in self.marks
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix and self.trims:
            self.ends[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.pieces: dict[bytes, bytes] = {}

    def _each(self, pieces: list[bytes]) -> Iterator[bytes]:
        for found in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False):
            yield struct.pack(f"<{len(ids := found.ids)}{self.form}", *ids)

    def _together(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of words of letters, encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, f"<u{self.width}")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
        if len(stops) != len(words):
            yield from self._each(words)
            return
        raw, at = ids.tobytes(), 0
        for stop in stops.tolist():
            yield raw[at:stop]
            at = stop

    def _learn(self, new: set[bytes]) -> None:
        apart, words, others = {}, set(), []
        for piece in new:
            word = piece.rstrip(MARKS) if self.trims else b""
            if word and LETTERS.issuperset(word.decode()):
                words.add(word)
                if len(word) < len(piece):
                    apart[piece] = word
            else:
                others.append(piece)
        plain = [w for w in words if w not in self.pieces]
        others += {piece[len(word) :] for piece, word in apart.items()} - self.pieces.keys()
        for listed, encode in ((plain, self._together if self.ends.any() else self._each), (others, self._each)):
            for at in range(0, len(listed), TOGETHER):
                some = listed[at : at + TOGETHER]
                self.pieces.update(zip(some, encode(some), strict=True))
        for piece, word in apart.items():
            self.pieces[piece] = self.pieces[word] + self.pieces[piece[len(word) :]]

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[bytes]:
        """The ids of each text as little-endian items of ``width`` bytes, the end id last."""
        tail = b"" if end is None else struct.pack(f"<{self.form}", end)
        # Lower case might make a special token of what is none.
        lower = self.folds and not any(pc.any(pc.match_substring(texts, mark)).as_py() for mark in self.marks)
        pieces, index, bounds = split_words(texts, lower)
        new = {p for p in pieces if p not in self.pieces}
        if len(self.pieces) + len(new) > KEEP:
            self.pieces.clear()
            new = set(pieces)
        self._learn(new)
        cells = [self.pieces[p] for p in pieces]
        ids, bounds = gathered(cells, f"<u{self.width}", index, bounds)
        bounds = bounds.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a:b].tobytes() + tail


def encoder(path: str) -> Encoder:
    return held(f"token_store:{path}", lambda: Encoder(path))


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def train_dictionary(source: DataFrame, path: str, end: int | None) -> bytes:
    """source: doc_id, text."""
    picked = source.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINED_ON).distinct()
    texts = source.join(F.broadcast(picked), "doc_id").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coder = encoder(path)
            ids = [i[: TRAINED_IDS * coder.width] for i in coder.encode(batch.column("text"), end)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = texts.mapInArrow(encode, "doc_id string, ids binary").orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(TRAINED_ON).collect()
    samples = [bytes(r.ids) for r in rows]
    if not any(samples):
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their plain contents serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _pack(key: bytes, width: int, before: int, frames: list[bytes], counts: list[int]) -> bytes:
    starts = np.concatenate(([0], np.cumsum([len(f) for f in frames])))[:-1]
    index = np.stack([starts, counts], axis=1).astype("<u8")
    return HEAD.pack(MAGIC, key, width, len(frames), before) + index.tobytes() + b"".join(frames)


class Shard:
    """A shard opened for reading."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, key, self.width, self.n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC or key != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError("not a shard of this dictionary")
        self.index = np.frombuffer(data, "<u8", 2 * self.n, HEAD.size).reshape(self.n, 2)
        self.frames = memoryview(data)[HEAD.size + 16 * self.n :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of its k-th document, reading that frame only."""
        end = int(self.index[k + 1, 0]) if k + 1 < self.n else len(self.frames)
        got = np.frombuffer(self.reader.decompress(self.frames[int(self.index[k, 0]) : end]), f"<u{self.width}")
        if len(got) != self.index[k, 1]:
            raise ValueError("a frame does not have the tokens that the index has")
        return got.astype("<u4")


def write_store(documents: DataFrame, folder: str, path: str | None = None, end: int | None = END_ID, id_column: str = "doc_id", text: str = "text") -> None:
    """Encode the documents and write the store (see the module docstring)."""
    spark = documents.sparkSession
    prepare(spark)
    where = path or default_path()
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    content = train_dictionary(source, where, end)
    key = hashlib.sha256(content).digest()[:16]
    spark.createDataFrame([(bytearray(key), bytearray(content))], "hash binary, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(content)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The text's beginning lets Spark split rows that share an id, or have none, among several ranges.
    places = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32).asc_nulls_first()
    ordered = source.repartitionByRange(parts, *places).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    id_type = pa.list_(pa.field("element", _arrow_type(source)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(where)
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        part = TaskContext.get().partitionId()
        seq = before = size = 0
        frames, counts, ids = [], [], []

        def shard() -> pa.RecordBatch:
            arrays = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(counts)], pa.int64()), pa.array([ids], id_type), pa.array([_pack(key, coder.width, before, frames, counts)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "seq", "n_tokens", "doc_ids", "shard"])

        for batch in slices(batches, "text"):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"), end), strict=True):
                frames.append(writer.compress(raw))
                counts.append(len(raw) // coder.width)
                ids.append(doc_id)
                size += len(frames[-1]) + 24
                if size >= SHARD_BYTES:
                    yield shard()
                    before += sum(counts)
                    seq, size, frames, counts, ids = seq + 1, 0, [], [], []
        if frames:
            yield shard()

    kind = source.schema["doc_id"].dataType.simpleString()
    ordered.mapInArrow(pack, f"part int, seq int, n_tokens bigint, doc_ids array<{kind}>, shard binary").write.parquet(f"{folder}/shards")


def _arrow_type(source: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(source.schema["doc_id"].dataType)


def _dictionary_of(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().content)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document, from the files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before; ids are little-endian 32-bit integers in a binary cell.
    """
    prepare(spark)
    dictionary = spark.sparkContext.broadcast(_dictionary_of(spark, folder))
    shards = spark.read.parquet(f"{folder}/shards")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(whole.num_rows):
                batch = whole.slice(at, 1)
                shard = Shard(batch.column("shard")[0].as_py(), dictionary.value)
                counts = shard.index[:, 1].astype(np.int64)
                starts = shard.before + np.cumsum(counts) - counts
                ids = [shard.ids(k).tobytes() for k in range(shard.n)]
                arrays = [batch.column("doc_ids").flatten(), batch.column("part").take(pa.array(np.zeros(shard.n, int))), pa.array(starts.astype(np.int64)), pa.array(counts), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "local", "n_tokens", "ids_crc32", "ids"])

    rows = shards.select("doc_ids", "part", "shard").mapInArrow(unpack, f"doc_id {kind}, part int, local bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    # A row per part of the store: as many as the writer had partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_documents(spark: SparkSession, folder: str, doc_ids: list) -> DataFrame:
    """``doc_id, ids`` of a few documents: only shards that list them are opened, only their frames decompressed."""
    prepare(spark)
    dictionary = spark.sparkContext.broadcast(_dictionary_of(spark, folder))
    shards = spark.read.parquet(f"{folder}/shards").select("doc_ids", "shard")
    kind = shards.schema["doc_ids"].dataType.elementType
    wanted = set(doc_ids)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("doc_ids").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                places = [k for k, i in enumerate(ids) if i in wanted]
                shard = Shard(data, dictionary.value)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in places], batch.schema.field("doc_ids").type.value_type), pa.array([shard.ids(k).tobytes() for k in places], pa.binary())], names=["doc_id", "ids"])

    has = F.arrays_overlap("doc_ids", F.array(*(F.lit(i).cast(kind) for i in wanted)))
    return shards.where(has).mapInArrow(fetch, f"doc_id {kind.simpleString()}, ids binary")


def op3(documents: DataFrame) -> DataFrame:
    """Write a store of all documents in the shared folder and report what its files hold."""
    spark = documents.sparkSession
    folder = Workspace(spark, "tokens").path("store")
    write_store(documents, folder)
    return read_store(spark, folder).drop("ids")
