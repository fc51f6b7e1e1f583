"""Media columns: content-defined chunks, stored once each, and rebuilt by ordered chunk lists.

A payload is a text's UTF-8 bytes, zeros appended up to a positive multiple of 64: 8-bit samples. A rolling gear hash of
the last 32 bytes cuts it into chunks of ``LEAST`` to ``MOST`` bytes, so equal passages give equal chunks wherever they
stand. Chunk bytes are kept once in the whole table:

1. Payloads are named by a digest of their text; equal payloads are one item, whatever ids their rows have.
2. Chunk digests of all items are grouped; each has one home, the least item that has it. Joins tell every item which
   of its chunks have their home elsewhere, and which of its own others need.
3. Texts, compressed, are dealt by item, repeated ones dropped before the shuffle, and meet their item's notes there.
   Items are written as rows of a Parquet table: ordered chunk list (length and digest of every chunk), own chunks (one
   zstandard frame), chunks that others need too (a frame each, by digest). There is one plan for every size.
4. Reading back, only chunks with their home elsewhere move: they are joined by digest and gathered per item. Every
   chunk is checked against its digest, every payload against its length.

The stored form of a payload is what its item's row holds: chunk list, frame of own chunks, frames of needed chunks. A
chunk that an earlier item holds is counted there only.

Null texts count as empty. Repeated rows, also with null ids, get equal values. Very long texts are cut whole in one
task. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace, prepare, text_version
from lorespark.llm.words import slices

UNIT = 64
LEAST, MOST = 512, 8192
#: A cut where these bits of the hash are zero: every 1024 bytes on average.
CUT_BITS = np.uint32(0xFFC00000)
GEAR = np.random.default_rng(20240608).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
DIGEST = 16
#: zstandard levels of texts on their way and of chunks that stay.
PASSING, STAYING = 6, 9


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At every byte, the sum of the gear values of the last 32 bytes, each shifted left by its distance."""
    out = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        more = out.copy()
        more[reach:] += out[:-reach] << np.uint32(reach)
        out = more
    return out


def cut(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload. As none is shorter than the hash's window, payloads don't influence each other."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear_hashes(joined) & CUT_BITS == 0) + 1
    out, offset = [], 0
    for payload in payloads:
        inside = (marks[np.searchsorted(marks, offset) : np.searchsorted(marks, offset + len(payload))] - offset).tolist()
        chunks, at = [], 0
        for mark in [*inside, len(payload)]:
            while mark - at > MOST:
                chunks.append(payload[at : at + MOST])
                at += MOST
            if mark - at >= LEAST or mark == len(payload):
                chunks.append(payload[at:mark])
                at = mark
        out.append([c for c in chunks if c])
        offset += len(payload)
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def _list_of(chunks: list[bytes]) -> bytes:
    return b"".join(len(c).to_bytes(4, "little") + digest_of(c) for c in chunks)


def _entries(chunk_list: bytes) -> list[tuple[int, bytes]]:
    step = 4 + DIGEST
    return [(int.from_bytes(chunk_list[k : k + 4], "little"), chunk_list[k + 4 : k + step]) for k in range(0, len(chunk_list), step)]


def _source(documents: DataFrame, text: str) -> DataFrame:
    value = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return value.select(text_version().alias("item"), "text")


def chunk_lists(source: DataFrame) -> DataFrame:
    """``item, list`` of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = [_list_of(c) for c in cut([payload_of(t) for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(lists, pa.binary())], names=["item", "list"])

    return source.mapInArrow(describe, "item binary, list binary")


def _digests(lists: DataFrame) -> DataFrame:
    """``item, digest``: the distinct chunks of each item."""
    step = 4 + DIGEST
    places = F.sequence(F.lit(0), (F.length("list") / step).cast("int") - 1)
    each = F.array_distinct(F.transform(places, lambda k: F.substring(F.col("list"), k * step + 5, F.lit(DIGEST))))
    return lists.select("item", F.explode(each).alias("digest"))


def _notes(source: DataFrame, work: Workspace) -> DataFrame:
    """``item, elsewhere, needed`` (sorted) for items that share chunks with others."""
    digests = work.write(_digests(chunk_lists(source).distinct()), "digests")
    homes = work.write(digests.groupBy("digest").agg(F.min("item").alias("home"), F.count("*").alias("n")).where("n > 1").select("digest", "home"), "homes")
    shared = digests.join(homes, "digest").groupBy("item").agg(
        F.sort_array(F.collect_list(F.when(F.col("item") != F.col("home"), F.col("digest")))).alias("elsewhere"),
        F.sort_array(F.collect_list(F.when(F.col("item") == F.col("home"), F.col("digest")))).alias("needed"),
    )
    notes = work.write(shared, "notes")
    work.drop("digests", "homes")
    return notes


def write_media(documents: DataFrame, folder: str, text: str = "text") -> None:
    """Write the table of items."""
    prepare(documents.sparkSession)
    work = Workspace(documents.sparkSession, "chunks")
    source = _source(documents, text)
    notes = _notes(source, work)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=PASSING).compress
        for batch in slices(batches, "text"):
            frames = [squeeze(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(frames, pa.binary())], names=["item", "pressed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=STAYING).compress, zstandard.ZstdDecompressor().decompress
        schema = pa.schema([("item", pa.binary()), ("list", pa.binary()), ("own", pa.binary()), ("elsewhere", pa.list_(pa.binary())), ("needed", pa.list_(pa.struct([("digest", pa.binary()), ("chunk", pa.binary())])))])
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for item, pressed, elsewhere, needed in zip(*(batch.column(c).to_pylist() for c in ("item", "pressed", "elsewhere", "needed")), strict=True):
                    (chunks,) = cut([payload_of(expand(pressed).decode())])
                    found = {digest_of(c): c for c in chunks}
                    apart = {*(elsewhere or ()), *(needed or ())}
                    own = b"".join(c for d, c in found.items() if d not in apart)
                    rows.append((item, _list_of(chunks), squeeze(own), elsewhere or [], [{"digest": d, "chunk": squeeze(found[d])} for d in needed or ()]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kept = source.mapInArrow(press, "item binary, pressed binary").dropDuplicates(["item"]).join(notes, "item", "left")
    made = kept.select("item", "pressed", "elsewhere", "needed").mapInArrow(pack, "item binary, list binary, own binary, elsewhere array<binary>, needed array<struct<digest: binary, chunk: binary>>")
    made.write.option("compression", "uncompressed").parquet(folder)
    work.drop("notes")


def rebuild(chunk_list: bytes, own: bytes, needed: list[dict], fetched: list[dict]) -> bytes:
    """The payload of an item from its stored parts; raises where a chunk is missing or damaged."""
    expand = zstandard.ZstdDecompressor().decompress
    chunks = {bytes(x["digest"]): expand(x["chunk"]) for x in [*needed, *fetched]}
    rest, at = expand(own), 0
    for length, digest in _entries(chunk_list):
        if digest not in chunks:
            chunks[digest] = rest[at : at + length]
            at += length
    payload = []
    for length, digest in _entries(chunk_list):
        chunk = chunks[digest]
        if len(chunk) != length or digest_of(chunk) != digest:
            raise ValueError("a chunk differs from its digest")
        payload.append(chunk)
    return b"".join(payload)


def read_media(stored: DataFrame, extract, schema: str) -> DataFrame:
    """``item`` and what ``extract(row, payload)`` makes of each payload that the table ``stored`` holds; row: the stored
    chunk list, own frame and needed chunks."""
    prepare(stored.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]
    wanted = stored.select("item", F.explode("elsewhere").alias("digest"))
    offered = stored.select(F.explode("needed").alias("x")).select("x.digest", "x.chunk")
    moved = wanted.join(offered, "digest").groupBy("item").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    none = F.array().cast("array<struct<digest: binary, chunk: binary>>")
    columns = ["item", "list", "own", "needed", "fetched"]
    whole = stored.where(F.size("elsewhere") == 0).withColumn("fetched", none).select(columns)
    partial = stored.where(F.size("elsewhere") > 0).join(moved, "item").select(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                rows = []
                for item, chunk_list, own, needed, fetched in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    rows.append((item, *extract((chunk_list, own, needed), rebuild(chunk_list, own, needed, fetched))))
                frame = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(frame[0], pa.binary()), *map(pa.array, frame[1:])], names=["item", *names])

    return whole.union(partial).mapInArrow(read, f"item binary, {schema}")


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def features_of(row: tuple[bytes, bytes, list[dict]], payload: bytes) -> tuple:
    """Length and digests of the payload and of its stored form, and a summary of the samples: chunks, distinct values,
    mean and entropy in thousandths."""
    chunk_list, own, needed = row
    media = b"".join([chunk_list, own, *(x["chunk"] for x in needed)])
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    entropy = round(float(-(share * np.log2(share)).sum()) * 1000)
    mean = int(counts @ np.arange(256)) * 1000 // len(payload)
    feature = f"chunks={len(chunk_list) // (4 + DIGEST)};values={int((counts > 0).sum())};mean={mean};entropy={entropy}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op8(documents: DataFrame) -> DataFrame:
    """Write all payloads as media, read them back, and report what the stored bytes hold."""
    spark = documents.sparkSession
    work = Workspace(spark, "media")
    write_media(documents, work.path("items"))
    read = work.write(read_media(spark.read.parquet(work.path("items")), features_of, FEATURES), "features")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = documents.select("doc_id", text.alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), text_version().alias("item"))
    return sizes.join(read, "item").drop("item")
