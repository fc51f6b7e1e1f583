"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where they agree.

A text longer than a chunk and its overlap is cut into chunks of ``chunk`` code points, each read ``overlap`` further into
the next. Chunks are dealt over the cluster and encoded with offsets. At the seam of two chunks both encodings cover the
overlap: they are spliced at the first *stable* boundary that both have there, and the text's count is the sum of what
each chunk has between its splices. A text with a seam without such a boundary is cut again with an overlap four times as
wide (and chunks at least as long), until every seam aligns or the text is one chunk.

A boundary is stable if the library provably gives the same tokens before it whatever follows, and after it whatever
precedes:

* word_bpe_49k.json and files of its kind (:data:`lorespark.llm.bpe.FORM`): the start of a piece after ASCII white space.
  Nothing composes with ASCII white space, no word of the splitter holds it, and words are encoded one by one. Distinct
  pieces are encoded by the library once and kept.
* other files of the tokenizers library, if their steps are in :data:`LOCAL_STEPS`: the start of a splitter's word in both
  encodings, so that the splitter, which looks ahead one character at most, has started anew there in both; the character
  there must not compose with one before it, nor may a special token still be open at the left chunk's end.
* sentencepiece models none of whose pieces holds a space after another character: a single space before a letter or digit.
* any other file: no boundary; overlaps widen until the text is encoded whole.

Null counts as empty text; repeated rows give repeated results; columns other than the text are kept, those that clash
with the new ones (whatever their case) give way. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.bpe import default_path, is_walkable
from lorespark.llm.scratch import Workspace, fresh, prepare
from lorespark.llm.words import held, slices, split_words

CHUNK = 16_384
OVERLAP = 256
LIMIT = 2048
#: Counts of pieces kept per Python worker; emptied when full, which changes nothing but speed.
KEEP = 400_000
#: Steps of a tokenizer file that look at no more than the neighbouring character. Fixed values of the file format.
LOCAL_STEPS = {"NFC", "Lowercase", "Replace", "Split", "ByteLevel", "Whitespace", "WhitespaceSplit", "Digits", "Punctuation"}

#: (stable boundaries as code points in the chunk, tokens before each, tokens in all)
Edges = tuple[np.ndarray, np.ndarray, int]
PIECE_START = re.compile(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]")
NOTHING = np.zeros(0, np.int64)


class PieceCounter:
    """Counts by distinct white-space pieces, for files of the walkable kind."""

    def __init__(self, library):
        self.library = library
        self.known: dict[bytes, int] = {}

    def counts(self, texts: pa.Array) -> np.ndarray:
        pieces, index, bounds = split_words(texts)
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
            new = pieces
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            found = self.library.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            self.known.update(zip(some, map(len, found), strict=True))
        each = np.array([self.known[p] for p in pieces], np.int64)
        return np.diff(np.concatenate(([0], np.cumsum(each[index])))[bounds])

    def edges(self, chunks: list[str], zones: list[list[tuple[int, int]]]) -> list[Edges]:
        """zones: per chunk, where boundaries are asked for."""
        starts = [sorted({m.start() for a, b in asked for m in PIECE_START.finditer(chunk, a, b)}) for chunk, asked in zip(chunks, zones, strict=True)]
        parts = [chunk[a:b] for chunk, cuts in zip(chunks, starts, strict=True) for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
        counts, out, at = self.counts(pa.array(parts, pa.large_string())), [], 0
        for cuts in starts:
            ends = np.cumsum(counts[at : at + len(cuts) + 1])
            at += len(cuts) + 1
            out.append((np.array(cuts, np.int64), ends[:-1], int(ends[-1])))
        return out


def _composed_after() -> set[str]:
    """Characters that can be put together with one before them, by Unicode's decompositions."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return seconds | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A7, 0x11C3)]}  # Hangul vowels and finals


class LibraryCounter:
    """Counts by a file of the tokenizers library, whatever its kind."""

    def __init__(self, library, config: dict):
        self.library = library
        self.margin = max([len(t["content"]) for t in config["added_tokens"]], default=0) + 2
        steps = [s for key in ("normalizer", "pre_tokenizer") for s in _steps(config.get(key))]
        self.local = bool(config.get("pre_tokenizer")) and all(s["type"] in LOCAL_STEPS and not s.get("add_prefix_space") for s in steps)
        self.local &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"])
        self.seconds = _composed_after() if self.local else set()

    def counts(self, texts: pa.Array) -> np.ndarray:
        found = self.library.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return np.array([len(e) for e in found], np.int64)

    def edges(self, chunks: list[str], zones: list[list[tuple[int, int]]]) -> list[Edges]:
        return [self._edges(e, c) for e, c in zip(self.library.encode_batch(chunks, add_special_tokens=False), chunks, strict=True)]

    def _edges(self, encoding, chunk: str) -> Edges:
        if not self.local:
            return NOTHING, NOTHING, len(encoding)
        found, before = [], []
        words, offsets = encoding.word_ids, encoding.offsets
        for k in range(1, len(words)):
            at = offsets[k][0]
            if words[k] != words[k - 1] and offsets[k - 1][1] <= at <= len(chunk) - self.margin and not (chunk[at - 1 : at + 1].isspace() or unicodedata.combining(chunk[at]) or chunk[at] in self.seconds):
                found.append(at)
                before.append(k)
        return np.array(found, np.int64), np.array(before, np.int64), len(words)


def _steps(step: dict | None) -> Iterator[dict]:
    if step:
        inner = step.get("normalizers") or step.get("pretokenizers")
        yield from (s for i in inner for s in _steps(i)) if step["type"] == "Sequence" else [step]


class PieceModelCounter:
    """Counts by a sentencepiece model."""

    SPACE = "▁"

    def __init__(self, model):
        self.model = model
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.local = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(i) for i in self.model.encode([t or "" for t in texts.to_pylist()], num_threads=1)], np.int64)

    def edges(self, chunks: list[str], zones: list[list[tuple[int, int]]]) -> list[Edges]:
        return [self._edges(c) for c in chunks]

    def _edges(self, chunk: str) -> Edges:
        # The library's offsets count bytes of UTF-8.
        starts = np.cumsum((np.frombuffer(chunk.encode(), np.uint8) & 0xC0) != 0x80)
        begins = [int(starts[p.begin]) - 1 if p.begin < len(starts) else len(chunk) for p in self.model.encode(chunk, out_type="proto").pieces]
        good = [k for k in range(1, len(begins)) if self.local and begins[k] > begins[k - 1] and self._apart(chunk, begins[k])]
        return np.array([begins[k] for k in good], np.int64), np.array(good, np.int64), len(begins)

    @staticmethod
    def _apart(chunk: str, at: int) -> bool:
        return chunk[at : at + 1] == " " and not chunk[at - 1].isspace() and at + 1 < len(chunk) and chunk[at + 1].isascii() and chunk[at + 1].isalnum()


Counter = PieceCounter | LibraryCounter | PieceModelCounter


def _counter(path: str) -> Counter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return PieceModelCounter(sentencepiece.SentencePieceProcessor(model_file=path))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    return PieceCounter(library) if is_walkable(config) else LibraryCounter(library, config)


def counter(path: str) -> Counter:
    return held(f"token_count:{path}", lambda: _counter(path))


EDGES = "key binary, seam int, total bigint, right struct<at:array<int>,before:array<bigint>>, left struct<at:array<int>,before:array<bigint>>"
_EDGE = pa.struct([("at", pa.list_(pa.int32())), ("before", pa.list_(pa.int64()))])
_EDGE_ROWS = pa.schema([("key", pa.binary()), ("seam", pa.int32()), ("total", pa.int64()), ("right", _EDGE), ("left", _EDGE)])
PIECES = "key binary, part int, last boolean, piece string"
_PIECE_ROWS = pa.schema([("key", pa.binary()), ("part", pa.int32()), ("last", pa.bool_()), ("piece", pa.string())])


def _cut(chunk: int, overlap: int):
    """Chunks of whole texts, named by the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                key, parts, rows = hashlib.sha256(text.encode()).digest(), max(1, -(-(len(text) - overlap) // chunk)), []
                for part in range(parts):
                    last = part == parts - 1
                    rows.append({"key": key, "part": part, "last": last, "piece": text[part * chunk : None if last else (part + 1) * chunk + overlap]})
                    if last or len(rows) * (chunk + overlap) > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _PIECE_ROWS)
                        rows = []

    return run


def _edge(edges: Edges, begin: int, end: int) -> dict:
    at, before, _ = edges
    here = (at >= begin) & (at < end)
    return {"at": at[here] - begin, "before": before[here]}


def _encode(path: str, chunk: int, overlap: int):
    """Each chunk's row for the seam on its left and for that on its right; a last chunk's for its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = counter(path)
        for batch in slices(batches, "piece", 1 << 20):
            rows = batch.select(["key", "part", "last"]).to_pylist()
            texts = batch.column("piece").to_pylist()
            zones = [[(0, overlap)] * (r["part"] > 0) + [(chunk, chunk + overlap)] * (not r["last"]) for r in rows]
            out = []
            for r, edges in zip(rows, coder.edges(texts, zones), strict=True):
                if r["part"]:
                    out.append({"key": r["key"], "seam": r["part"], "left": _edge(edges, 0, overlap)})
                if r["last"]:
                    out.append({"key": r["key"], "seam": 0, "total": edges[2]})
                else:
                    out.append({"key": r["key"], "seam": r["part"] + 1, "right": _edge(edges, chunk, chunk + overlap)})
            yield pa.RecordBatch.from_pylist(out, _EDGE_ROWS)

    return run


def _spliced(edges: DataFrame) -> DataFrame:
    """``key, n_tokens``: of each text, null where a seam has no common boundary. Rows of equal texts are equal and fall
    together."""
    seams = edges.groupBy("key", "seam").agg(F.max("total").alias("total"), F.max("right").alias("right"), F.max("left").alias("left"))
    at = F.element_at(F.array_intersect("right.at", "left.at"), 1)
    before = lambda side: F.element_at(F.col(f"{side}.before"), F.array_position(F.col(f"{side}.at"), F.col("splice")).cast("int"))
    seams = seams.withColumn("splice", F.when(F.size(F.array_intersect("right.at", "left.at")) > 0, at))
    gain = F.coalesce("total", F.when(F.col("splice").isNotNull(), before("right") - before("left")))
    return seams.groupBy("key").agg(F.when(F.count_if(gain.isNull()) == 0, F.sum(gain)).alias("n_tokens"))


def huge_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``key, n_tokens`` of the distinct texts in the column ``text``; key: their SHA-256."""
    spark = texts.sparkSession
    work, done, again = Workspace(spark, "token_count"), [], texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        pieces = again.mapInArrow(_cut(chunk, overlap), PIECES).withColumn("salt", F.spark_partition_id())
        dealt = pieces.repartition(parts, "key", "part", "salt").drop("salt")
        found = work.write(_spliced(dealt.mapInArrow(_encode(path, chunk, overlap), EDGES)), f"counts{len(done)}")
        done.append(found.where(F.col("n_tokens").isNotNull()))
        left = found.where(F.col("n_tokens").isNull()).select("key")
        if left.isEmpty():
            break
        again = texts.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).join(left, "key", "left_semi").select("text")
        overlap *= 4
        chunk = max(chunk, overlap)
    counts = done[0]
    for more in done[1:]:
        counts = counts.unionByName(more)
    return counts


def token_counts(documents: DataFrame, path: str | None = None, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """The documents' other columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap are positive")
    spark = documents.sparkSession
    prepare(spark)
    where = path or default_path()
    new = ("n_bytes", "n_tokens", "over_limit")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    kept = [c for c in documents.columns if c.lower() not in new and c.lower() != text.lower()]
    body, key = fresh(documents, "text_"), fresh(documents, "key_")
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), whole.alias(body), F.octet_length(whole).cast("long").alias("n_bytes"))
    is_huge = F.length(body) > chunk + overlap
    fields = T.StructType([f for f in rows.schema.fields if f.name != body] + [T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = counter(where)
        for batch in slices(batches, body, 1 << 20):
            numbers = pa.array(coder.counts(batch.column(body)), pa.int64())
            rest = batch.drop_columns([body])
            yield pa.RecordBatch.from_arrays([*rest.columns, numbers], names=[*rest.schema.names, "n_tokens"])

    short = rows.where(~is_huge).mapInArrow(count, fields)
    huge = rows.where(is_huge)
    counts = huge_counts(huge.select(F.col(body).alias("text")), where, chunk, overlap).withColumnRenamed("key", key)
    named = huge.withColumn(key, F.unhex(F.sha2(F.col(body).cast("binary"), 256))).drop(body)
    found = short.unionByName(named.join(counts, key).drop(key))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op11(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return token_counts(documents.select("doc_id", "text"))
