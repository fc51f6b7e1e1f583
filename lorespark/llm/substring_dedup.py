"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Only windows of ``size`` consecutive words matter: a word goes when some window that covers it also starts in a
document with a smaller id. The documents are their own reference:

1. *Phrases.* Each text is cut by content: every window belongs to the least hash of the ``SEED``-word runs in it, its
   seed, and a phrase is a maximal row of windows with the same seed. Equal windows have equal seeds, so whatever
   repeats in another document stands there under the same seed, and a reference block is made of the phrases of some
   seeds. A phrase is named by a 128-bit digest of its words; its reference is the least document that has it.
2. *Whole factors.* A phrase that a smaller document has, word for word, is one factor there, all of it duplicate.
3. *Parsing.* Where phrases of one seed differ, their words are read from their first documents and dealt to the
   reference blocks by seed. A task goes through a seed's phrases in the order of their documents and parses each one
   greedily against those of smaller documents: an index of windows gives the place where a factor begins, the factor
   is extended word by word as far as both agree, and parsing goes on at the factor's end. Windows that straddle the
   end of a factor are looked up one by one, as they may lie in another reference. The words are compared themselves.
4. *Hot seeds.* Seeds whose different phrases have more than ``HOT`` windows (a passage in very many contexts) would make
   one task's block too large. Their windows are blocks of their own: each is named by a digest of its words and its least
   document found by a pre-aggregated ``groupBy``.
5. Duplicate windows of a document are merged into spans and their words removed.

No pair of documents is formed. Windows are judged on the input. Null texts have no words; rows with the same id are
parts of one document id and never duplicate each other (the number of intermediate rows stays in proportion to them);
a null id ranks before all others. Very long texts are read whole; empty tables give empty results. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace, prepare, text_version
from lorespark.llm.words import Words, digest, run_hashes, slices

SIZE = 50
SEED = 8
#: A phrase is cut after so many windows, so that repetitive texts keep phrases short.
LONGEST = 256
#: Windows of one seed's different phrases up to which they are parsed in one task (a few hundred bytes each).
HOT = 1 << 16
#: Windows of more bytes stand in the index by their digest.
LONG_WINDOW = 1000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


def phrases_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of some texts: text, first word among all words, number of windows, seed."""
    starts, first = words.windows(size)
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty, empty, empty, empty
    seeds = min(SEED, size)
    least = _sliding_min(run_hashes(words.hashes, seeds), size - seeds + 1)[starts]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    at = np.flatnonzero(place % LONGEST == 0)
    return text[at], starts[at], np.diff(np.append(at, len(starts))), least[at].view(np.int64)


def factors(phrase: bytes, size: int, index: dict[bytes, tuple[list[bytes], int]]) -> tuple[list[tuple[int, int]], list[tuple[bytes, list[bytes], int]]]:
    """The factors (first word, number of words) of a phrase against the reference that ``index`` knows by its windows,
    and the windows that are not in it: (window, words, first word)."""
    words = phrase.split(b" ")
    begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
    found, own, at = [], [], 0
    while at + size <= len(words):
        window = phrase[begins[at] : begins[at + size] - 1]
        window = window if len(window) <= LONG_WINDOW else digest(window)
        place = index.get(window)
        if place is None:
            own.append((window, words, at))
            at += 1
            continue
        reference, there = place
        length = size
        while at + length < len(words) and there + length < len(reference) and words[at + length] == reference[there + length]:
            length += 1
        found.append((at, length))
        # The windows inside the factor are done; the next one straddles its end.
        at += length - size + 1
    return found, own


def _source(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, text, and a digest of the text that tells rows with the same id apart."""
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), text_version(text).alias("version"))


def _with_lists(source: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """The texts with their list of that name."""
    other = lists.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), name)
    return source.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), how).select("doc_id", "version", "text", name)


def _phrases(source: DataFrame, size: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            text, begin, n, seed = phrases_of(words, size)
            names = [words.digest(a, b) for a, b in zip(begin.tolist(), (begin + n + size - 1).tolist(), strict=True)]
            rows = pa.array(text)
            start = (begin - words.first[text]).astype(np.int32)
            arrays = [batch.column("doc_id").take(rows), batch.column("version").take(rows), pa.array(seed), pa.array(names, pa.binary()), pa.array(start), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "version", "seed", "phrase", "start", "n"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc_id {kind}, version binary, seed bigint, phrase binary, start int, n int")


def _phrase_words(asked: DataFrame, size: int) -> DataFrame:
    """asked: texts with a list of (seed, phrase, start, n). A row for each of these phrases: its words, one space apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            split = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
            place = zip(row.tolist(), flat.field(2).to_pylist(), flat.field(3).to_pylist(), strict=True)
            words = [b" ".join(split[r][start : start + n + size - 1]) for r, start, n in place]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), flat.field(0), flat.field(1), pa.array(words, pa.binary())], names=["doc_id", "seed", "phrase", "words"])

    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(read, f"doc_id {kind}, seed bigint, phrase binary, words binary")


def _parsed(blocks: DataFrame, size: int) -> DataFrame:
    """blocks: doc_id, seed, phrase, words, sorted within each partition. ``seed, phrase, at, n``: n windows from the
    at-th on lie in a factor."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("seed", "doc_id", "phrase", "words")
        rows = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in zip(*(batch.column(c).slice(at, 512).to_pylist() for c in columns), strict=True))
        out: list[tuple] = []
        for seed, of_seed in groupby(rows, key=lambda r: r[0]):
            index: dict[bytes, tuple[list[bytes], int]] = {}
            for _, of_document in groupby(of_seed, key=lambda r: r[1]):
                learnt, last = [], None
                for _, _, phrase, words in of_document:
                    if phrase == last:
                        continue
                    last = phrase
                    found, own = factors(words, size, index)
                    out += [(seed, phrase, at, length - size + 1) for at, length in found]
                    learnt += own
                for window, words, at in learnt:
                    index.setdefault(window, (words, at))
            if len(out) > 16384:
                yield _columns(out)
                out = []
        yield _columns(out)

    return blocks.mapInArrow(parse, "seed bigint, phrase binary, at int, n int")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    types = {"seed": pa.int64(), "phrase": pa.binary(), "at": pa.int32(), "n": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def _single_windows(phrases: DataFrame, size: int) -> DataFrame:
    """phrases: doc_id, seed, phrase, words. A row for each window: its digest and place in the phrase."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", 1 << 17):
            rows, places, windows = [], [], []
            for k, phrase in enumerate(batch.column("words").to_pylist()):
                begins = np.concatenate(([0], np.cumsum([len(w) + 1 for w in phrase.split(b" ")]))).tolist()
                for at in range(len(begins) - size):
                    rows.append(k)
                    places.append(at)
                    windows.append(digest(phrase[begins[at] : begins[at + size] - 1]))
            chosen = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(chosen) for c in ("doc_id", "seed", "phrase")), pa.array(windows, pa.binary()), pa.array(places, pa.int32())], names=["doc_id", "seed", "phrase", "window", "at"])

    kind = phrases.schema["doc_id"].dataType.simpleString()
    return phrases.mapInArrow(look, f"doc_id {kind}, seed bigint, phrase binary, window binary, at int")


def _least_and_most() -> list[F.Column]:
    """The least doc_id of a group, null ranking first, and the greatest."""
    return [F.when(F.count("*") > F.count("doc_id"), None).otherwise(F.min("doc_id")).alias("least"), F.max("doc_id").alias("most")]


#: A group with documents of different ids; and its least id ranks before the row's.
SHARED = "most is not null and (least is null or least < most)"
LATER = "doc_id is not null and (least is null or least < doc_id)"


def duplicate_windows(documents: DataFrame, size: int = SIZE, id_column: str = "doc_id", text: str = "text", hot: int = HOT, work: Workspace | None = None) -> DataFrame:
    """``doc_id, version, spans``: lists of ``start, n``: the windows start .. start+n-1 (numbers of their first words) of
    the text with that digest occur in a smaller document. A text may have several rows."""
    spark = documents.sparkSession
    prepare(spark)
    work = work or Workspace(spark, "windows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = _source(documents, id_column, text)
    phrases = work.write(_phrases(source, size), "phrases")
    seeds = work.write(phrases.groupBy("seed").agg(*_least_and_most()).where(SHARED).select("seed"), "seeds")
    index = work.write(phrases.join(seeds, "seed"), "index")
    work.drop("phrases", "seeds")

    known = work.write(index.groupBy("seed", "phrase").agg(*_least_and_most(), F.max("n").alias("n")), "known")
    repeated = work.write(known.where(SHARED).select("seed", "phrase", "least"), "repeated")
    whole = index.join(repeated, ["seed", "phrase"]).where(LATER).select("doc_id", "version", F.array(F.struct("start", "n")).alias("spans"))

    kinds = work.write(known.groupBy("seed").agg(F.count("*").alias("kinds"), F.sum("n").alias("volume")).where("kinds > 1"), "kinds")
    differing = work.write(known.join(kinds, "seed").select("seed", "phrase", F.col("least").alias("_least")), "differing")
    new_here = (index.seed == differing.seed) & (index.phrase == differing.phrase) & index.doc_id.eqNullSafe(differing["_least"])
    # Rows with the same id and text have the same phrases; one of them is enough.
    firsts = work.write(index.join(differing, new_here, "left_semi").distinct(), "firsts")
    one_place = firsts.groupBy("seed", "phrase").agg(F.min(F.struct("version", "start", "n", "doc_id")).alias("p"))
    one_place = one_place.select(F.col("p.doc_id").alias("doc_id"), F.col("p.version").alias("version"), F.struct("seed", "phrase", "p.start", "p.n").alias("ask"))
    asked = work.write(one_place.groupBy("doc_id", "version").agg(F.collect_list("ask").alias("asked")), "asked")
    texts = work.write(_phrase_words(_with_lists(source, asked, "asked", "inner"), size), "texts")

    split = texts.join(kinds, "seed")
    ordered = split.where(F.col("volume") <= hot).select("doc_id", "seed", "phrase", "words").repartition(parts, "seed")
    parsed = _parsed(ordered.sortWithinPartitions("seed", F.col("doc_id").asc_nulls_first(), "phrase"), size)

    windows = work.write(_single_windows(split.where(F.col("volume") > hot).select("doc_id", "seed", "phrase", "words").distinct(), size), "windows")
    again = work.write(windows.groupBy("window").agg(*_least_and_most()).where(SHARED).select("window", "least"), "again")
    single = windows.join(again, "window").where(LATER).select("seed", "phrase", "at", F.lit(1).alias("n"))

    # A phrase has as many factors as windows at most, so a list of them is short.
    found = work.write(parsed.union(single).groupBy("seed", "phrase").agg(F.collect_list(F.struct("at", "n")).alias("factors")), "found")
    moved = F.transform("factors", lambda f: F.struct((f["at"] + F.col("start")).alias("start"), f["n"].alias("n")))
    inside = firsts.join(found, ["seed", "phrase"]).select("doc_id", "version", moved.alias("spans"))
    return whole.union(inside)


def remove_duplicates(documents: DataFrame, size: int = SIZE, id_column: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256, kept`` (the words left, joined by one space)."""
    work = Workspace(documents.sparkSession, "substrings")
    source = _source(documents, id_column, text)
    spans = duplicate_windows(documents, size, id_column, text, hot, work).distinct()
    lists = work.write(spans.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    work.drop("index", "known", "repeated", "kinds", "differing", "firsts", "asked", "texts", "windows", "again", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for value, spans_of in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                words = (value or "").encode().split()
                kept = words
                if spans_of.is_valid:
                    flat = spans_of.values
                    start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + size - 1, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, gone in zip(words, covered.tolist(), strict=True) if not gone]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return _with_lists(source, lists, "spans", "left").mapInArrow(remove, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op4(documents: DataFrame) -> DataFrame:
    """The contract's digest columns, through :func:`remove_duplicates`."""
    return remove_duplicates(documents.select("doc_id", "text")).drop("kept")
