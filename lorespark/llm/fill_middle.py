"""Fill-in-the-middle texts, put together by a secondary sort.

A text is cut at two points drawn from its id's hash; its form says whether the pieces stand as prefix, suffix, middle
(psm), as suffix, prefix, middle (spm) or as they were (plain). Tasks emit pieces of at most ``unit`` code points, keyed
by document and place in the output. They are repartitioned by document and sorted within partitions by document and
place (Spark's repartition and sort, which spills), so that an assembler meets each output's pieces in order and joins or
digests them as they pass; no document is gathered for its digest. For the way back each piece gets its place in the text
from the output alone: the sentinel that opens its section, and the form. A second sort within the same partitions,
without another shuffle, lets the restored text pass in order.

Documents are told apart by id and SHA-256 of the text. Rows equal in both have equal results, are assembled once, and are
dropped before the shuffle where a task has met them before; results are joined to all rows. Cuts and form depend on the
id only: rows of one id with different texts share their draws, a null id draws as an empty one. A null text counts as
empty and is plain; so is every text that holds a sentinel. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.scratch import fresh, prepare, text_version
from lorespark.llm.words import slices

UNIT = 8192
SEED = 1
#: Of 100 documents, so many are rearranged, and of 100 rearranged ones so many have the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Documents that a task remembers, so that repeated rows are cut once; emptied when full.
KEEP = 50_000
BATCH = 1 << 20

SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: A section's rank in the text by the sentinel that opens it in the output.
RANKS = {SENTINELS[s].encode(): rank for rank, s in enumerate(("prefix", "middle", "suffix"))}
#: Places within one section.
SECTION = 1 << 40


def draws(name: object, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the seed and a document's id (null: empty)."""
    found = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    return [int(found[at : at + 8], 16) for at in range(0, 32, 8)]


def plan(name: object, text: str, seed: int = SEED) -> tuple[str, int | None, int | None]:
    """A text's form and the lengths of its prefix and middle (None if plain)."""
    one, two, keeps, order = draws(name, seed)
    if not text or keeps % 100 >= REARRANGED or any(s in text for s in SENTINELS.values()):
        return "plain", None, None
    first, second = sorted((one % (len(text) + 1), two % (len(text) + 1)))
    return "spm" if order % 100 < SUFFIX_FIRST else "psm", first, second - first


def sections(text: str, form: str, prefix: int | None, middle: int | None) -> Iterator[tuple[str, int, int]]:
    """(sentinel, begin, end) of each section of the output, in its order."""
    if form == "plain":
        yield "", 0, len(text)
        return
    bounds = {"prefix": (0, prefix), "middle": (prefix, prefix + middle), "suffix": (prefix + middle, len(text))}
    for section in ORDERS[form]:
        yield SENTINELS[section], *bounds[section]


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


HEADER = [_field("n", T.LongType()), _field("form", T.StringType()), _field("prefix_chars", T.LongType()), _field("middle_chars", T.LongType())]
KEYED = [_field("version", T.BinaryType()), _field("place", T.LongType())]
PIECE = [_field("part", T.BinaryType())]


class _Rows:
    """Rows gathered into Arrow batches of about BATCH bytes."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row: object, size: int = 64) -> bool:
        """Whether it is time to take the batch."""
        self.rows.append(row)
        self.size += size
        return self.size >= BATCH

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _keyed(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return documents.select(F.col(f"`{id_column}`").alias("id"), whole.alias("text"))


def _pieces(rows: DataFrame, unit: int, seed: int) -> DataFrame:
    """The outputs' pieces, in order within partitions; the first has the header."""
    schema = T.StructType([rows.schema["id"], *KEYED, *HEADER, *PIECE])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, met = _Rows(schema), set()
        for batch in slices(batches, "text", BATCH):
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                version = hashlib.sha256(text.encode()).digest()[:16]
                if (name, version) in met:
                    continue
                if len(met) >= KEEP:
                    met.clear()
                met.add((name, version))
                form, prefix, middle = plan(name, text, seed)
                header, place = (len(text), form, prefix, middle), 0
                for sentinel, begin, end in sections(text, form, prefix, middle):
                    for at in range(begin, max(end, begin + 1), unit):
                        part = (sentinel + text[at : min(at + unit, end)]).encode()
                        sentinel = ""
                        if out.add(name, version, place, *header, part, size=64 + len(part)):
                            yield out.take()
                        header, place = (None,) * 4, place + 1
        yield out.take()

    pieces = rows.mapInArrow(cut, schema)
    return pieces.repartition("id", "version").sortWithinPartitions("id", "version", "place")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a document begins, row) of sorted pieces; a repeated piece is passed over."""
    before = (None, None, None)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = row[:3]
            if key != before:
                yield key[:2] != before[:2], row
            before = key


def _joined(pieces: DataFrame) -> DataFrame:
    """``id, version, n, form, prefix_chars, middle_chars, output``."""
    schema = T.StructType([pieces.schema["id"], KEYED[0], *HEADER, _field("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, parts = _Rows(schema), None, []
        for begins, row in _streams(batches):
            if begins:
                if head and out.add(*head, (whole := b"".join(parts).decode()), size=len(whole)):
                    yield out.take()
                head, parts = (*row[:2], *row[3:7]), []
            parts.append(row[7])
        if head:
            out.add(*head, b"".join(parts).decode())
        yield out.take()

    return pieces.mapInArrow(run, schema)


def section_rank(part: bytes, form: str, rank: int) -> tuple[int, bytes]:
    """The rank in the text of the section that a piece of output belongs to, and the piece without its sentinel.

    Rearranged texts hold no sentinel, and sections begin with a piece, so a piece that begins with a sentinel opens one.
    form: "plain" or "p" for a plain output; rank: that of the piece before.
    """
    if form in ("plain", "p"):
        return 0, part
    opened = RANKS.get(part[:3])
    return (rank, part) if opened is None else (opened, part[3:])


def _digested(pieces: DataFrame) -> DataFrame:
    """``id, version, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    sha = _field("output_sha256", T.StringType())
    schema = T.StructType([pieces.schema["id"], *KEYED, *HEADER, sha, *PIECE])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces with their places in the text, and before them, at -1, the header with the output's digest."""
        out, head, digest, rank, place = _Rows(schema), None, None, 0, 0
        for begins, row in _streams(batches):
            if begins:
                if head:
                    out.add(*head[:2], -1, *head[2:], digest.hexdigest(), None)
                head, digest, rank, place = (*row[:2], *row[3:7]), hashlib.sha256(), 0, 0
            digest.update(row[7])
            rank, part = section_rank(row[7], head[3], rank)
            if out.add(*row[:2], rank * SECTION + place, None, None, None, None, None, part, size=64 + len(part)):
                yield out.take()
            place += 1
        if head:
            out.add(*head[:2], -1, *head[2:], digest.hexdigest(), None)
        yield out.take()

    result = T.StructType([pieces.schema["id"], KEYED[0], *HEADER, sha, _field("restored_sha256", T.StringType())])

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = _Rows(result), None, None
        for begins, row in _streams(batches):
            if begins:
                if head and out.add(*head, digest.hexdigest()):
                    yield out.take()
                head, digest = (*row[:2], *row[3:8]), hashlib.sha256()
            else:
                digest.update(row[8])
        if head:
            out.add(*head, digest.hexdigest())
        yield out.take()

    # The partitions stay those of the documents: sorted anew, not shuffled.
    return pieces.mapInArrow(passed, schema).sortWithinPartitions("id", "version", "place").mapInArrow(restored, result)


def _for_all_rows(documents: DataFrame, id_column: str, text: str, found: DataFrame) -> DataFrame:
    """The documents' columns other than the text, with the found ones; clashing columns (whatever their case) give way."""
    new = {c.lower() for c in found.columns[2:]} | {text.lower()} - {id_column.lower()}
    kept = [c for c in documents.columns if c.lower() not in new]
    of_id, of_text, name, version = (fresh(documents, n) for n in ("_of_id", "_of_text", "_id", "_version"))
    rows = documents.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{id_column}`").alias(of_id), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(of_text))
    rows = rows.withColumn(of_text, text_version(of_text))
    found = found.withColumnRenamed("id", name).withColumnRenamed("version", version)
    same = rows[of_id].eqNullSafe(found[name]) & (rows[of_text] == found[version])
    return rows.join(found, same).drop(of_id, of_text, name, version)


def filled(documents: DataFrame, id_column: str = "doc_id", text: str = "text", unit: int = UNIT, seed: int = SEED) -> DataFrame:
    """The documents' other columns with ``n, form, prefix_chars, middle_chars`` and the text ``output``."""
    prepare(documents.sparkSession)
    return _for_all_rows(documents, id_column, text, _joined(_pieces(_keyed(documents, id_column, text), unit, seed)))


def digests(documents: DataFrame, id_column: str = "doc_id", text: str = "text", unit: int = UNIT, seed: int = SEED) -> DataFrame:
    """As :func:`filled`, with ``output_sha256`` and ``restored_sha256`` in place of the output."""
    prepare(documents.sparkSession)
    return _for_all_rows(documents, id_column, text, _digested(_pieces(_keyed(documents, id_column, text), unit, seed)))


def restored(outputs: DataFrame, id_column: str = "doc_id", unit: int = UNIT) -> DataFrame:
    """``text`` in place of the columns ``output`` and ``form`` that :func:`filled` gives, rebuilt from these two.

    Rows equal in id and output, both rearranged or both plain, count as one and all get its text. An output whose form is
    another or null, or that lacks a sentinel, is plain. ``unit`` is longer than a sentinel.
    """
    prepare(outputs.sparkSession)
    rearranged = F.coalesce(F.col("form").isin(*ORDERS) & F.forall(F.array(*map(F.lit, SENTINELS.values())), lambda s: F.contains("output", s)), F.lit(False))
    named = outputs.withColumn("output", F.concat(F.when(rearranged, "r").otherwise("p"), F.coalesce("output", F.lit(""))))
    rows = _keyed(named, id_column, "output")
    schema = T.StructType([rows.schema["id"], *KEYED, *PIECE])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(schema)
        for batch in slices(batches, "text", BATCH):
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                version, rank = hashlib.sha256(text.encode()).digest()[:16], 0
                at = sorted(text.index(s) for s in SENTINELS.values()) if text[0] == "r" else [1]
                for begin, end in zip(at, [*at[1:], len(text)], strict=True):
                    for place in range(begin, max(end, begin + 1), unit):
                        rank, part = section_rank(text[place : min(place + unit, end)].encode(), text[0], rank)
                        if out.add(name, version, rank * SECTION + place, part, size=64 + len(part)):
                            yield out.take()
        yield out.take()

    result = T.StructType([rows.schema["id"], KEYED[0], _field("text", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, parts = _Rows(result), None, []
        for begins, row in _streams(batches):
            if begins:
                if head and out.add(*head, (whole := b"".join(parts).decode()), size=len(whole)):
                    yield out.take()
                head, parts = row[:2], []
            parts.append(row[3])
        if head:
            out.add(*head, b"".join(parts).decode())
        yield out.take()

    sorted_pieces = rows.mapInArrow(cut, schema).repartition("id", "version").sortWithinPartitions("id", "version", "place")
    return _for_all_rows(named.drop("text"), id_column, "output", sorted_pieces.mapInArrow(join, result)).drop("form")


def op13(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return digests(documents.select("doc_id", "text"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
