"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to floor(scale * x). The rows are packed into blocks; in a block, each dimension has its rows in
sorted order. For a query the lists are read from the end that its component favours, a few rows of every list at first
and twice as many in every round; each row met is scored in full, and the walk stops when the sum of the lists' current
contributions, which no unseen row can beat, is below the k-th score. That score is carried from one block of a bucket
to the next. Queries are a stated subset of the rows.

Blocks are dealt to buckets, one block or a few each, and stay there; the queries, packed a few hundred at a time in the
narrowest integer type that holds them, go once to every bucket, so what is shuffled is the rows once and the queries
once per block. The blocks' results are merged by rank.

Rows whose vector is null, empty or holds null or non-finite components take no part; only vectors of equal length are
compared; a null vec_id takes no part. Rows are told apart by a number of their own, given when they are first written: rows
that share a vec_id are rows like others, and each of them that is a query is answered for itself, with all rows but
itself as candidates. Ties go to the smaller vec_id. Quantised components beyond 62 bits and scores beyond 64 bits are put to the nearest number that
fits. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace, prepare

SCALE = 64
K = 20
BLOCK_ROWS = 4096
PACK_ROWS = 256
FIRST_DEPTH = 8
LARGEST = 1 << 62

PACKED = "dim int, pack bigint, type string, rows binary, ids binary, matrix binary"


def _packed(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows of one length, ``size`` at a time, as a matrix of quantised components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows, ids, matrix = map(np.concatenate, zip(*waiting.pop(dim), strict=True))
            narrow = np.promote_types(np.min_scalar_type(matrix.min()), np.min_scalar_type(matrix.max()))
            narrow = narrow if narrow.kind == "i" else np.dtype(np.int64)
            arrays = [pa.array([dim], pa.int32()), pa.array([int(rows[0])]), pa.array([narrow.str]), *(pa.array([x.tobytes()], pa.binary()) for x in (rows, ids, matrix.astype(narrow)))]
            return pa.RecordBatch.from_arrays(arrays, names=["dim", "pack", "type", "rows", "ids", "matrix"])

        for batch in batches:
            vectors = batch.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale), -LARGEST, LARGEST)
            ends = np.cumsum(lengths)
            own_rows, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "vec_id"))
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                for at in range(0, len(own), size):
                    some = own[at : at + size]
                    matrix = flat[(ends[some] - dim)[:, None] + np.arange(dim)].astype(np.int64)
                    waiting.setdefault(int(dim), []).append((own_rows[some], ids[some], matrix))
                    if sum(len(i) for i, *_ in waiting[int(dim)]) >= size:
                        yield out(int(dim))
        for dim in list(waiting):
            yield out(dim)

    return rows.mapInArrow(pack, PACKED)


Best = tuple[np.ndarray, np.ndarray]
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Block:
    """Rows of one length with the sorted lists of their dimensions."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, numbers: np.ndarray | None = None):
        self.ids = ids
        self.numbers = ids if numbers is None else numbers
        self.matrix = matrix
        self.orders = np.argsort(matrix.T, axis=1, kind="stable")
        self.values = np.take_along_axis(matrix.T, self.orders, axis=1).astype(np.int64)
        self.typed: dict[type, np.ndarray] = {}
        self.largest = int(max(-int(matrix.min()), int(matrix.max()), 1))

    def rows(self, queries: np.ndarray) -> np.ndarray:
        """The rows in the fastest type in which no sum of products with one of the queries can be rounded."""
        largest = self.largest * max(-int(queries.min()), int(queries.max()), 1) * self.matrix.shape[1]
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object
        if kind not in self.typed:
            self.typed = {kind: self.matrix.astype(np.int64).astype(kind)}
        return self.typed[kind]


def threshold_search(query: np.ndarray, own: int, block: Block, rows: np.ndarray, k: int, best: Best = NONE) -> tuple[Best, int]:
    """The k best of a block's rows and of those in ``best`` (scores and ids, best first) for a query, and how many rows
    of the block were scored. own: the query's row number; rows: the block's, in a type that holds every score exactly."""
    n = len(block.ids)
    seen, scored = np.zeros(n, bool), np.zeros(n, bool)
    best_score, best_id = best
    up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    exact = rows.dtype if rows.dtype == object else np.int64
    weights, wide = query.astype(rows.dtype), query.astype(exact)
    depth, reach = 0, FIRST_DEPTH
    while True:
        reach = min(reach, n) if len(up) + len(down) else n
        if len(up) + len(down):
            seen[block.orders[up, depth:reach]] = True
            seen[block.orders[down, n - reach : n - depth]] = True
        else:
            seen[:] = True
        met = np.flatnonzero(seen & ~scored)
        scored |= seen
        score = rows[met] @ weights
        score = np.clip(score, -(1 << 63), (1 << 63) - 1).astype(np.int64) if rows.dtype == object else score.astype(np.int64)
        good = block.numbers[met] != own
        if len(best_score) == k:
            good &= score >= best_score[-1]
        elif len(met) > k:
            # The k-th of these bounds the k-th of all from below; one more for the query's own row.
            good &= score >= np.partition(score, len(met) - k - 1)[len(met) - k - 1]
        score, names = np.concatenate((best_score, score[good])), np.concatenate((best_id, block.ids[met[good]]))
        top = np.lexsort((names, -score.astype(exact)))[:k] if rows.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (-int(score[i]), int(names[i])))[:k], int)
        best_score, best_id = score[top], names[top]
        bound = 0
        if reach < n:
            bound = int(block.values[up, reach - 1].astype(exact) @ wide[up]) + int(block.values[down, n - reach].astype(exact) @ wide[down])
        # A row not met yet may still equal the bound, and win a tie by its id.
        if reach == n or len(best_score) == k and bound < best_score[-1]:
            return (best_score, best_id), int(scored.sum())
        depth, reach = reach, reach * 2


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (on column vec_id), its k best other rows."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    work = Workspace(vectors.sparkSession, "topk")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = work.write(rows.repartition(parts).withColumn("row", F.monotonically_increasing_id()), "vectors")
    buckets = rows.count() // BLOCK_ROWS + 1
    blocks = _packed(rows, BLOCK_ROWS, scale).withColumn("bucket", F.pmod(F.xxhash64("pack"), F.lit(buckets)).cast("int")).withColumn("is_pack", F.lit(False))
    packs = _packed(rows.where(is_query), PACK_ROWS, scale).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn("is_pack", F.lit(True))
    met = blocks.unionByName(packs).repartition(max(parts, 1), "dim", "bucket").sortWithinPartitions("dim", "bucket", "is_pack", "pack")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for row in (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
            if at != (row["dim"], row["bucket"]):
                at, held = (row["dim"], row["bucket"]), []
            numbers, ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
            matrix = np.frombuffer(row["matrix"], row["type"]).reshape(len(ids), row["dim"])
            if not row["is_pack"]:
                held.append(Block(ids, matrix, numbers))
                continue
            wanted = matrix.astype(np.int64)
            found = [NONE] * len(ids)
            for block in held:
                typed = block.rows(wanted)
                found = [threshold_search(wanted[i], numbers[i], block, typed, k, found[i])[0] for i in range(len(ids))]
            times = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, times)), pa.array(np.repeat(ids, times)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))], names=["query", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(embeddings: DataFrame) -> DataFrame:
    """The contract's query: rows whose vec_id is divisible by 20, against all others."""
    return top_k(embeddings, F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
