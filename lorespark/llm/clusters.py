"""Centroid clustering over a VA-file: few-bit cells per dimension decide what they can, full vectors the rest.

Vectors are turned to integers, floor(scale * x). A vector's approximation is the number of its cell in each dimension,
``bits`` bits each: cells are equally wide around the dimension's mean, the outermost reach to its least and greatest
value (all from the whole table). For given centroids, lookup tables hold the least and the greatest squared difference
that a value of a cell can have to each centroid's component; their sums over the dimensions are an interval of the
distance. A vector whose interval for one centroid ends before all others begin is settled by its cells; only where
intervals overlap, full vectors are fetched and exact distances compared, over the overlapping centroids.

The first round and the last read cells and vectors side by side, as every vector is summed or gets its distance. The
rounds between read cells alone; then those vectors are fetched, by a join on the row's number, that are open or have
changed their centroid, and sums and counts are corrected by what came and went. Sums are exact integers; what meets the
driver is one number for each centroid and dimension.

Kept are vectors with exactly ``dims`` components, none null or non-finite. Start: the vectors with the smallest SHA-256
of ``seed:id`` (a null id comes last, ties by the vector); fewer vectors than centroids make fewer centroids. A centroid
without vectors stays. Repeated rows each count; a vector at the same distance to several centroids goes to the smallest
number. Integers beyond a limit that keeps distances within 62 bits (2**27 for 64 dimensions) are put to the limit. Sums of
distances beyond 63 bits are put to the greatest long. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace, prepare

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
BITS = 6
#: Standard deviations on either side of the mean that the cells of equal width cover.
SPAN = 3.5


class Cells:
    """The cells' bounds of every dimension."""

    def __init__(self, least: np.ndarray, most: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int = BITS):
        cells = 1 << bits
        width = np.maximum(1, np.ceil(2 * SPAN * deviation / cells)).astype(np.int64)
        edges = np.floor(mean).astype(np.int64)[:, None] + width[:, None] * (np.arange(1, cells) - cells // 2)
        self.bits = bits
        self.edges = edges
        # A cell beyond the values of its dimension is empty; its bounds are kept in order.
        self.low = np.concatenate((np.minimum(least, edges[:, 0])[:, None], edges), axis=1)
        self.high = np.concatenate((edges - 1, np.maximum(most, edges[:, -1])[:, None]), axis=1)

    def numbers(self, matrix: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, side="right") for e, column in zip(self.edges, matrix.T, strict=True)], axis=1).astype(np.uint8)

    def packed(self, matrix: np.ndarray) -> np.ndarray:
        """Each row's cell numbers, ``bits`` bits each, as bytes."""
        bits = np.unpackbits(self.numbers(matrix)[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(bits.reshape(len(matrix), -1), axis=1)

    def unpacked(self, rows: np.ndarray) -> np.ndarray:
        dims = len(self.edges)
        bits = np.unpackbits(rows, axis=1)[:, : dims * self.bits].reshape(len(rows), dims, self.bits)
        return np.packbits(np.concatenate((np.zeros((len(rows), dims, 8 - self.bits), np.uint8), bits), axis=2), axis=2)[:, :, 0]

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, centroid): the least and the greatest squared difference."""
        low, high, at = self.low[:, :, None], self.high[:, :, None], centroids.T[:, None, :]
        below, above = (low - at) ** 2, (high - at) ** 2
        return np.where((low <= at) & (at <= high), 0, np.minimum(below, above)), np.maximum(below, above)

    def candidates(self, numbers: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(vector, centroid): whether the centroid's interval begins no later than every interval ends."""
        least, most = (np.zeros((len(numbers), t.shape[2]), np.int64) for t in tables)
        for d, column in enumerate(numbers.T):
            least += tables[0][d][column]
            most += tables[1][d][column]
        return least <= most.min(axis=1)[:, None]


def nearest(matrix: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest candidate of each vector, the smaller number among equals, and its squared distance."""
    best, distance = np.zeros(len(matrix), np.int64), np.full(len(matrix), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        open_ = np.flatnonzero(candidates[:, c])
        difference = matrix[open_] - centroid
        found = np.einsum("ij,ij->i", difference, difference)
        less = found < distance[open_]
        best[open_[less]], distance[open_[less]] = c, found[less]
    return best, distance


def settled(candidates: np.ndarray) -> np.ndarray:
    """The only candidate's number, -1 where there are several."""
    return np.where(candidates.sum(axis=1) == 1, candidates.argmax(axis=1), -1)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary cells of equal length as rows."""
    if not len(column):
        return np.zeros((0, 0), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


class Sums:
    """Sums and counts of what joins and leaves each centroid."""

    def __init__(self, centroids: int, dims: int):
        self.sums, self.counts = np.zeros((centroids, dims), np.int64), np.zeros(centroids, np.int64)

    def add(self, matrix: np.ndarray, numbers: np.ndarray, sign: int) -> None:
        for c in np.unique(numbers[numbers >= 0]):
            own = matrix[numbers == c]
            self.sums[c] += sign * own.sum(axis=0)
            self.counts[c] += sign * len(own)

    def rows(self) -> pa.RecordBatch:
        """In the form of the assignment's rows, each with a centroid's sums."""
        some = np.flatnonzero(self.counts.astype(bool) | self.sums.any(axis=1))
        empty = pa.nulls(len(some))
        return pa.RecordBatch.from_arrays(
            [empty.cast(pa.int64()), empty.cast(pa.binary()), pa.array(some, pa.int32()), pa.array(self.counts[some]), pa.array(self.sums[some].tolist(), pa.list_(pa.int64()))], names=ROWS
        )


ROWS = ["row", "cells", "cluster", "count", "sums"]
ASSIGNED = "row bigint, cells binary, cluster int, count bigint, sums array<bigint>"
OPEN = "row bigint, cells binary, old int, cluster int"
FINAL = "vec_id {}, cluster int, distance bigint"


def _assigned(row: pa.Array, cells: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
    empty = pa.nulls(len(row))
    return pa.RecordBatch.from_arrays([row, cells, pa.array(numbers, pa.int32()), empty.cast(pa.int64()), empty.cast(pa.list_(pa.int64()))], names=ROWS)


def _limit(dims: int) -> int:
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector: str) -> DataFrame:
    """``vec_id, q``: the vectors that take part, as integers."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = float(_limit(dims))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(limit)), F.lit(-limit)).cast("int"))
    return rows.where((F.size("v") == dims) & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("q"))


def _moments(kept: DataFrame, dims: int) -> list[np.ndarray]:
    """Each dimension's least and greatest value, mean and standard deviation, over all rows; empty without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), *map(pa.array, (m.min(0), m.max(0), np.full(dims, float(len(m))), m.sum(0), (m * m).sum(0)))], names=["d", "least", "most", "n", "s", "ss"])

    parts = kept.select("q").mapInArrow(run, "d int, least double, most double, n double, s double, ss double")
    found = parts.groupBy("d").agg(F.min("least"), F.max("most"), F.sum("n"), F.sum("s"), F.sum("ss")).orderBy("d").collect()
    if not found:
        return []
    least, most, n, s, ss = np.array([r[1:] for r in found], np.float64).T
    return [least.astype(np.int64), most.astype(np.int64), s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0))]


def clusters(vectors: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS, seed: int = SEED, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector."""
    if not 1 <= bits <= 8 or dims < 1 or centroids < 1 or rounds < 0:
        raise ValueError("bits are 1 to 8; dims and centroids at least 1")
    spark = vectors.sparkSession
    prepare(spark)
    work = Workspace(spark, "clusters")
    kept = kept_vectors(vectors, dims, scale, id_column, vector)
    kind = kept.schema["vec_id"].dataType.simpleString()
    first = kept.select("q", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    at = np.array([r.q for r in first.orderBy(F.asc_nulls_last("h"), "q").limit(centroids).collect()], np.int64)
    if not len(at):
        none = spark.createDataFrame([], FINAL.format(kind))
        return none.selectExpr("*", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    moments = _moments(kept, dims)
    cells = Cells(*moments, bits)
    narrow = np.promote_types(np.min_scalar_type(int(moments[0].min())), np.min_scalar_type(int(moments[1].max())))
    narrow = (narrow if narrow.kind == "i" else np.dtype(np.int32)).newbyteorder("<").str

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(cells.packed(m)), _binary(m.astype(narrow))], names=["vec_id", "cells", "q"])

    packed = kept.mapInArrow(pack, f"vec_id {kind}, cells binary, q binary")
    file = work.write(packed.withColumn("row", F.monotonically_increasing_id()), "file")
    k = len(at)
    sums, counts = np.zeros((k, dims), object), np.zeros(k, object)

    def count(table: DataFrame) -> None:
        """Correct sums and counts by the assignment's rows of them, and move the centroids."""
        parts = table.where(F.col("sums").isNotNull()).groupBy("cluster")
        each = F.array(*(F.sum(F.get("sums", F.lit(d))) for d in range(dims)))
        for c, n, found in parts.agg(F.sum("count"), each).collect():
            sums[c] += np.array([int(s) for s in found], object)
            counts[c] += n
        for c in range(k):
            if counts[c]:
                at[c] = [int(s) // int(counts[c]) for s in sums[c]]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = cells.tables(at), Sums(k, dims)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("q"), narrow).astype(np.int64)
                found, _ = nearest(m, at, cells.candidates(cells.unpacked(_matrix(batch.column("cells"), "u1")), tables))
                total.add(m, found, 1)
                yield _assigned(batch.column("row"), batch.column("cells"), found)
        yield total.rows()

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(at)
        for batch in batches:
            if batch.num_rows:
                found = settled(cells.candidates(cells.unpacked(_matrix(batch.column("cells"), "u1")), tables))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), batch.column("cluster"), pa.array(found, pa.int32())], names=["row", "cells", "old", "cluster"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total = cells.tables(at), Sums(k, dims)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("q"), narrow).astype(np.int64)
                found, _ = nearest(m, at, cells.candidates(cells.unpacked(_matrix(batch.column("cells"), "u1")), tables))
                old = batch.column("old").to_numpy()
                moved = found != old
                total.add(m[moved], found[moved], 1)
                total.add(m[moved], old[moved], -1)
                yield _assigned(batch.column("row"), batch.column("cells"), found)
        yield total.rows()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(at)
        for batch in batches:
            if batch.num_rows:
                found, distance = nearest(_matrix(batch.column("q"), narrow).astype(np.int64), at, cells.candidates(cells.unpacked(_matrix(batch.column("cells"), "u1")), tables))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    state = None
    for turn in range(rounds):
        if state is None:
            state = work.write(file.select("row", "cells", "q").mapInArrow(start, ASSIGNED), "assigned0")
            count(state)
            continue
        own = state.where(F.col("row").isNotNull()).select("row", "cells", "cluster")
        bounded = work.write(own.mapInArrow(bound, OPEN), f"bounded{turn}")
        wanted = (F.col("cluster") < 0) | (F.col("cluster") != F.col("old"))
        fetched = bounded.where(wanted).drop("cluster").join(file.select("row", "q"), "row").mapInArrow(fetch, ASSIGNED)
        rest = bounded.where(~wanted).selectExpr("row", "cells", "cluster", "CAST(NULL AS BIGINT) count", "CAST(NULL AS ARRAY<BIGINT>) sums")
        state = work.write(fetched.unionByName(rest), f"assigned{turn}")
        count(state)
        work.drop(f"bounded{turn}", f"assigned{turn - 1}")
    found = work.write(file.select("vec_id", "cells", "q").mapInArrow(finish, FINAL.format(kind)), "found")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(total("distance").alias("s")).collect()}
    inertia = min(sum(own.values()), (1 << 63) - 1)
    names = [(c, own.get(c, 0), inertia, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c in range(k)]
    # One row for each centroid: as small as the parameter says.
    table = spark.createDataFrame(names, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def fetched_shares(vectors: DataFrame, centroids: np.ndarray, bits: int = BITS, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", vector: str = "embedding") -> float:
    """Which share of the kept vectors the cells leave open for given centroids; to choose ``bits`` by."""
    prepare(vectors.sparkSession)
    kept = kept_vectors(vectors, dims, scale, id_column, vector)
    cells = Cells(*_moments(kept, dims), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(centroids)
        for batch in batches:
            m = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([pa.array((settled(cells.candidates(cells.numbers(m), tables)) < 0).astype(float))], names=["open"])

    return kept.select("q").mapInArrow(run, "open double").agg(F.avg("open")).first()[0]


def op12(embeddings: DataFrame) -> DataFrame:
    """The contract's parameters."""
    return clusters(embeddings)


def _sql() -> str:
    steps = [
        """kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "first AS (SELECT q, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, q) - 1 AS c FROM kept)",
        "at0 AS (SELECT c, q FROM first WHERE c < 16)",
        "parts AS (SELECT r, unnest(q) AS x, unnest(range(64)) AS d FROM kept)",
    ]
    for turn in range(4):
        steps.append(f"far{turn} AS (SELECT r, c, list_sum(list_transform(list_zip(kept.q, at{turn}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS f FROM kept, at{turn})")
        steps.append(f"near{turn} AS MATERIALIZED (SELECT r, c, f FROM far{turn} QUALIFY row_number() OVER (PARTITION BY r ORDER BY f, c) = 1)")
        if turn < 3:
            steps.append(f"sums{turn} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM parts JOIN near{turn} USING (r) GROUP BY c, d)")
            steps.append(f"mean{turn} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY d) AS q FROM sums{turn} GROUP BY c)")
            steps.append(f"at{turn + 1} AS MATERIALIZED (SELECT a.c, coalesce(m.q, a.q) AS q FROM at{turn} a LEFT JOIN mean{turn} m ON m.c = a.c)")
    return "WITH " + ", ".join(steps) + """
SELECT vec_id, CAST(n.c AS INT) AS cluster, CAST(f AS BIGINT) AS distance, CAST(sum(f) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(f) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(a.at, ',')) AS centroid_sha256
FROM near3 n JOIN kept USING (r) JOIN (SELECT c, q AS at FROM at3) a ON a.c = n.c"""


SQL = _sql()
