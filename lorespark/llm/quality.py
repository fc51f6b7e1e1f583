"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text is described by hashed character trigrams twice over: as they are, but for the case of ASCII letters, weighted by
inverse document frequency among the labelled texts (what is said), and by shape: letters, capitals, digits, white
space, each punctuation mark (how it is written); and by how many of its words repeat the word before. Frequencies are
taken by their square roots. A truncated SVD of the labelled texts gives the latent space. The labelled vectors are
broadcast, their number being bounded by ``max_labelled``, and every document's exact cosine with each of them is
computed block by block; its ``neighbours`` nearest vote for their labels, weighted by a power of the similarity. Among
neighbours with equal similarity, any of them may be the last to vote.

Texts are read whole; a null text counts as empty and, like any text without features, gets the labelled mean.
Labels that are null or contradict each other for one id are not learnt. Without any label the score is 0.5. Repeated
rows get equal scores. Extra columns are ignored by :func:`scores`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.scratch import fresh, prepare
from lorespark.llm.words import Words, binary_rows, slices, text_bytes

#: At most so many labelled rows are learnt, those with the least hash of their id.
MAX_LABELLED = 6000
#: Buckets of trigrams as they are, and of their shapes.
TERMS = 1024
HASHED = 1024
PLAIN = 2
WIDTH = TERMS + HASHED + PLAIN
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 12
THRESHOLD = 0.3


def _shapes() -> np.ndarray:
    shape = np.zeros(256, np.uint32)
    shape[:32] = 1
    for c in range(33, 127):
        shape[c] = c
    shape[48:58], shape[65:91], shape[97:123] = 2, 3, 0
    shape[[9, 11, 12, 13, 32]] = 4
    shape[10] = 5
    return shape


SHAPE = _shapes()


FOLDED = np.arange(256, dtype=np.uint32)
FOLDED[65:91] += 32


def _trigrams(values: np.ndarray, step: int, buckets: int, owner: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the relative frequencies of hashed trigrams of each text."""
    shift = np.uint32(32 - (buckets - 1).bit_length())
    trigram = (values[:-2] * np.uint32(step * step) + values[1:-1] * np.uint32(step) + values[2:]) * np.uint32(2654435761) >> shift
    counts = np.bincount(owner[inside] * buckets + trigram[inside], minlength=n * buckets).reshape(n, buckets)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def features(texts: pa.Array) -> np.ndarray:
    """A row of float32 for each text: trigrams, their shapes, plain numbers; zeros for an empty one."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    if len(data) >= 3:
        owner = np.repeat(np.arange(n), np.diff(offsets))[:-2]
        inside = np.arange(len(data) - 2) + 2 < offsets[1:][owner]
        out[:, :TERMS] = _trigrams(FOLDED[data], 256, TERMS, owner, inside, n)
        out[:, TERMS : TERMS + HASHED] = _trigrams(SHAPE[data], 128, HASHED, owner, inside, n)
    words = Words(texts)
    number = np.diff(words.first)
    if len(words.index) > 1:
        owner = np.repeat(np.arange(n), number)
        again = (words.index[1:] == words.index[:-1]) & (owner[1:] == owner[:-1])
        sizes = np.array([len(w) for w in words.distinct])
        out[:, TERMS + HASHED] = np.sqrt(np.bincount(owner[1:][again], minlength=n) / np.maximum(number, 1))
        size = np.bincount(owner, sizes[words.index].astype(float), minlength=n) / np.maximum(number, 1)
        out[:, TERMS + HASHED + 1] = np.minimum(size, 60) / 60
    return out


def inverse_frequency(vectors: np.ndarray) -> np.ndarray:
    """A weight for every feature: for trigrams as they are, by the share of labelled texts without them; else 1."""
    weights = np.ones(vectors.shape[1], np.float32)
    if vectors.shape[1] == WIDTH and len(vectors):
        rare = np.log((1 + len(vectors)) / (1 + (vectors[:, :TERMS] > 0).sum(axis=0)))
        weights[:TERMS] = rare / max(float(np.log(1 + len(vectors))), 1.0)
    return weights


def is_held_out(id_column: str = "doc_id") -> F.Column:
    return (F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0) & F.col(id_column).isNotNull()


def labelled_features(documents: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded set of labelled documents outside the held-out part."""
    agreed = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id")
    agreed = agreed.agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    picked = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("label").cast("double"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            rows = features(batch.column("text")).astype(np.float16)
            vectors = binary_rows(rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), vectors], names=["doc_id", "label", "vector"])

    rows = known.mapInArrow(describe, "doc_id string, label double, vector binary").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(max_labelled).collect()
    if not rows:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    vectors = np.empty((len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        vectors[k] = np.frombuffer(r.vector, np.float16)
    return vectors, np.array([r.label for r in rows])


def fit(vectors: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """The latent space and the labelled vectors in it, of norm 1."""
    weights = inverse_frequency(vectors)
    vectors = vectors * weights
    _, axes = np.linalg.eigh((vectors.T @ vectors).astype(np.float64))
    axes = np.ascontiguousarray(axes[:, ::-1][:, :dimensions]).astype(np.float32)
    latent = vectors @ axes
    axes = weights[:, None] * axes
    norms = np.linalg.norm(latent, axis=1)
    return {"axes": axes, "latent": latent[norms > 0] / norms[norms > 0, None], "labels": labels[norms > 0], "mean": float(labels.mean()) if len(labels) else 0.5}


def vote(model: dict, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of feature rows."""
    out = np.full(len(rows), model["mean"])
    known = model["latent"]
    if not len(known):
        return out
    latent = rows @ model["axes"]
    norms = np.linalg.norm(latent, axis=1)
    for at in range(0, len(rows), 512):
        some = np.flatnonzero(norms[at : at + 512] > 0) + at
        cosine = (latent[some] / norms[some, None]) @ known.T
        k = min(neighbours, len(known))
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 1e-6).astype(np.float64) ** POWER
        out[some] = np.clip((weight * model["labels"][nearest]).sum(axis=1) / weight.sum(axis=1), 0, 1)
    return out


def with_score(documents: DataFrame, labels: DataFrame, score: str = "score", **options) -> DataFrame:
    """The documents with a column of scores; a column of that name is replaced."""
    spark = documents.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(*labelled_features(documents, labels, **options)))
    kept = documents.drop(score)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vote(model.value, features(batch.column("text"))))], names=[*batch.schema.names, score])

    return kept.mapInArrow(judge, T.StructType([*kept.schema.fields, T.StructField(score, T.DoubleType())]))


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    scored = with_score(documents.select("doc_id", "text"), labels)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the vote accepts, columns unchanged."""
    score = fresh(documents, "_score")
    return with_score(documents, labels, score).where(F.col(score) >= THRESHOLD).select(*(F.col(f"`{c}`") for c in documents.columns))
