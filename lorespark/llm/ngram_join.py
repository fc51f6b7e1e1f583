"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text's set is that of its runs of five words (white-space words, unchanged); a shorter text has one run, all its
words, and a text without words the empty set. Two documents are linked when the Jaccard similarity of their sets is
at least the threshold; two empty sets count as equal.

1. *Nodes.* Documents with the same word sequence (by a 128-bit digest of the words) are one node, so copies are never
   compared with each other.
2. *Forest.* Each node has a label in every tree: ``depth`` min-hashes of a byte each, the first one highest, in a long.
   A tree is the prefix trie of its labels: in the labels' order a trie node is a run of neighbours, those that agree
   in so many high bytes. A trie node's least member is found by an aggregation over that prefix, which Spark
   pre-aggregates before the shuffle; nothing is gathered per trie node.
3. *Descent.* Matching starts at full depth and shortens the prefix step by step. A node goes on to a shorter prefix
   only until, at the prefix it has, a pair at the least similarity that a set of its size can have at or above the
   threshold meets in some tree with the target probability (:func:`stop_depth`). Only labels that share the shortest
   such prefix with another label are sorted at all.
4. *Verification.* Nodes that met are candidate components. Their members' sorted shingle arrays are cut into blocks,
   bounded both by nodes and by shingles, and dealt to tasks in pairs of blocks: every pair of a component is compared
   exactly once, no pair is emitted, and no task holds more than two blocks. Exact set intersections give each node's
   number of links and its linked component.

Most documents meet no other. Labels, nodes and texts that cannot pass the joins of steps 3 and 4 are left out by a bitmap
(:mod:`lorespark.llm.sieve`) before they are shuffled.

Extra columns are ignored. Null texts count as empty. Rows with the same id are separate documents. A class is named
by its least doc_id (null if all are null). Very long texts are read whole; one text's shingles (8 bytes a word) are the
least that a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.components import components
from lorespark.llm.scratch import Workspace, fresh, prepare, text_version
from lorespark.llm.sieve import thinned
from lorespark.llm.words import Words, mix, run_hashes, slices

SHINGLE = 5
THRESHOLD = 0.8
TREES = 40
DEPTH = 8
TARGET_RECALL = 0.99999
#: A block has about so many nodes and shingles at most (one longer text is a block of its own).
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: A min-hash is cut to so many bits; a label of DEPTH of them is a long.
BITS = 8


def recall_at(prefix: int, similarity: float, trees: int = TREES) -> float:
    """The chance that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The least similarity at or above the threshold that a set of that size can have with any other."""
    unions = range(max(size, 1), int(size / threshold) + 2)
    near = (shared / union for union in unions for shared in range(int(threshold * union), int(threshold * union) + 2) if shared <= size)
    return min((s for s in near if s >= threshold), default=1.0)


@lru_cache(maxsize=4096)
def stop_depth(size: int, trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> int:
    """The longest prefix at which a set of that size meets any other at or above the threshold with the target recall.

    Sets of 64 and more are treated as if a partner exactly at the threshold existed.
    """
    similarity = least_similarity(size, threshold) if size < 64 else threshold
    length = depth
    while length > 1 and recall_at(length, similarity, trees) < recall:
        length -= 1
    return length


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, and the bounds of the texts in them."""
    starts, first = words.windows(SHINGLE)
    hashes = run_hashes(words.hashes, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if not len(short):
        return hashes, first
    whole = [int.from_bytes(words.digest(words.first[i], words.first[i + 1])[:8], "little") for i in short]
    return np.insert(hashes, first[short], np.array(whole, np.uint64)), first + np.searchsorted(short, np.arange(len(first)))


def _labels(shingles: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The label of each text in every tree."""
    rng = np.random.default_rng(7)
    masks = rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint64).astype(np.uint32)
    factors = (rng.integers(0, 1 << 32, (trees, depth), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    labels = np.zeros((len(first), trees), np.uint64)
    work = np.empty_like(short)
    for t in range(trees):
        for k in range(depth):
            np.bitwise_xor(short, masks[t, k], out=work)
            np.multiply(work, factors[t, k], out=work)
            least = mix(np.minimum.reduceat(work, first).astype(np.uint64) + np.uint64(k)) >> np.uint64(64 - BITS)
            labels[:, t] |= least << np.uint64(64 - BITS * (k + 1))
    return labels


def _node_ids(words: Words) -> list[bytes]:
    """A digest of each text's word sequence."""
    return [words.digest(a, b) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]


def _source(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), text_version(text).alias("version"))


def signatures(documents: DataFrame, trees: int = TREES, depth: int = DEPTH, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, version, node, size, stop, labels``: the document's node (16 bytes), the number of shingles, the prefix at
    which its descent stops, and its label in every tree (null if it has no words)."""
    prepare(documents.sparkSession)
    source = _source(documents, id_column, text)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words = Words(batch.column("text"))
            shingles, first = _shingles(words)
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            labels = _labels(shingles, first[full], trees, depth) if len(full) else np.zeros((0, trees), np.uint64)
            slots = np.full(batch.num_rows, -1)
            slots[full] = np.arange(len(full))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(labels.view(np.int64).ravel()), trees).cast(pa.list_(pa.int64()))
            listed = listed.take(pa.array(slots, mask=slots < 0))
            stops = [stop_depth(min(s, 64), trees, depth, threshold, recall) for s in sizes.tolist()]
            arrays = [batch.column("doc_id"), batch.column("version"), pa.array(_node_ids(words), pa.binary()), pa.array(sizes, pa.int64()), pa.array(stops, pa.int32()), listed]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "version", "node", "size", "stop", "labels"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(sign, f"doc_id {kind}, version binary, node binary, size bigint, stop int, labels array<bigint>")


def _trie_node(length: int) -> Column:
    """A hash of the tree's number and the label's first min-hashes."""
    return F.xxhash64("tree", F.shiftrightunsigned("label", 64 - BITS * length)).alias("at")


def candidate_edges(nodes: DataFrame, work: Workspace, depth: int = DEPTH) -> DataFrame:
    """nodes: node, stop, labels. Edges ``a, b`` from each node to the least member of every trie node it is matched in."""
    shortest = nodes.agg(F.min("stop")).first()[0] or depth
    named = nodes.where("labels is not null").withColumn("name", F.xxhash64("node"))
    labels = named.select("name", F.posexplode("labels").alias("tree", "label")).select("name", "tree", _trie_node(shortest))
    crowded = work.write(labels.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at"), "crowded")
    # Few labels are crowded, and few nodes have any: the others are left out before they would be shuffled. (An inner
    # join with distinct keys: Spark would push a semi-join below the bitmap.)
    trees = thinned(labels, [F.col("at")], crowded, [F.col("at")]).join(crowded, "at").groupBy("name").agg(F.collect_set("tree").alias("trees"))
    trees = work.write(trees, "trees")
    matched = thinned(named, [F.col("name")], trees, [F.col("name")]).join(trees, "name").select("node", "stop", "labels", F.explode("trees").alias("tree"))
    matched = work.write(matched.select("node", "stop", "tree", F.element_at("labels", F.col("tree") + 1).alias("label")), "matched")
    edges = None
    for length in range(depth, shortest - 1, -1):
        going_on = matched.where(F.col("stop") <= length).withColumn("at", _trie_node(length))
        least = work.write(going_on.groupBy("at").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("at", "least"), f"least{length}")
        found = going_on.join(least, "at").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
        edges = found if edges is None else edges.union(found)
    return edges.distinct()


def linked_pairs(shingles: np.ndarray, bounds: np.ndarray, threshold: float) -> np.ndarray:
    """The boolean matrix of pairs of sets (of distinct hashes) with at least the threshold's similarity."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    number, owner = number[shared], owner[order][shared]
    if len(number):
        number = np.cumsum(np.concatenate(([True], number[1:] != number[:-1]))) - 1
    common = np.zeros((len(sizes), len(sizes)), np.float32)
    width = 4096
    at = 0
    while at < len(number):
        to = int(np.searchsorted(number, number[at] + width))
        part = np.zeros((len(sizes), width), np.float32)
        part[owner[at:to], number[at:to] - number[at]] = 1
        common += part @ part.T
        at = to
    both = common.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - both
    out = both / np.maximum(union, 1) >= threshold
    np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    label = np.arange(len(linked))
    while True:
        nearest = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        least = np.minimum(label, nearest)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _verify(rows: list[tuple], threshold: float) -> list[tuple]:
    """rows: (block, node, copies, set) of two blocks, or of one. Returns (node, links, root) for each linked node."""
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    linked = linked_pairs(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), threshold)
    blocks = np.array([r[0] for r in rows])
    if blocks[0] != blocks[-1]:
        linked &= blocks[:, None] != blocks[None, :]
    links = linked @ np.array([r[2] for r in rows], np.int64)
    root = _roots(linked)
    return [(rows[i][1], int(links[i]), rows[root[i]][1]) for i in np.flatnonzero(linked.any(axis=1))]


def _verified(dealt: DataFrame, threshold: float) -> DataFrame:
    names, types = ("node", "links", "root"), (pa.binary(), pa.int64(), pa.binary())
    columns = ("group", "low", "high", "block", "node", "copies", "shingles")

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(batch.column(c).slice(at, 64).to_pylist() for c in columns), strict=True)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, rows in groupby((row for batch in batches for row in rows_of(batch)), key=lambda r: r[:3]):
            found += _verify([r[3:] for r in rows], threshold)
            if len(found) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names=names)

    return dealt.mapInArrow(verify, "node binary, links bigint, root binary")


def _shingle_sets(read: DataFrame) -> DataFrame:
    """read: group, block, blocks, node, copies, text. The text's sorted distinct shingles in its place."""
    kept = ("group", "block", "blocks", "node", "copies")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            shingles, first = _shingles(words)
            sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            right = pa.array([mine == node for mine, node in zip(_node_ids(words), batch.column("node").to_pylist(), strict=True)], pa.bool_())
            whole = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])
            yield whole.filter(right)

    return read.mapInArrow(gather, "group binary, block int, blocks int, node binary, copies bigint, shingles binary")


def similar_documents(
    documents: DataFrame,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = TARGET_RECALL,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, class_id, copy_id, n_links``.

    ``class_id`` is the least doc_id of its linked component, ``copy_id`` that of the documents with the same words,
    and ``n_links`` the number of other documents linked with it, copies included. See the module docstring.
    """
    if depth * BITS > 64:
        raise ValueError(f"a label has {64 // BITS} min-hashes at most")
    work = Workspace(documents.sparkSession, "ngrams")
    signed = work.write(signatures(documents, trees, depth, id_column, text, threshold, recall), "signatures")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keeper = F.min(F.struct("doc_id", "version"))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), keeper.alias("keeper"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("stop").alias("stop"), F.first("labels").alias("labels"))
    nodes = work.write(nodes, "nodes")

    candidates = components(work.write(candidate_edges(nodes, work, depth), "edges"))
    candidates = work.write(candidates.withColumnRenamed("root", "group").join(nodes.select("node", "keeper", "copies", "size"), "node"), "candidates")
    work.drop("crowded", "trees", "matched", "edges")

    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / block_shingles)).cast("int")
    placed = candidates.join(work.write(candidates.groupBy("group").agg(blocks.alias("blocks")), "sizes"), "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A node's text is that of one row; _shingle_sets leaves out a row whose words are not the node's.
    # Only texts that may be a candidate's are shuffled.
    keeper = F.col("keeper")
    source = thinned(_source(documents, id_column, text), [F.col("doc_id"), F.col("version")], candidates, [keeper.doc_id, keeper.version])
    own = source.doc_id.eqNullSafe(placed.keeper.doc_id) & source.version.eqNullSafe(placed.keeper.version)
    sets = _shingle_sets(source.join(placed, own).select("group", "block", "blocks", "node", "copies", "text"))
    sets = work.write(sets.dropDuplicates(["node"]), "sets")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")))
    dealt = sets.withColumn("pair", F.explode(pairs)).select("group", "pair.low", "pair.high", "block", "node", "copies", "shingles")
    dealt = dealt.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high", "block", "node")
    verified = work.write(_verified(dealt, threshold), "verified")
    work.drop("candidates", "sizes", "sets")

    roots = work.write(components(verified.select(F.col("root").alias("a"), F.col("node").alias("b"))), "roots")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    plain = nodes.select("node", "copy_id", "copies")
    named = work.write(roots.join(plain, "node").groupBy("root").agg(F.min("copy_id").alias("class_id")), "named")
    classes = plain.join(roots.join(named, "root").select("node", "class_id"), "node", "left").join(links, "node", "left")
    classes = work.write(classes.select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    work.drop("nodes", "verified", "roots", "named")
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "copy_id", "n_links")


def measured_recall(documents: DataFrame, found: DataFrame, every: int = 50, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """(links found, links there are) of the documents whose id is divisible by ``every``, by comparing each of them with
    all rows: the sets of these documents are cut to blocks and every row's set is held against them.

    found: the result of :func:`similar_documents`. For tests and reports; ids must be unique.
    """
    source = _source(documents, id_column, text).where("doc_id is not null")
    asked = source.where(F.col("doc_id") % every == 0).select("doc_id", "text")
    grams = lambda d, name: d.select(F.col("doc_id").alias(name), F.explode(_gram_set("text")).alias("g"))
    sizes = source.select("doc_id", F.size(_gram_set("text")).alias("n"))
    met = grams(asked, "a").join(grams(source, "b"), "g").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    near = met.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("x")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("y")), "b")
    there = near.where(F.col("c") / (F.col("x") + F.col("y") - F.col("c")) >= threshold).groupBy("a").agg(F.count("*").alias("there"))
    words = source.where(F.col("doc_id") % every == 0).where(F.size(_gram_set("text")) > 0)
    joined = words.select("doc_id").join(found.select("doc_id", "n_links"), "doc_id").join(there, F.col("a") == F.col("doc_id"), "left")
    row = joined.agg(F.sum(F.least("n_links", F.coalesce("there", F.lit(0)))).alias("f"), F.sum(F.coalesce("there", F.lit(0))).alias("t")).first()
    return int(row.f or 0), int(row.t or 0)


def _gram_set(text: str) -> Column:
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda k: F.array_join(F.slice(words, k, SHINGLE), " "))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def one_of_each_class(documents: DataFrame, **options) -> DataFrame:
    """One row of each class: the one with the least id, and of those the one with the least digest of the text.

    Rows are told apart by id and text, so rows that share an id, or have none, are separate documents here too. Rows
    without an id go through the same join; one of them stays in each class, whether or not a row with an id does.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), text_version().alias("version"))
    name = fresh(documents, "_key")
    keyed = documents.withColumn(name, key)
    found = similar_documents(keyed.select(name, "text"), id_column=name, **options)
    best = found.groupBy("class_id", "doc_id.unnamed").agg(F.min("doc_id").alias("best")).select("best")
    kept = keyed.join(best, keyed[name].eqNullSafe(best.best), "left_semi").dropDuplicates([name])
    return kept.select(*(F.col(f"`{c}`") for c in documents.columns))
