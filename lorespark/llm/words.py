"""Words of Arrow text columns, and hashes of words and of runs of words.

A word is a maximal run of bytes other than space and 0x09-0x0D, so no UTF-8 character is ever split. A word has a BLAKE2b
digest of 128 bits, whose first half is its hash. Hashes of runs are built by doubling, every step mixed by a bijection that
is not linear, so that no pattern of repeated words cancels out. Run hashes choose candidates and stand for shingles;
where words are removed or copies are told apart, digests or the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """This worker's one large helper: another name releases the helper before it, so that stages don't add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def digest(data: bytes) -> bytes:
    """Sixteen bytes that stand for the data."""
    return blake2b(data, digest_size=16).digest()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of hashes[i:i+size] for every i that has so many."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, width, level = None, 0, 1, hashes
    while True:
        if size & width:
            part = level[done : done + n]
            out = mix(part) if out is None else mix(out + part)
            done += width
        if done == size:
            return out
        level = mix(mix(level[:-width]) + level[width:])
        width *= 2


def split_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts (null: none), the number of every word in that list, and the texts' bounds in it.

    lower: whether letters of ASCII are put in lower case.
    """
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw.lower() if lower else raw)])
    lists = pc.ascii_split_whitespace(whole.view(pa.large_string()))
    flat = lists.flatten()
    inside = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if not inside.all():  # white space at a text's ends
        bounds = np.concatenate(([0], np.cumsum(inside)))[bounds]
        flat = flat.filter(pa.array(inside))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), bounds.astype(np.int64)


def gathered(cells: list[bytes], kind: str, index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the cells of words ``index``, one after the other, and the texts' bounds in them.

    cells: per distinct word, items of the numpy type ``kind``; index, bounds: as :func:`split_words` gives them.
    """
    items = np.frombuffer(b"".join(cells), kind)
    sizes = np.array([len(c) for c in cells], np.int64) // items.dtype.itemsize
    counts = sizes[index]
    ends = np.concatenate(([0], np.cumsum(counts)))
    places = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], counts)
    return items[places], ends[bounds]


class Words:
    """Words of some texts: digests (16 bytes in two columns), hashes (the first of them), and the words' range of each
    text."""

    __slots__ = ("digests", "first", "distinct", "index")

    def __init__(self, texts: pa.Array):
        self.distinct, self.index, self.first = split_words(texts)
        found = np.frombuffer(b"".join(map(digest, self.distinct)), "<u8").reshape(-1, 2)
        self.digests = found[self.index]

    @property
    def hashes(self) -> np.ndarray:
        return np.ascontiguousarray(self.digests[:, 0])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of every run of ``size`` words that lies in one text, and the first such run of each text."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        return np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts), first

    def digest(self, begin: int, end: int) -> bytes:
        """Sixteen bytes that stand for the words from ``begin`` to ``end``, by their digests."""
        return digest(self.digests[begin:end].tobytes())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) and the offsets of its texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most, or one longer text."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def binary_rows(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary cells data[bounds[i]:bounds[i+1]] (bounds in items) without a Python loop."""
    width = data.dtype.itemsize
    raw = np.ascontiguousarray(data)
    offsets = (np.asarray(bounds, np.int64) * width).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
