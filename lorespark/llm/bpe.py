"""BPE encoding and decoding by a trie of distinct words.

The normaliser and word splitter are those of the tokenizer file. The words themselves are encoded here: distinct words
go into a trie (words in sorted order share their prefixes' nodes), and a depth-first walk carries, for every prefix,
the last token of its encoding. That token is the only one which ends the prefix and may follow the last token of what
is left before it, so a prefix shared by many words is encoded once, and a word's tokens are read off backwards.

Whole texts are encoded; null counts as empty. A text is cut at ASCII white space, which no token and no word of the
splitter crosses, so that a piece's ids can be kept while a task goes through its texts. Repeated rows give repeated
results; extra columns are kept by :func:`encoded`. The walk is made for one kind of file (:data:`FORM`); texts of any
other file are encoded and decoded by the library itself.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorespark.llm.scratch import prepare
from lorespark.llm.words import gathered, held, slices, split_words

#: Pieces kept per Python worker; the store is emptied when it is full, which changes nothing but speed.
KEEP = 300_000
#: Answers about pairs of tokens kept per worker, emptied likewise.
KEEP_PAIRS = 400_000
#: The kind of tokenizer file that the walk is made for. Fixed values of the file's format.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False},
}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TrieEncoder:
    """Encodes words (tuples of symbols, the last with the word-end mark) by shared prefixes."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable, suffix: str):
        self.ids = vocabulary
        self.suffix = suffix
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.endings = {token[k:] for token in vocabulary for k in range(len(token))}
        self.possible: dict[str, bool] = {}
        self.follows: dict[int, bool] = {}

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the best-ranked pair first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == len(self.rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _letters(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.symbols(token[: -len(self.suffix)])
        return list(token)

    def occurs(self, token: str) -> bool:
        """Whether the token's own letters merge into it."""
        known = self.possible.get(token)
        if known is None:
            known = self.possible[token] = self.merge(self._letters(token)) == [token]
        return known

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the letters of two tokens merge into just these two."""
        pair = self.ids[a] << 32 | self.ids[b]
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= KEEP_PAIRS:
                self.follows.clear()
            known = self.follows[pair] = self.merge([*self._letters(a), *self._letters(b)]) == [a, b]
        return known

    def _last(self, path: list[str], last: list[str]) -> str:
        """The last token of the encoding of ``path``; ``last``: those of its shorter prefixes, from the empty one."""
        token = ""
        for at in range(len(path) - 1, -1, -1):
            token = path[at] + token
            if token not in self.endings:
                break
            if token in self.ids and self.occurs(token):
                before = last[at]
                if not before or self.may_follow(before, token):
                    return token
        raise ValueError(f"no token ends {path!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct word, in one walk over their trie.

        In sorted order the words are the trie's leaves from left to right: what two neighbours share is the path that
        the walk keeps, so a node is entered once.
        """
        out = {}
        path: list[str] = []
        last: list[str] = [""]
        for word in sorted(set(words)):
            symbols = self.symbols(word)
            shared = 0
            while shared < min(len(path), len(symbols)) and path[shared] == symbols[shared]:
                shared += 1
            del path[shared:], last[shared + 1 :]
            for symbol in symbols[shared:]:
                path.append(symbol)
                last.append(self._last(path, last))
            tokens = [last[-1]]
            at = len(path) - len(self._letters(last[-1]))
            while at:
                tokens.append(last[at])
                at -= len(last[at])
            tokens.reverse()
            out[word] = tokens
        return out


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes: visible Latin-1 characters for themselves, then 256, 257, ... in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTES = _byte_alphabet()


def _latin_splitter() -> re.Pattern:
    """The tokenizer file's splitter for texts of characters below U+0180."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x180)):
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += c
    letters, numbers = kinds["L"], kinds["N"]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


LATIN = _latin_splitter()
#: Characters that the short way leaves to the library.
NOT_LATIN = re.compile("[^\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]|<\\|")


def is_walkable(config: dict) -> bool:
    """Whether a tokenizer file is of the kind that the walk is made for."""
    model = {key: config["model"].get(key) for key in FORM["model"]}
    specials = all(t["content"].startswith("<|") and not t["normalized"] and not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in config["added_tokens"])
    return specials and model == FORM["model"] and all(config.get(key) == FORM[key] for key in ("normalizer", "pre_tokenizer", "decoder"))


class LibraryEncoder:
    """Encodes and decodes whole texts by the library."""

    def __init__(self, library):
        self.library = library
        library.no_padding()
        library.no_truncation()

    def encode(self, texts: pa.Array) -> tuple[list[bytes], list[str]]:
        ids = [e.ids for e in self.library.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return [struct.pack(f"<{len(i)}I", *i) for i in ids], [self.library.decode(i, skip_special_tokens=False) for i in ids]


class PieceEncoder:
    """Ids of white-space pieces, kept while they are of use."""

    def __init__(self, library, config: dict):
        model = config["model"]
        # Not the library's own model, which takes more memory than all else here.
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.trie = TrieEncoder(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        tokens = [""] * (max([*model["vocab"].values(), *self.specials.values()]) + 1)
        for token, number in [*model["vocab"].items(), *self.specials.items()]:
            tokens[number] = token
        self.tokens = pa.array(tokens, pa.string())
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        """The splitter's words of a piece, in the byte alphabet; special tokens as they are."""
        if not NOT_LATIN.search(text):
            return [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in LATIN.findall(text.lower())]
        for special in self.specials:
            if special in text:
                head, _, tail = text.partition(special)
                return [*self._split(head), special, *self._split(tail)]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def learn(self, pieces: list[bytes]) -> None:
        """Encode the pieces that are not known yet."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > KEEP:
            self.pieces.clear()
            self.words.clear()
            new = pieces
        split = {piece: self._split(piece.decode()) for piece in new}
        missing = {w for words in split.values() for w in words} - self.words.keys() - self.specials.keys()
        ids = self.trie.ids
        for word, tokens in self.trie.encode_words(missing).items():
            self.words[word] = struct.pack(f"<{len(tokens)}I", *map(ids.__getitem__, tokens))
        for special, number in self.specials.items():
            self.words[special] = struct.pack("<I", number)
        known = self.words
        for piece, words in split.items():
            self.pieces[piece] = b"".join([known[w] for w in words])

    def encode(self, texts: pa.Array) -> tuple[list[bytes], pa.Array]:
        """The ids of each text, little-endian in 32 bits each, and the text they are decoded to: as the file has no
        decoder, the tokens, word-end marks included, joined by a space."""
        pieces, index, bounds = split_words(texts)
        self.learn(pieces)
        ids, bounds = gathered([self.pieces[p] for p in pieces], "<u4", index, bounds)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), self.tokens.take(pa.array(ids)))
        ends = bounds.tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pc.binary_join(lists, " ")


def _encoder(path: str) -> PieceEncoder | LibraryEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    library = Tokenizer.from_file(path)
    return PieceEncoder(library, config) if is_walkable(config) else LibraryEncoder(library)


def encoder(path: str) -> PieceEncoder | LibraryEncoder:
    return held(f"bpe:{path}", lambda: _encoder(path))


def encoded(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The documents with ``ids`` (binary: little-endian 32-bit ids) and ``decoded`` (those ids as text)."""
    return _mapped(documents, path, text, [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())], lambda ids, decoded: (ids, decoded))


def digests(documents: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The documents' other columns with ``n_tokens, ids_sha256, decoded_sha256``; ids and decoded text stay in the task."""
    columns = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    made = _mapped(documents, path, text, columns, lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return made.drop(text)


def _mapped(documents: DataFrame, path: str | None, text: str, columns: list[tuple], form) -> DataFrame:
    prepare(documents.sparkSession)
    where = path or default_path()
    names = [c[0] for c in columns]
    kept = documents.select(*(documents[f"`{c}`"] for c in documents.columns if c not in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(where)
        for batch in slices(batches, text, 1 << 20):
            ids, decoded = coder.encode(batch.column(text))
            rows = [form(i, d.as_py() if isinstance(d, pa.Scalar) else d) for i, d in zip(ids, decoded, strict=True)]
            made = [pa.array([r[i] for r in rows], c[2]) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(c[0], c[1]) for c in columns)]))


def op10(documents: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    return digests(documents.select("doc_id", "text"))
