"""Operators on texts against plain Python versions, on the smallest tables and on awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from lorespark.llm import bpe, ngram_join, pii, substring_dedup, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))
AWKWARD = [
    (1, "a b c d e f g"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, LONG),
    (5, LONG),
    (6, LONG + " tail"),
    (7, "word " * 300),
    (8, "word " * 300),
    (9, "a b c d e f g"),
    (10, "x@y.org @ a.b@c-d.e.f@g.h 1.2.3.4.5.6.7.8 256.1.1.1 00012.1.1.1 4111 1111 1111 1111 +1 (706) 555-3138 +123 +12 ++49 30 12345678."),
    (None, "no id here at all"),
    (None, None),
    (11, "é ü 日本 🎉 it's DON'T İstanbul <|endoftext|>x y \x1c\u0085 é"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n_email", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("ids", T.IntegerType())])


@pytest.fixture(scope="module", params=["awkward", "table", "empty"])
def documents(request, spark, sf_dir):
    if request.param == "table":
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, t, "x", "y", "z", 1) for i, t in AWKWARD] if request.param == "awkward" else []
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def brute_pii(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    kinds = [k for _, k, _ in spans]
    listed = ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(kinds.count(k) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest())


def test_pii(documents):
    found = pii.op1(documents).collect()
    same([tuple(r)[:6] for r in found], [(i, *brute_pii(t)) for i, t in rows_of(documents)])
    for r in found:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE_KINDS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert {"doc_id", "text", "node", "n_email"} <= set(pii.find_pii(documents).columns) or "node" not in documents.columns


@pytest.mark.parametrize("text", [
    "see https://example.org/a?b=1. Then", "IBAN DE89 3704 0044 0532 0130 00 ok", "account no. 1234-567-890 end",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "lives at 12 North Oak Street now", "a@b.c" * 50, "1.2.3.4" * 40, "+1 2345678901 4 5 6 7", "9" * 5000, "." * 2000,
])
def test_pii_added_spans_leave_base_ones(text):
    spans = pii.find_spans(text)
    base = [s for s in spans if s[0] in pii.BASE_KINDS]
    assert (*(sum(s[0] == k for s in base) for k in pii.BASE_KINDS), hashlib.sha256(pii._joined(base).encode()).hexdigest()) == brute_pii(text)
    assert pii.redact(text, spans) != text or not spans


def test_pii_kinds():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("see https://example.org/a?b=1. Then") == ["url"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert kinds("account no. 1234-567-890 end") == ["account"]
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == ["secret"]
    assert kinds("lives at 12 North Oak Street now") == ["address"]


@pytest.mark.parametrize("unit", ["token-", "ACCOUNT ", "account no. ", "http://", "+1 ", "a@", "1.", "iban DE89 ", "12 North Oak Street "])
def test_cue_runs_take_linear_time(unit):
    import time

    began = time.process_time()
    pii.find_spans(unit * 100_000)
    assert time.process_time() - began < 20


def test_redaction_keeps_columns(documents):
    redacted = pii.redact_pii(documents)
    assert redacted.schema == documents.schema
    assert redacted.count() == documents.count()


def brute_classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (both / (len(sets[i]) + len(sets[j]) - both) if sets[i] or sets[j] else 1.0) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i in range(n):
        least[top(i)].append(rows[i][0])
    return [(rows[i][0], min((x for x in least[top(i)] if x is not None), default=None), links[i]) for i in range(n)]


@pytest.mark.parametrize("block", [256, 2])
def test_similar_documents(documents, block):
    found = ngram_join.similar_documents(documents, block=block).collect()
    same([(r.doc_id, r.class_id, r.n_links) for r in found], brute_classes(rows_of(documents)))


def test_one_of_each_class(spark):
    documents = spark.createDataFrame([(3, "a b c d e f", "k"), (1, "a b  c d e f", "l"), (1, "a b c d e f", "m"), (2, "other text", "n"), (None, "other text", "o")], "doc_id long, text string, extra string")
    kept = ngram_join.one_of_each_class(documents)
    assert kept.columns == documents.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 2, None]


def test_prefix_shortens_until_recall():
    from fractions import Fraction

    for size in range(1, 64):
        around = [Fraction(shared, union) for union in range(size, 2 * size + 2) for shared in range(size + 1)]
        assert ngram_join.least_similarity(size) == pytest.approx(float(min(s for s in around if s >= Fraction(8, 10))))
        stop = ngram_join.stop_depth(size)
        recall = lambda d: ngram_join.recall_at(d, ngram_join.least_similarity(size))  # noqa: B023, E731
        assert recall(stop) >= ngram_join.TARGET_RECALL and (stop == ngram_join.DEPTH or recall(stop + 1) < ngram_join.TARGET_RECALL)
    assert ngram_join.stop_depth(3) == ngram_join.DEPTH > ngram_join.stop_depth(7) - 1 and ngram_join.stop_depth(64) < ngram_join.DEPTH
    lengths = [ngram_join.stop_depth(64, recall=r) for r in (0.5, 0.9, 0.999, 0.99999, 0.99999999)]
    assert lengths == sorted(lengths, reverse=True)


def test_measured_recall(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, there = ngram_join.measured_recall(documents, ngram_join.similar_documents(documents), every=10)
    print(f"links of every tenth document: {found} of {there}")
    assert there and found == there


def thue_morse(n):
    """A word of n letters and its complement, equal under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_patterned_words_are_told_apart(spark, n):
    x, y = thue_morse(n)
    head = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{head} {x}"), (2, f"{head} {y}"), (3, x), (4, y), (5, " ".join(x)), (6, " ".join(y))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    same([tuple(r) for r in substring_dedup.op4(documents).collect()], brute_dedup(rows))
    same([(r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(documents).collect()], brute_classes(rows))


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 0])
def test_repeated_rows_without_id_stay_linear(spark, hot):
    counts = {}
    text = " ".join(f"w{k * 31 % 997}" for k in range(120))
    for m in (100, 400):
        rows = [(None, text)] * m + [(7, text + " and more"), (8, "x " + text)]
        work = substring_dedup.Workspace(spark, "probe")
        documents = spark.createDataFrame(rows, "doc_id long, text string")
        substring_dedup.duplicate_windows(documents, hot=hot, work=work).collect()
        counts[m] = sum(spark.read.parquet(work.path(t)).count() for t in ("index", "firsts", "texts", "windows", "found"))
        same([tuple(r) for r in substring_dedup.remove_duplicates(documents, hot=hot).drop("kept").collect()], brute_dedup(rows))
    assert counts[400] < 5 * counts[100]


def test_factors_extend_and_straddling_windows_are_looked_up():
    reference, index = b"a b c d e f g h", {}
    found, own = substring_dedup.factors(reference, 3, index)
    assert not found and [w for w, _, _ in own] == [b"a b c", b"b c d", b"c d e", b"d e f", b"e f g", b"f g h"]
    index |= {w: (words, at) for w, words, at in own}
    other, own = substring_dedup.factors(b"f g h x y", 3, index)
    index |= {w: (words, at) for w, words, at in own}
    found, own = substring_dedup.factors(b"z a b c d e f g h x q", 3, index)
    # One long factor, then the window across its end that another reference has.
    assert found == [(1, 8), (7, 3)] and [w for w, _, _ in own] == [b"z a b", b"h x q"]


def brute_dedup(rows, size=50):
    first = {}
    low = lambda i: (i is not None, i or 0)
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key not in first or low(i) < low(first[key]):
                first[key] = i
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if low(first[tuple(w[k : k + size])]) < low(i):
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 0])
def test_substring_dedup(documents, hot):
    found = substring_dedup.remove_duplicates(documents.select("doc_id", "text"), hot=hot).drop("kept").collect()
    same([tuple(r) for r in found], brute_dedup(rows_of(documents)))


@pytest.mark.parametrize("size,hot", [(3, substring_dedup.HOT), (12, substring_dedup.HOT), (12, 0), (12, 40)])
def test_substring_dedup_small_windows(spark, size, hot):
    import random

    rng = random.Random(size)
    rows = [(i % 17, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(100 + i, "p q r s t u v w x y z a b c " * (i + 1)) for i in range(3)]
    found = substring_dedup.remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, hot=hot).drop("kept").collect()
    same([tuple(r) for r in found], brute_dedup(rows, size))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe(documents, library):
    wanted = []
    for i, t in rows_of(documents):
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in bpe.op10(documents).collect()], wanted)


def test_bpe_leaves_other_files_to_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    documents = spark.createDataFrame([(i, t) for i, t in AWKWARD if t != LONG], "doc_id long, text string")
    wanted = []
    for i, t in rows_of(documents):
        ids = other.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, struct.pack(f"<{len(ids)}I", *ids), other.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encoded(documents, path).collect()], wanted)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_store_encoder_is_the_library(name):
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(public_tokenizers.path(name)), token_store.Encoder(public_tokenizers.path(name))
    texts = [t for _, t in AWKWARD if t != LONG] + ["Ünïcode ÀÉ× a×b µm ªº naïve\u0301 ﬁ ß ſ K Å'S it'S (a) --b-- <x> q_r \u200b\u3000z", "A" * 3000, "don't 's 'S"]
    for text, raw in zip(texts, mine.encode(pa.array(texts, pa.string()), None), strict=True):
        assert list(struct.unpack(f"<{len(raw) // mine.width}{mine.form}", raw)) == library.encode(text or "", add_special_tokens=False).ids or name.startswith("byte")


def test_token_store(documents, library):
    rows = sorted(rows_of(documents), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    wanted, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    same([tuple(r) for r in token_store.op3(documents).collect()], wanted)


def test_token_store_reads_single_documents(spark, tmp_path, library):
    documents = spark.createDataFrame([(i, f"word number {i} of many") for i in range(50)], "doc_id long, text string")
    token_store.write_store(documents, f"file://{tmp_path}/store")
    got = {r.doc_id: list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in token_store.read_documents(spark, f"file://{tmp_path}/store", [7, 31]).collect()}
    assert got == {i: [*library.encode(f"word number {i} of many", add_special_tokens=False).ids, 2] for i in (7, 31)}


def test_shard_refuses_another_dictionary():
    data = token_store._pack(b"x" * 16, 2, 0, [], [])
    with pytest.raises(ValueError):
        token_store.Shard(data, b"")
