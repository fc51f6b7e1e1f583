"""Token counts, clustering and fill-in-the-middle against plain versions, the library, and round trips."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import clusters, fill_middle, token_count
from tests.llm.test_text_operators import AWKWARD, SCHEMA, rows_of, same


@pytest.fixture(scope="module", params=["awkward", "table", "empty"])
def documents(request, spark, sf_dir):
    if request.param == "table":
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, t, "x", "y", "z", 1) for i, t in AWKWARD] if request.param == "awkward" else []
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def library_count(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        return lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path(name))
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


# ---- token counts ---------------------------------------------------------------------------------------------------


def test_token_counts(documents):
    count = library_count("word_bpe_49k.json")
    wanted = [(i, len((t or "").encode()), n := count(t or ""), n > 2048) for i, t in rows_of(documents)]
    same([tuple(r) for r in token_count.op11(documents).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()], wanted)


def huge_texts():
    draw = random.Random(5)
    words = ["it's", "DON'T", "'s'll", "naïve", "été", "日本語", "🎉🎉", "ㅎㅏㄴ", "각ᆨ", "12.50", "<|endoftext|>", "x<|endoftext|>y", "<|endof", "...", "a" * 40, " ", " ", "ab\x1ccd"]
    gaps = [" ", "  ", "\n", "\t \r\n", "", "　"]
    mixed = lambda n: "".join(draw.choice(words) + draw.choice(gaps) for _ in range(n))
    return [mixed(900), mixed(30), "letters" * 500 + " " + mixed(300), "b" * 5000, " " * 4000, "́" * 900 + mixed(100), "", mixed(400) + "c" * 1500 + mixed(400), "日本" * 1200]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk,overlap", [(200, 40), (64, 8)])
def test_spliced_chunks_count_as_the_library_does(spark, name, chunk, overlap):
    texts = huge_texts()
    count = library_count(name)
    documents = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(3)
    found = token_count.token_counts(documents, path(name), chunk=chunk, overlap=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: count(t) for i, t in enumerate(texts * 2)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_boundaries_are_stable(name):
    """The tokens on both sides of a boundary are those of either side alone."""
    count, coder, seen = library_count(name), token_count.counter(path(name)), 0
    for text in huge_texts()[:4]:
        text = text[:1500]
        ((at, before, total),) = coder.edges([text], [[(0, len(text))]])
        assert total == count(text)
        seen += len(at)
        for p, n in zip(at.tolist(), before.tolist(), strict=True):
            # A sentencepiece model puts a space before a text; it stands for that at the boundary.
            assert (count(text[:p]), count(text[p + name.endswith(".model") :])) == (n, total - n)
    assert seen > 10


def test_failed_seams_are_widened(spark, monkeypatch):
    tried = []
    real = token_count._cut
    monkeypatch.setattr(token_count, "_cut", lambda chunk, overlap: tried.append((chunk, overlap)) or real(chunk, overlap))
    texts = ["x" * 3000, "y z " * 800]
    found = token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk=100, overlap=20).collect()
    count = library_count("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in found} == {i: count(t) for i, t in enumerate(texts)}
    assert tried[:2] == [(100, 20), (100, 80)] and tried[-1][0] + tried[-1][1] >= 3000


def test_token_counts_keep_other_columns(spark):
    documents = spark.createDataFrame([(1, "a b", "x", 3), (2, None, "y", 4)], "doc_id long, text string, N_Tokens string, text_ int")
    found = token_count.token_counts(documents)
    assert sorted(found.columns) == ["doc_id", "n_bytes", "n_tokens", "over_limit", "text_"]
    same([(r.doc_id, r.text_, r.n_tokens) for r in found.collect()], [(1, 3, 2), (2, 4, 0)])
    with pytest.raises(ValueError):
        token_count.token_counts(documents, overlap=0)


# ---- fill in the middle ---------------------------------------------------------------------------------------------


def brute_middle(name, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


MARKED = [(i, t) for i in range(40, 60) for t in ("short <S> text", "<P", "<<M", "ab<P>", "日本🎉 é", "x", "a\x00b\r\n")]


def test_fill_in_the_middle(documents):
    wanted = [(i, *(f := brute_middle(i, t))[:4], sha(f[4]), sha(t or "")) for i, t in rows_of(documents)]
    same([tuple(r) for r in fill_middle.op13(documents).collect()], wanted)


@pytest.mark.parametrize("unit", [3, 7, 8192])
def test_texts_are_filled_and_restored(spark, unit):
    rows = [(i, t, "k", 1) for i, t in AWKWARD[:4] + AWKWARD[6:] + MARKED]
    documents = spark.createDataFrame(rows, "doc_id long, text string, key string, N int").repartition(4)
    filled = fill_middle.filled(documents, unit=unit)
    same([tuple(r) for r in filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()], [(i, *brute_middle(i, t)) for i, t, _, _ in rows])
    assert "N" not in filled.columns and filled.select("key").distinct().count() == 1
    same([(r.doc_id, r.text) for r in fill_middle.restored(filled, unit=unit).collect()], [(i, t or "") for i, t, _, _ in rows])
    digested = fill_middle.digests(documents, unit=unit).collect()
    assert all(r.restored_sha256 == sha(t or "") for r, (_, t, _, _) in zip(sorted(digested, key=lambda r: (str(r.doc_id), r.restored_sha256)), sorted(rows, key=lambda r: (str(r[0]), sha(r[1] or ""))), strict=True))


def test_columns_named_as_inner_ones_stay(spark):
    documents = spark.createDataFrame([(1, "some text", 7, 8, 9), (1, "some text", 6, 8, 9)], "doc_id long, text string, _id int, _of_text int, version int")
    found = fill_middle.digests(documents).collect()
    assert {(r["_id"], r["_of_text"], r.version) for r in found} == {(7, 8, 9), (6, 8, 9)} and len({r.output_sha256 for r in found}) == 1


def test_restored_from_other_outputs(spark):
    rows = [(1, "<P>a<S>c<M>b", "psm"), (1, "<P>a<S>c<M>b", "plain"), (2, None, None), (3, "<P>a", "psm"), (4, "<S>c<P>a<M>b", "spm")]
    found = fill_middle.restored(spark.createDataFrame(rows, "doc_id long, output string, form string"))
    same([tuple(r) for r in found.select("doc_id", "text").collect()], [(1, "abc"), (1, "<P>a<S>c<M>b"), (2, ""), (3, "<P>a"), (4, "abc")])


def test_one_shuffle_of_the_pieces(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = fill_middle._digested(fill_middle._pieces(fill_middle._keyed(documents, "doc_id", "text"), 8192, 1))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 3


def test_middles_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    same([tuple(r) for r in fill_middle.op13(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()], con.execute(fill_middle.SQL).fetchall())


# ---- clustering -----------------------------------------------------------------------------------------------------


def brute_clusters(rows, dims=64, k=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(at)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == c]:
                at[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = sum(f for f, _ in last)
    return [(i, c, f, sum(g for g, o in last if o == c), inertia, hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for (i, _), (f, c) in zip(kept, last, strict=True)]


def test_clusters(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    same([tuple(r) for r in clusters.op12(table).collect()], brute_clusters([(r.vec_id, r.embedding) for r in table.collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    same([tuple(r) for r in clusters.op12(table).collect()], con.execute(clusters.SQL).fetchall())


AWKWARD_VECTORS = [
    (1, [1.0, -2.0, 3.0], 7), (1, [1.0, -2.0, 3.0], 7), (1, [0.5, 0.0, -3.25], 7), (None, [9.0, 1.0, 1.0], 1), (None, [9.0, 1.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [1.0, None, 2.0], 1),
    (6, [float("nan"), 1.0, 1.0], 1), (7, [1.0, float("-inf"), 1.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0, 3.0, 4.0], 1), (10, [-0.001, 0.0, -0.0], 1),
]


@pytest.mark.parametrize("bits,rounds", [(1, 1), (3, 3), (8, 0)])
def test_clusters_of_awkward_rows(spark, bits, rounds):
    draw = random.Random(3)
    rows = AWKWARD_VECTORS + [(100 + i, [draw.gauss(3 * (i % 4), 1), draw.choice([0.0, 0.5]), 40.0 * (i == 7)], 2) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(5)
    found = clusters.clusters(table, dims=3, centroids=6, rounds=rounds, bits=bits)
    same([tuple(r) for r in found.collect()], brute_clusters([r[:2] for r in rows], 3, 6, rounds))


def test_clusters_of_few_equal_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([(1, [1.0, 2.0])], [(i, [0.25, -0.25]) for i in range(30)], [(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0])]):
        same([tuple(r) for r in clusters.clusters(spark.createDataFrame(rows, kind), dims=2).collect()], brute_clusters(rows, 2))
    empty = clusters.op12(spark.createDataFrame([], kind))
    assert empty.collect() == [] and empty.columns == clusters.clusters(spark.createDataFrame(rows, kind), dims=2).columns
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])]
    found = {r.vec_id: r for r in clusters.clusters(spark.createDataFrame(huge, kind), dims=2, centroids=1).collect()}
    assert found[1].distance > 1 << 58 and found[3].inertia == sum(r.distance for r in found.values())


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(2)
    matrix = np.concatenate((rng.integers(-300, 300, (400, 5)), rng.integers(-5000, 5000, (20, 5))))
    centroids = rng.integers(-400, 400, (7, 5))
    exact = ((matrix[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    shares = []
    for bits in (1, 2, 4, 6, 8):
        cells = clusters.Cells(matrix.min(0), matrix.max(0), matrix.mean(0), matrix[:400].std(0), bits)
        packed = cells.packed(matrix)
        assert packed.shape[1] == -(-5 * bits // 8) and (cells.unpacked(packed) == cells.numbers(matrix)).all()
        least, most = cells.tables(centroids)
        numbers = cells.numbers(matrix)
        low, high = (sum(t[d][numbers[:, d]] for d in range(5)) for t in (least, most))
        assert (low <= exact).all() and (exact <= high).all()
        candidates = cells.candidates(numbers, (least, most))
        assert (clusters.nearest(matrix, centroids, candidates)[0] == exact.argmin(axis=1)).all()
        shares.append((clusters.settled(candidates) < 0).mean())
    assert shares[0] > 0.9 and shares[-1] < 0.2 and shares == sorted(shares, reverse=True)


def test_full_vectors_are_fetched_only_where_needed(spark, sf_dir, monkeypatch):
    """Cells of a few bits settle most vectors of separate groups."""
    draw = np.random.default_rng(8)
    centres = draw.normal(0, 1, (4, 64))
    rows = [(i, (centres[i % 4] + draw.normal(0, 0.05, 64)).tolist()) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters.fetched_shares(table, np.floor(64 * centres).astype(int), bits=3) < 0.05
    same([tuple(r) for r in clusters.clusters(table, centroids=4, bits=3).collect()], brute_clusters(rows, k=4))


def test_entries(spark, sf_dir):
    from lorespark.llm import queries

    assert {"op11_token_counts", "op12_clusters", "op13_fill_middle"} <= set(queries.queries())
    assert {"op12_clusters", "op13_fill_middle"} <= set(queries.oracle_sql())
    assert queries.queries()["op11_token_counts"](spark, sf_dir).where(F.col("n_tokens").isNull()).count() == 0
