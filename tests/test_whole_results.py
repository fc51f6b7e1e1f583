"""Queries give whole results: rows that a modulus, a floor, a filter or a sample once left out."""

import duckdb

from lorespark.plans import texts


def saved(folder, **tables):
    """A folder of tables, each from the SQL of its rows."""
    for name, sql in tables.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_containment_of_every_item_in_every_conversation(spark, tmp_path):
    items = "(1::BIGINT, 'abcd'), (41, 'abab'), (199, 'zzz'), (200, 'q'), (5000, 'cdx')"
    turns = "(1::BIGINT, 0::BIGINT, 'assistant', 'abc'), (1, 1, 'user', 'zzz'), (1, 2, 'assistant', 'cd'), (41, 0, 'assistant', 'xab ab'), (41, 1, 'assistant', 'ab')"
    d = saved(tmp_path, benchmark=f"FROM (VALUES {items}) t(item_id, text)", conversations=f"FROM (VALUES {turns}) t(conv_id, turn, role, text)")
    found = {(r.item_id, r.conv_id, r.contained) for r in texts.containment_grounding(spark, d).collect()}
    third = lambda n: round(n / 3, 6)
    assert found == {(1, 1, 1.0), (1, 41, third(1)), (41, 1, third(1)), (41, 41, 1.0), (199, None, 0.0), (200, None, None), (5000, 1, 0.5)}


def test_orders_beyond_30_days_are_counted_by_date(spark, tmp_path):
    dates = "(DATE '2020-03-31'), ('2020-03-31'), ('2020-03-30'), ('2020-03-02'), ('2020-03-01'), ('2019-12-31'), ('2019-12-31')"
    d = saved(tmp_path, orders=f"SELECT row_number() OVER () AS o_orderkey, o_orderdate::TIMESTAMP AS o_orderdate FROM (VALUES {dates}) t(o_orderdate)")
    found = {tuple(r) for r in texts.time_ago(spark, d).collect()}
    assert found == {("1시간 전", 2), ("1일 전", 1), ("29일 전", 1), ("2020. 03. 01", 1), ("2019. 12. 31", 2)}


def test_rare_stems_are_in_the_lexicon(spark, tmp_path):
    d = saved(tmp_path, documents="SELECT 1::BIGINT AS doc_id, 'once (twice,' || chr(10) || 'twice ' || repeat('often ', 20) AS text, 'en' AS lang, 's' AS source")
    assert {tuple(r) for r in texts.lexicon_counts(spark, d).collect()} == {("once", 1), ("twice", 2), ("often", 20)}


def test_pieces_by_a_pattern(spark, sf_dir):
    """All substrings of a length by code points; no expression is evaluated for every character of a document."""
    from pyspark.sql import functions as F

    from lorespark.functions.similarity import pieces_of_key

    keys = ["", "ab", "abcd", "a𝒳𝒴b", "𝒳", "가\n나\x00다", "é‍x"]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    for n in (1, 2, 3):
        assert [r[0] for r in frame.select(pieces_of_key(F.col("k"), n)).collect()] == [[k[i : i + n] for i in range(len(k) - n + 1)] for k in keys]
    assert "lambda" not in texts.excerpt_in_context(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
