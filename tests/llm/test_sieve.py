"""The bitmap before joins that few rows pass: no row is lost, and little is shuffled."""

import random

from pyspark.sql import functions as F

from lorespark.llm import ngram_join, sieve


def written(spark) -> int:
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_thinned_keeps_what_the_join_keeps(spark, monkeypatch):
    rows = spark.range(100_000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"))
    few = rows.where("a is null or a % 500 = 0").select(F.struct(F.col("a").alias("x"), F.col("b").alias("y")).alias("key"))
    for most, limit in ((2048, 10_000), (1, 100_000)):
        monkeypatch.setattr(sieve, "MOST_PARTS", most)
        left = sieve.thinned(rows, [F.col("a"), F.col("b")], few, [F.col("key.x"), F.col("key.y")])
        assert left.columns == rows.columns and left.count() < limit
        assert left.where("a is null or a % 500 = 0").count() == few.count() == 200
    assert sieve.thinned(rows, [F.col("a")], few.limit(0), [F.col("key.x")]).count() == 0


def test_thinned_with_more_keys_than_bits(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_PARTS", 1)
    rows = spark.range(200_000)
    few = rows.where("id % 2 = 0")
    assert sieve.thinned(rows, [F.col("id")], few, [F.col("id")]).where("id % 2 = 0").count() == 100_000


def test_texts_without_neighbours_are_not_shuffled(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n))
    texts = [words(1000) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " end"), (301, texts[9]), (None, texts[11] + " end"), (302, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables that are too large to be broadcast
    try:
        before = written(spark)
        found = ngram_join.similar_documents(documents).collect()
        moved = written(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    linked = {(r.doc_id, r.class_id, r.n_links) for r in found if r.n_links}
    assert len(found) == 304 and linked == {(7, 7, 1), (300, 7, 1), (9, 9, 1), (301, 9, 1), (11, 11, 1), (None, 11, 1)}
    assert moved < 0.5 * sum(len(t or "") for _, t in rows)
