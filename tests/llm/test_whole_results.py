"""Operators give whole results: shared ids, statistics of all rows, distinct samples, queries sent to every block."""

from lorespark.llm import ngram_join, topk, url_filter


def test_suffix_statistics_are_those_of_all_pages(spark):
    urls = ["https://a.org/x"] * 3 + ["https://b.com/de/x"] * 2 + ["https://b.com/x"] * 5 + ["https://c.net/x"] * 10
    named = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("host", url_filter.host_of()).withColumn("path", url_filter.path_of())
    counts = url_filter.suffix_counts(named.withColumn("_rule", url_filter.rule_of(named.host, named.path)))
    assert {tuple(r) for r in counts.select("suffix", "pages", "ruled", "blocked").collect()} == {("org", 3, 3, 0), ("com", 7, 2, 2), ("net", 10, 0, 0)}


def test_url_sample_is_of_distinct_urls(spark):
    rules = (("allow", "good.com", "/"), ("block", "bad-bad.com", "/"))
    hosts = {"good.com": 0, "bad-bad.com": 1, "oood.com": 2, "baa-bad.com": 3}
    urls = [f"https://{h}/p{i}" for h in hosts for i in range(6)]
    pages = spark.createDataFrame([(n * 100 + c, u) for n, u in enumerate(urls) for c in range(20)], "page_id long, url string")
    found = url_filter.judged(pages, rules, max_labelled=12).where("rule is null").select("host", "verdict").distinct()
    assert {tuple(r) for r in found.collect()} == {("oood.com", "allow"), ("baa-bad.com", "block")}


def test_one_row_of_each_class_where_ids_are_shared_or_null(spark):
    a, b, c = (" ".join(f"{word}{i}" for i in range(60)) for word in "abc")
    rows = [(1, a), (1, b), (2, b + " end"), (3, a), (1, a), (None, c), (None, c + " end"), (None, c), (None, a + " end")]
    kept = ngram_join.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = [tuple(r) for r in kept if r.doc_id is not None]
    assert sorted(named) == [(1, a), (1, b)]
    assert sorted(r.text[0] for r in kept if r.doc_id is None) == ["a", "c"]


def test_packs_meet_blocks_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "PACK_ROWS", 3)
    vectors = {i: [float((i * 7) % 11 - 5), float((i * 5) % 13 - 6)] for i in range(100)}
    found = topk.top_k(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), topk.F.col("vec_id") % 20 == 0, k=5, scale=1)
    score = lambda a, b: int(sum(x * y for x, y in zip(vectors[a], vectors[b], strict=True)))
    wanted = {(q, n + 1, b, score(q, b)) for q in range(0, 100, 20) for n, b in enumerate(sorted(set(vectors) - {q}, key=lambda b: (-score(q, b), b))[:5])}
    assert {tuple(r) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and any("RepartitionByExpression [dim" in line and "bucket" in line for line in plan.splitlines())
