"""Batches, replies, corrections of pages, comparison with a transcript, and whole unit tests."""

from pyspark.sql import functions as F

from lorespark.operators import assembly, comparison, corrections, quiz, structure
from tests.test_functions import apply
from tests.test_points import PAGE


def test_batches(spark):
    sizes = [3, 4, 5, 20, 1, 1, 1, 1, None, 9]
    rows = [("a", n, None if k is None else "x" * k) for n, k in enumerate(sizes)] + [(None, 0, "y"), (None, 1, "y" * 8)]
    found = corrections.request_batches(spark.createDataFrame(rows, "g string, n int, text string"), "g", ["n"], most_rows=3, most_chars=10).collect()
    assert [r.batch for r in sorted((r for r in found if r.g), key=lambda r: r.n)] == [0, 0, 1, 2, 3, 3, 3, 4, 4, 4]
    assert [r.batch for r in sorted((r for r in found if not r.g), key=lambda r: r.n)] == [0, 0]


def test_first_valid_response_of_the_own_batch(spark):
    requests = spark.createDataFrame([(1, 0, 10), (1, 0, 11), (1, 1, 12)], "group_id int, batch int, request_id int")
    responses = spark.createDataFrame([(1, 0, 5, 10, "late"), (1, 0, 2, 10, "first"), (1, 0, 1, 10, ""), (1, 0, 3, 12, "other batch"), (1, 1, 9, 99, "nobody")], "group_id int, batch int, ord int, request_id int, answer string")
    assert {r.request_id: r.answer for r in corrections.first_responses(requests, responses, F.col("answer") != "").collect()} == {10: "first", 11: None, 12: None}


def test_corrected_pages(spark):
    pages = spark.createDataFrame([(1, 1, "데한민국의 수토는 서울이다. l392년에 데한민국이 섰다."), (1, 2, None), (2, 1, " \n"), (3, 1, "글"), (4, 1, "글"), (5, 1, "글")], "group_id int, page int, text string")
    replies = spark.createDataFrame([(1, True, None), (2, True, None), (3, False, None), (4, True, "timeout")], "group_id int, configured boolean, error string")
    changes = [
        (1, 0, 1, "데한 민국", "대한민국", "high", "오타" * 60), (1, 1, None, "수토는", "수도는", "low", None), (1, 2, 1, "l392년", "1392년", None, None), (1, 3, 1, "데한민국", "대한민국", "high", ""),
        (1, 4, 1, "없는 말", "있는 말", "high", ""), (1, 5, 1, "서울이다", "부산과 서울과 대구이다", "high", ""), (1, 6, 1, "l392", "1392", "high", ""), (1, 7, 1, None, "x", "high", ""), (4, 0, 1, "글", "말", "high", ""),
    ]
    changes = spark.createDataFrame(changes, "group_id int, ord int, page int, raw string, corrected string, confidence string, reason string")
    made = corrections.corrected_pages(pages, replies, changes)
    rows = {(r.group_id, r.page): r for r in made.collect()}
    assert rows[1, 1].final == "대한민국의 수토는 서울이다. 1392년에 대한민국이 섰다."
    assert [(o["ord"], o.outcome) for o in rows[1, 1].outcomes] == [(0, "applied"), (1, "uncertain"), (2, "applied"), (3, "applied"), (4, "missing"), (5, "rejected"), (6, "missing")]
    assert {g: r.status for (g, _), r in rows.items()} == {1: "ai", 2: "empty", 3: "unavailable", 4: "failed", 5: "unavailable"} and rows[1, 2].final == ""
    log = {r.ord: r for r in corrections.correction_log(made, changes).collect()}
    assert len(log) == 7 and len(log[0].why) == 80 and log[0]["from"] == "데한민국" and log[4].why == corrections.NOT_FOUND
    status = {r.group_id: r for r in corrections.correction_status(made).collect()}
    assert (status[1].applied, status[1].uncertain, status[1].rejected, status[1].pages) == (3, 1, 3, 2) and status[1].message == "AI 문맥 보정 3곳 적용 · 확인 필요 1곳" and status[2].message == ""


def test_suggestions(spark):
    f = lambda c: corrections.suggestion_applied(c["t"], c["a"], c["b"])
    frame = spark.createDataFrame([("a (b) c", "( b )", "x"), ("abc", "d", "x"), ("abc", "", "x"), ("가 나다", "가나", "라")], "t string, a string, b string")
    assert [r[0] for r in frame.select(f({k: F.col(k) for k in "tab"})).collect()] == ["a x c", "abc", "abc", "라다"]


def test_structure_of_edited_texts(spark):
    texts = spark.createDataFrame([(1, 0, "[질문] Q1. 첫째?\n[쪽] 7"), (1, 1, "[질문] Q2. 둘째?\n\n[질문] Q3. 새 질문?")], "doc_id int, n int, text string")
    analyzed = spark.createDataFrame([(1, 1, "둘째?", "5", ["a"]), (1, 2, "첫째?", "6", ["b"]), (1, 3, "사라진 것?", "8", ["c"])], "doc_id int, page int, question string, page_label string, unverified array<string>")
    nodes, pages = structure.structure_from_texts(texts, analyzed)
    assert {(r.page, r.from_page, r.page_label, tuple(r.unverified)) for r in pages.collect()} == {(1, 2, "7", ("b",)), (2, 1, "5", ("a",)), (3, 3, "8", ("c",))}
    assert {r.page for r in nodes.collect()} == {1, 2, 3}


def test_comparison(spark):
    true = structure.nodes(spark.createDataFrame([(1, PAGE)], "doc_id int, text string"))
    same = comparison.compared_structure(true, true)
    assert same.where("not ok").count() == 0 and same.count() > 20
    read = structure.nodes(spark.createDataFrame([(1, PAGE.replace("Q3", "Q8").replace("국군은 나라를 지킨다.\n", "").replace("2. 헌법과", "2. 홍길동 헌법과"))], "doc_id int, text string"))
    wrong = {r.field: (r.got, r.want) for r in comparison.compared_structure(read, true).where("not ok").collect()}
    assert wrong == {"question.number": ("8", "3"), "2-1 본문 1": (None, "국군은 나라를 지킨다."), "3. 대제목": ("홍길동 헌법과 역사", "헌법과 역사")}
    missing = comparison.compared_structure(read.where("page > 9"), true).where("field = 'sections 수' or field = 'question.starred'").collect()
    assert {(r.field, r.got, r.ok) for r in missing} == {("sections 수", "0", False), ("question.starred", "false", False)}
    raw = comparison.page_texts(read)
    report = comparison.page_reports(read, true, raw, spark.createDataFrame([(1, "홍길동/2025 x")], "doc_id int, watermark string"))
    row = report.first()
    assert row.watermark_left == ["홍길동"] and 0 < row.cer_final == row.cer_raw < 0.2 and row.total - row.exact == 3
    assert comparison.report_summary(report).first().marked_pages == 1
    pairs = spark.createDataFrame([("가 나", "가나"), ("", "x"), ("", ""), ("abcd", "abxd"), ("a" * 7000, "b" * 7007)], "a string, b string")
    assert [r[0] for r in pairs.select(comparison.error_rate(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0, 0.25, 7 / 7000]


def test_plan_quotas(spark):
    """The total is what counts, coverage and the share of small points ask for, as far as repeats allow; groups come near their share."""
    rows = [(u, 100 * u + i, 1 + (i * 7 + u) % 5, float(i % 90), i % 3, i % 2 == 0) for u, n in enumerate((1, 4, 9, 20, 40), 1) for i in range(n)]
    targets = spark.createDataFrame(rows, "unit_id int, target_id int, importance int, level double, wrong_count int, studied boolean")
    plan = {(r.unit_id, r.target_id): r.times for r in quiz.plan_questions(targets, skipped=True).collect()}
    assert len(plan) == len(rows)
    decided = {1: 5, 4: 8, 9: 12, 20: 23, 40: 40}
    for u, n in enumerate((1, 4, 9, 20, 40), 1):
        own = [(imp, plan[u, t]) for unit, t, imp, *_ in rows if unit == u]
        covered = [i for i, k in own if k]
        room = sum(quiz.MOST_REPEATS[i] - 1 for i in covered)
        low, required = sum(i <= 2 for i in covered), sum(i >= 2 for i, _ in own)
        wanted = max(decided[n], len(covered), -(-low * 100 // 15) if low and required > low else 0)
        assert sum(k for _, k in own) == min(wanted, len(covered) + room)
        assert all(k >= 1 for i, k in own if i >= 2) and all(k <= quiz.MOST_REPEATS[i] for i, k in own)


def test_heavier_targets_are_repeated_more_often(spark):
    rows = [(u, u * 10 + i, 4, 0.0 if i == 0 else 95.0, 5 if i == 0 else 0, False) for u in range(300) for i in range(4)]
    targets = spark.createDataFrame(rows, "unit_id int, target_id int, importance int, level double, wrong_count int, studied boolean")
    extra = quiz.plan_questions(targets).groupBy((F.col("target_id") % 10).alias("i")).agg(F.sum(F.col("times") - 1).alias("n")).collect()
    assert sum(r.n for r in extra) == 300 * 4  # as many as repeats allow: 8 questions, 4 of them once more
    few = [(u, u * 10 + i, 5, 0.0 if i == 0 else 95.0, 5 if i == 0 else 0, False) for u in range(300) for i in range(6)]
    few = quiz.plan_questions(spark.createDataFrame(few, targets.schema)).groupBy((F.col("target_id") % 10).alias("i")).agg(F.sum(F.col("times") - 1).alias("n")).collect()
    by = {r.i: r.n for r in few}
    assert sum(by.values()) == 300 * 4 and by[0] > 2.5 * max(by[i] for i in range(1, 6))


def test_unit_tests(spark):
    rows = [(1, i, f"대한민국의 {w}는 제{i}조에 따라 국민을 지킨다.", 1 + i % 5, 10.0 * i) for i, w in enumerate(("헌법", "수도", "국회", "정부", "법원", "군대", "국기"), 1)]
    points = spark.createDataFrame(rows, "unit_id int, point_id int, text string, importance int, level double").withColumns({"source_excerpt": F.col("text"), "wrong_count": F.lit(0), "studied": F.lit(False), "last_kind": F.lit(None).cast("string")})
    questions, tried, plan = assembly.unit_tests(points)
    rows = questions.orderBy("ord").collect()
    assert {r.target_id for r in rows} == {r.target_id for r in plan.collect() if r.times}
    assert len(rows) == tried.where("result <> 'rejected'").count() and len({r.ord for r in rows}) == len(rows)
    assert len({(r.target_id, r.type) for r in rows}) == len(rows) and all(r.question and r.answer for r in rows)


def test_reader_of_columns(spark):
    assert apply(spark, structure.is_table_row, ["a | b", "a |", "a", None]) == [True, False, False, False]
