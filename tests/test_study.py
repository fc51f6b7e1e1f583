"""Points, refreshes, sessions, words and tests as wholes, on small materials."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.functions.text import hash_string
from lorespark.operators import assembly, study, words
from lorespark.sources.tables import settled

TEXT = "1. 세포의 구조\n세포막은 세포를 둘러싸서 보호하는 역할을 한다.\n★ 반드시 기억: 세포막은 인지질 2중층으로 이루어진다.\n세포막은 세포를 둘러싸서 보호하는 역할을 한다!\n예를 들어 세포막이 그렇다고 한다.\n짧다."


def test_analyzed_points(spark):
    rows = {r.order_index: r for r in study.analyzed_points(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "material_id long, text string")).collect()}
    texts = [rows[k].text for k in sorted(rows)]
    assert len(texts) == len(set(texts)) and sum("둘러싸서" in t for t in texts) == 1  # equal but for a mark
    emphasised = next(r for r in rows.values() if "인지질" in r.text)
    assert "반드시" not in emphasised.text and "반드시" in emphasised.source_excerpt and emphasised.importance == 5
    example = next(r for r in rows.values() if r.text.startswith("예를"))
    assert example.importance < emphasised.importance
    for r in rows.values():
        assert (r.answer is None) == (r.blank_text is None) and r.explanation.startswith("자료: “" + r.source_excerpt)
        assert r.answer is None or r.answer in r.text and r.answer in r.explanation


@pytest.mark.parametrize("few", [0, 2, 64])
def test_repeats_of_keywords(spark, few):
    """The same counts whether sentences are compared in one row or meet on digests; nothing is exploded for small materials."""
    texts = {(1, 0): ("세포막은 세포", "세포막"), (1, 1): ("세포막과 세포막", "세포막"), (1, 2): ("세포", "세포"), (1, 3): ("막", ""), (2, 0): ("abcdefghij x", "abcdefghij"), (2, 1): ("abcdefghi x", "x"), (3, 0): ("홀로", "홀로")}
    frame = spark.createDataFrame([(*k, *v) for k, v in texts.items()], "material_id long, n int, sentence string, keyword string")
    found = {(r.material_id, r.n): r.repeats for r in study._repeats(frame, ["material_id"], few).collect()}
    wanted = {k: sum(m != k and m[0] == k[0] and word in s for m, (s, _) in texts.items()) for k, (_, word) in texts.items() if word}
    assert found == {k: n for k, n in wanted.items() if n} == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (2, 1): 1}


def learnt(spark, rows):
    made = settled(study.analyzed_points(spark.createDataFrame(rows, "material_id long, text string")))
    values = {"study_level": 50.0, "correct_count": 3, "wrong_count": 1, "streak": 2, "last_result": True, "last_studied_at": 9, "last_question_type": "OX"}
    made = made.withColumns({c: F.lit(v).cast(study.LEARNING[c]) for c, v in values.items()})
    return made.withColumns({"unit_id": F.lit(1), "id": F.concat_ws("-", "material_id", "order_index"), "origin": F.lit("local"), "created_at": F.lit(1).cast("long"), "updated_at": F.lit(1).cast("long")})


def test_refresh(spark):
    first, second = "가나다는 마바사를 아자차하는 기능을 한다.", "고구려는 압록강 유역에서 건국된 나라이다."
    near = "고구려는 압록강의 유역에서 건국된 나라이다."
    old = learnt(spark, [(1, first + "\n" + second), (2, first), (9, second)])
    materials = spark.createDataFrame([(1, 1, first + "\n" + near + "\n신라는 경주를 수도로 삼은 나라이다."), (2, 1, first), (3, 1, second)], "material_id long, unit_id int, text string")
    materials = materials.withColumns({"points_hash": F.when(F.col("material_id") == 2, hash_string(F.col("text"))), "points_origin": F.lit("local"), "points_version": F.lit(study.ANALYSIS_VERSION)})
    after, marks = study.refreshed_points(materials, old, now=F.lit(77).cast("long"))
    after, marks = settled(after), settled(marks)
    rows = {(r.material_id, r.text): r for r in after.collect()}
    assert set(k[0] for k in rows) == {1, 2, 3}
    assert rows[1, first].id == "1-0" and rows[1, first].study_level == 50.0 and rows[1, first].updated_at == 77
    assert rows[1, near].id == "1-1" and rows[1, near].created_at == 1
    fresh = next(r for (m, t), r in rows.items() if m == 1 and "신라" in t)
    assert fresh.study_level == 0.0 and fresh.created_at == 77 and fresh.last_result is None
    assert rows[2, first].updated_at == 1 and rows[3, second].study_level == 0.0
    assert {r.material_id: r.points_hash is not None for r in marks.collect()} == {1: True, 2: True, 3: True}
    again, _ = study.refreshed_points(marks, after, now=F.lit(99).cast("long"))
    assert {r.updated_at for r in again.collect()} == {1, 77}


def test_finished_sessions_do_not_count_twice(spark):
    sessions = spark.createDataFrame([("s1", 1, None), ("s2", 1, 5)], "session_id string, unit_id int, finished_at long")
    questions = spark.createDataFrame([("s1", 1, "q1", 7, "OX", 5, True), ("s1", 2, "q2", 7, "FILL_BLANK", 3, False), ("s1", 3, "q3", 8, "OX", 4, None), ("s2", 1, "q4", 8, "OX", 3, True)], "session_id string, ord int, question_id string, target_id int, type string, importance int, correct boolean")
    points = spark.createDataFrame([(7, 1, 3, 0.0, 0, 0, 0, None, None, None), (8, 1, 3, 40.0, 1, 0, 1, True, 4, "OX")], "point_id int, unit_id int, importance int, level double, correct int, wrong int, streak int, last boolean, last_studied_at long, last_question_type string")
    now = F.lit(100).cast("long")
    after, levels, records = study.finished_sessions(sessions, questions, points, now)
    s1 = {r.session_id: r for r in after.collect()}["s1"]
    assert (s1.total, s1.answered, s1.correct_count, s1.wrong_count, s1.score_percent, s1.core_total, s1.core_correct) == (3, 2, 1, 1, 33, 2, 1)
    by_point = {r.point_id: r for r in levels.collect()}
    # 0 -> 30 by the first right answer, then 30 * 0.6.
    assert (by_point[7].level, by_point[7].correct, by_point[7].wrong, by_point[7].streak, by_point[7].last_question_type) == (18.0, 1, 1, 0, "FILL_BLANK")
    assert by_point[8] == {r.point_id: r for r in points.collect()}[8]
    assert (s1.pct_before, s1.pct_after) == (20, 29)
    assert [tuple(r) for r in records.collect()] == [(7, 1, 1, False, "q2")]
    again, same, none = study.finished_sessions(after, questions, levels, F.lit(200).cast("long"))
    assert {r.finished_at for r in again.collect()} == {5, 100} and none.count() == 0
    assert sorted(map(str, same.collect())) == sorted(map(str, levels.collect()))


def test_parsed_items(spark):
    lines = ["- 광합성 → 빛으로 양분을 만듦 → 잎에서", "광합성: 다른 뜻", "apple 사과", "설명이 없는 줄", "x" * 41 + ": 너무 긴 말", "1) H2O = 물", ""]
    rows = {r.line_no: (r.term, r.definition) for r in words.parsed_items(spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "doc_id long, text string")).collect()}
    assert rows == {0: ("광합성", "빛으로 양분을 만듦 잎에서"), 2: ("apple", "사과"), 3: (None, None), 4: (None, None), 5: ("H2O", "물")}


@pytest.mark.parametrize("pool", [1, 2, 5])
def test_word_questions(spark, pool):
    items = spark.createDataFrame([(i, "p", f"용어{i}", f"서로 다른 설명 번호{i} 입니다") for i in range(pool)], "item_id long, pool string, term string, definition string")
    rows = words.word_questions(items).collect()
    kinds = Counter(r.type for r in rows)
    assert kinds["OX"] == kinds["SHORT_ANSWER"] == kinds["SUBJECTIVE"] == pool and kinds["MULTIPLE_CHOICE"] == (pool if pool > 1 else 0)
    for r in rows:
        term, definition = f"용어{r.item_id}", f"서로 다른 설명 번호{r.item_id} 입니다"
        if r.type == "MULTIPLE_CHOICE":
            assert len(set(r.options)) == len(r.options) == min(pool, 4) and r.answer in r.options and r.answer in (term, definition)
        if r.type == "OX":
            assert (definition in r.question) == (r.answer == "O") and term in r.question
        if r.type == "FILL_BLANK":
            assert words.WORD_BLANK in r.question and r.answer in definition


def test_assembly(spark):
    plan = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "d", 1)], "unit_id int, target_id string, times int")
    targets = spark.createDataFrame([("a", 5, 0.0, None), ("b", 4, 10.0, "OX"), ("c", 2, 0.0, None), ("d", 3, 90.0, None)], "target_id string, importance int, level double, last_kind string")
    good, bad = [], ["question_too_short"]
    rows = [("a", k, f"무엇이 {n}번째로 다른 물음인가 {k}", good) for n, k in enumerate(("OX", "MULTIPLE_CHOICE", "FILL_BLANK"))]
    rows += [("b", "OX", "완전히 다른 내용을 묻는 문장", good), ("c", "SUBJECTIVE", "나쁜 물음", bad), ("d", "OX", "짧음", bad)]
    attempts = assembly.assembled(plan, targets, spark.createDataFrame(rows, "target_id string, type string, question string, reasons array<string>"))
    log = sorted(map(tuple, attempts.collect()))
    taken = [(t, k, how) for _, _, t, k, how, _ in log if how != "rejected"]
    assert len({(t, k) for t, k, _ in taken}) == len(taken)
    assert Counter(t for t, _, _ in taken)["a"] >= 2 and ("d", "OX", "last_resort") in taken and not any(t == "c" for t, _, _ in taken)
    # c has no plain question: its place goes to an important target.
    assert [how for t, _, how in taken if how == "refilled"] == ["refilled"]
    assert all(reasons for *_, how, reasons in log if how == "rejected")
    counts = {r.unit_id: r for r in assembly.assembly_statistics(attempts).collect()}
    assert counts[1].taken == 4 and counts[2].last_resorts == 1
    assert [r.target_id for r in assembly.not_covered(targets, attempts).collect()] == ["c"]


def test_valid_questions(spark):
    context = "광합성은 빛 에너지로 양분을 만드는 과정이다."
    rows = [
        (1, "OX", " 맞는가 ", " 참 ", None, "빛 에너지로"), (2, "OX", "맞는가", "글쎄", None, "빛 에너지로"), (3, "MULTIPLE_CHOICE", "무엇인가", "양분", ["양분 ", "양 분.", "물", ""], "양분을 만드는"),
        (4, "MULTIPLE_CHOICE", "무엇인가", "공기", ["양분", "물"], "양분을 만드는"), (5, "FILL_BLANK", "빛 ___ 와 [ ]", "에너지", None, "빛 에너지로"), (6, "SHORT_ANSWER", "무엇인가", "양분", None, "없는 글"),
        (7, "SHORT_ANSWER", "무엇인가", "양분", None, "빛"), (8, "SHORT_ANSWER", " ", "양분", None, "빛 에너지로"), (9, "SHORT_ANSWER", "무엇인가", " ", None, "빛 에너지로"),
    ]
    questions = spark.createDataFrame([(*r, " 풀이 ", context) for r in rows], "n int, type string, question string, answer string, options array<string>, source_excerpt string, explanation string, context string")
    found = {r.n: r for r in assembly.valid_questions(questions).collect()}
    assert set(found) == {1, 3, 5}
    assert (found[1].question, found[1].answer, found[1].options, found[1].explanation) == ("맞는가", "O", ["O", "X"], "풀이")
    assert (found[3].answer, found[3].options) == ("양분", ["양분", "물"]) and found[5].question == "빛 [      ] 와 [ ]"


def test_structured_summary(spark):
    rows = [(1, 10, 1, "core", "물음 1"), (1, 11, 0, "question", "물음 1"), (1, 12, 2, "belief", "물음 1"), (1, 13, 3, "core", None), (1, 14, 4, None, "물음 1")]
    points = spark.createDataFrame([(*r, f"글 {r[1]}") for r in rows], "unit_id int, point_id int, ord int, area string, page_question string, text string")
    found = sorted((r.place, r.title, [i.point_id for i in r["items"]]) for r in study.structured_summary(points).collect())
    assert found == [(1, "물음 1", [11, 10]), (2, "핵심 내용", [13]), (3, "신념화 (마음가짐)", [12])]
