"""Points: phrase blanks, points of pages, and matching with an earlier version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.operators import points, structure
from tests.test_functions import apply


def test_phrase_blanks(spark):
    got = apply(spark, points.phrase_blank, ["자유: 남에게 얽매이지 않는 상태", "국군은 ‘국민의 군대’로서 나라를 지킨다", "우리는 자유·평등·번영을 추구한다", "대한민국 정부는 1948년 8월 15일 수립되었다", "국가는 운명공동체이다", ""])
    assert got[0].answer in ("자유", "남에게 얽매이지 않는 상태") and got[1].answer == "국민의 군대" and got[5] is None
    assert got[2].blank_text == "우리는 [      ]을 추구한다"
    assert got[3].blank_text == "대한민국 정부는 [      ] 수립되었다"


PAGE = """[제목] 우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)
[질문] Q3. (★민주주의와 헌법수호) 군인이 헌법을 수호해야 하는 이유는?
[핵심 내용]
머리말이다.
1. 헌법 수호와 군인의 사명
헌법은 최고 규범이며
국가의 바탕이다.
헌법 수호에는 두 가지 뜻이 있다.
- 국가를 지킨다는 것의 의미
국군은 나라를 지킨다.
- 국민을 지킨다는 것
2. 헌법과 역사
- 옛 헌법
자유: 얽매이지 않는 상태
구분 | 내용
[신념화]
● 나는 헌법을 지킨다.
● 나는 헌법을 지킨다"""


def test_page_points(spark):
    nodes = structure.nodes(spark.createDataFrame([(1, PAGE)], "doc_id int, text string"))
    rows = points.page_points(nodes).orderBy("node_no").collect()
    assert [(r.area, r.category, r.importance, r.heading) for r in rows if r.category in ("핵심 질문", "목록", "표", "신념화")] == [
        ("question", "핵심 질문", 5, "우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)"),
        ("core", "목록", 5, "헌법 수호와 군인의 사명"),
        ("core", "표", 4, "우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)"),
        ("belief", "신념화", 3, "신념화"),
        ("belief", "신념화", 3, "신념화"),
    ]
    by_text = {r.text: r for r in rows}
    question = by_text["군인이 헌법을 수호해야 하는 이유는? — 헌법 수호와 군인의 사명"]
    assert (question.answer, question.blank_text) == ("헌법 수호와 군인의 사명", "군인이 헌법을 수호해야 하는 이유는? — [      ]")
    listed = by_text["헌법 수호에는 두 가지 뜻이 있다.: 국가를 지킨다는 것의 의미, 국민을 지킨다는 것"]
    assert (listed.answer, listed.source_excerpt) == ("국가를 지킨다는 것", "헌법 수호에는 두 가지 뜻이 있다.")
    assert by_text["헌법은 최고 규범이며 국가의 바탕이다."].importance == 5 and by_text["머리말이다."].importance == 4
    assert by_text["머리말이다."].heading.startswith("우리가") and by_text["국군은 나라를 지킨다."].heading == "국가를 지킨다는 것의 의미"
    assert by_text["자유: 얽매이지 않는 상태"].category == "정의" and by_text["자유: 얽매이지 않는 상태"].importance == 4
    assert {r.page_question for r in rows} == {"Q3. 군인이 헌법을 수호해야 하는 이유는?"}


def test_outlines_without_linked_titles(spark):
    sections = "\n".join(f"{i}. 제목{i}" for i in range(1, 9))
    nodes = structure.nodes(spark.createDataFrame([(1, f"[질문] 왜 그런가?\n[핵심 내용]\n{sections}"), (2, "[질문] 왜 그런가?\n[핵심 내용]\n본문")], "doc_id int, text string"))
    assert [(r.doc_id, r.text) for r in points.page_points(nodes).where("area = 'question'").collect()] == [(1, "왜 그런가? — " + " / ".join(f"제목{i}" for i in range(1, 7)))]


def test_points_of_whole_texts(spark):
    texts = [(1, PAGE + "\n\n" + PAGE.replace("Q3", "Q4")), (2, "Q1. 태그 없는 글?\n본문"), (3, ""), (4, "[쪽] 5\n그냥 글")]
    rows = points.points_from_texts(spark.createDataFrame(texts, "doc_id int, text string")).orderBy("ord").collect()
    once = points.document_points(structure.nodes(spark.createDataFrame([(1, PAGE)], "doc_id int, text string"))).collect()
    assert {r.doc_id for r in rows} == {1} and [r.ord for r in rows] == list(range(len(once))) and rows[0].area == "question" and rows[-1].area == "belief"
    assert sum(r.area == "belief" for r in rows) == 1


def test_enumerations_and_titles(spark):
    assert apply(spark, points.enum_count, ["세 가지 뜻", "12가지", "가지가지", None, "99999999999 가지"]) == [3, 12, 0, 0, 1 << 30]
    assert apply(spark, points.core_of_title, ["헌법을 수호한다는 것의 의미", "국가라는 의미", "의미", "제목"]) == ["헌법을 수호한다는 것", "국가", "", "제목"]


def test_matched_points(spark):
    old = spark.createDataFrame([(1, 10, 0, "심장은 혈액을 순환시킨다."), (1, 11, 1, "뇌는 몸을 조절하는 기관이다"), (1, 12, 2, "심장은 혈액을 순환시킨다"), (2, 13, 0, "다른 자료")], "material_id int, id int, ord int, text string")
    new = spark.createDataFrame([(1, 20, 0, "심장은 혈액을 순환시킨다"), (1, 21, 1, "뇌는 우리 몸을 조절하는 기관이다"), (1, 22, 2, "전혀 새로운 문장이다"), (2, 23, 0, "뇌는 몸을 조절하는 기관이다")], "material_id int, id int, ord int, text string")
    assert {r.new_id: r.old_id for r in points.matched_points(old, new).collect()} == {20: 12, 21: 11}
    assert points.matched_points(old, new.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("block", [1, 60, 1 << 30])
def test_matched_points_of_large_groups(spark, block):
    """Compared where they lie or in pairs of blocks, points match as they do one by one."""
    rng = random.Random(5)
    words = ["심장은", "혈액을", "뇌는", "몸을", "𝒳𝒴", "조절하는", "기관이다", "우리", "세포가", "aa aa"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 5)))
    old = [(g, f"o{g}:{i}", i, line()) for g in range(4) for i in range(25)]
    new = [(g, 1000 * g + i, i, old[25 * (g % 4) + rng.randrange(25)][3] + rng.choice(["", "", " 또", "!"]) if rng.random() < 0.7 else line()) for g in range(1, 5) for i in range(25)]
    key = lambda t: t.replace(" ", "").replace("!", "")
    grams = lambda t: Counter(key(t)[i : i + 2] for i in range(len(key(t)) - 1))
    wanted, used = set(), set()
    for g, n, _, t in new:
        same = [o for o in old if o[0] == g and key(o[3]) == key(t)]
        if same and not any(key(x[3]) == key(t) and x[0] == g and x[1] < n for x in new):
            wanted.add((g, n, same[-1][1]))
            used |= {n, same[-1][1]}
    for g, n, _, t in new:
        for o in [] if n in used else old:
            a, b = grams(o[3]), grams(t)
            c, size = (a & b).total(), a.total() + b.total()
            if o[0] == g and o[1] not in used and c and (c / a.total() >= 0.9 or 2 * c / size >= 0.8):
                wanted.add((g, n, o[1]))
                used |= {n, o[1]}
                break
    frames = spark.createDataFrame(old, "material_id int, id string, ord int, text string"), spark.createDataFrame(new, "material_id int, id long, ord int, text string")
    found = [(r.material_id, r.new_id, r.old_id) for r in points.matched_points(*frames, block=block).collect()]
    assert len(found) == len(set(found)) > 30 and set(found) == wanted


def test_content_questions(spark):
    from lorespark.operators import questions

    rows = [(1, 1, "심장은 혈액을 온몸으로 순환시킨다.", 5), (2, 1, "대한민국의 수도는 서울이다.", 3), (3, 1, "허파는 산소를 받아들인다.", 1), (4, 1, "해마는 기억을 형성한다.", None)]
    points_ = spark.createDataFrame(rows, "point_id int, unit_id int, text string, importance int")
    made = questions.content_questions(points_).collect()
    kinds = {(r.point_id, r.type) for r in made}
    assert {k for p, k in kinds if p == 1} == {"OX", "MULTIPLE_CHOICE", "FILL_BLANK", "SHORT_ANSWER", "SUBJECTIVE", "DESCRIPTIVE"}
    assert (3, "DESCRIPTIVE") not in kinds and (4, "DESCRIPTIVE") in kinds
    for r in made:
        if r.type == "MULTIPLE_CHOICE":
            assert r.options.count(r.answer) == 1 and len(set(r.options)) == len(r.options) >= 3
        if r.type == "FILL_BLANK":
            assert "[      ]" in r.question and r.answer not in r.question
    targets = spark.createDataFrame([(1, 10.0, 5, ["OX"], "FILL_BLANK"), (2, 80.0, 3, None, None)], "point_id int, level double, importance int, used array<string>, last_kind string")
    order = questions.ordered_kinds(targets, questions.content_questions(points_)).collect()
    assert sorted((r.point_id, r.n) for r in order) == [(p, n + 1) for p in (1, 2) for n in range(sum(k[0] == p for k in kinds))]
