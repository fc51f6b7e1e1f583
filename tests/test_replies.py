"""Points and word items proposed by an outside service."""

from pyspark.sql import functions as F

from lorespark.functions.similarity import term_supported
from lorespark.operators import replies

MATERIAL = "심장은 혈액을 온몸으로 순환시키는 기관이다. 대한민국의 수도는 서울이다."
FIRST = "심장은 혈액을 온몸으로 순환시키는 기관이다."


def test_points(spark):
    rows = [
        (1, 0, FIRST, FIRST, 9.0, "", "심장", "[ ]은 혈액을 온몸으로 순환시키는 기관이다.", "심장은 기관이다", "심장의 일", MATERIAL),
        (1, 1, FIRST + " ", FIRST, 2.0, "", "", "", "", "", MATERIAL),
        (1, 2, "대한민국의 수도는 서울이다.", "수도는 서울이다.", None, "지리", "부산", "수도는 ___이다", "바다가 넓고 물고기가 많은 곳", None, MATERIAL),
        (1, 3, "허파는 산소를 받아들이고 이산화탄소를 내보낸다.", FIRST, 3.0, "", "", "", "", "", MATERIAL),
        (1, 4, "심장은 기관이다", "없는 구절이다", 3.0, "", "", "", "", "", MATERIAL),
        (2, 0, None, None, None, None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "material_id int, ord int, text string, source_excerpt string, importance double, category string, answer string, blank_text string, explanation string, question_target string, material string")
    found = {r.ord: r for r in replies.valid_points(table).collect()}
    assert set(found) == {0, 2}
    assert (found[0].importance, found[0].answer, found[0].blank_text, found[0].question_target, found[0].category, found[0].explanation) == (5, "심장", "[      ]은 혈액을 온몸으로 순환시키는 기관이다.", "심장의 일", "기능·역할", "심장은 기관이다")
    assert (found[2].importance, found[2].answer, found[2].category, found[2].explanation) == (3, "대한민국", "지리", "자료: “수도는 서울이다.”")
    assert found[2].question_target == "대한민국" and found[2].blank_text == "[      ]의 수도는 서울이다."


def test_word_items(spark):
    rows = [(1, 0, "심장", "혈액을 온몸으로 순환시키는 기관", FIRST, MATERIAL), (1, 1, "심 장", "기관이다", FIRST, MATERIAL), (1, 2, "심잠", "순환시키는 기관", FIRST, MATERIAL), (1, 3, "허파", "혈액을 온몸으로", FIRST, MATERIAL), (1, 4, "혈액", "산소를 나르는 붉은 액체", FIRST, MATERIAL), (1, 5, None, "x", FIRST, MATERIAL)]
    rows = [(*r, 9.0 if r[1] == 0 else None) for r in rows]
    table = spark.createDataFrame(rows, "material_id int, ord int, term string, definition string, source_excerpt string, material string, importance double")
    assert {(r.ord, r.importance) for r in replies.valid_word_items(table).collect()} == {(0, 5), (2, 3)}


def test_terms_of_any_length(spark):
    long = "대한민국임시정부수립기념관건립추진위원회운영규정개정안심사보고서작성지침해설"
    frame = spark.createDataFrame([(long * 2, "앞 " + long + long.replace("수립", "수럽") + " 뒤"), (long * 2, long), ("", "x"), ("서울", "수도는 서욷이다")], "t string, e string")
    assert [r[0] for r in frame.select(term_supported(F.col("t"), F.col("e"))).collect()] == [True, False, False, True]
