"""Watermarks learnt from a document's pages, and what cleaning removes and logs."""

from lorespark.operators import watermarks

PAGES = {
    1: ["우리가 지켜야 하는 대한민국", "홍길동 / 2025-01-01 09:00", "국군의 / 홍길동 / 사명은 무겁다", "헌법을 홍길동 지킨다", "홍길동은 이름이다", "1. 헌법의 뜻 2025 나라", "2025 년의 일이다", "정신전력 - 5"],
    2: ["상사/홍길동/", "나라를 09:00 지킨다", "2025-01-01 회의", "● 본문 2025-01-01 09:00 이어진다", "· 둘째 항목이다", "※※※", "ㄱㄴㄷ 가", "5"],
}
KINDS = {1: "page", 2: "block"}


def regions(spark, pages=PAGES):
    rows = [(1, p, KINDS[p], 0, n, line) for p, lines in pages.items() for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id int, page int, kind string, index int, line_no int, line string")


def test_learned_pieces(spark):
    found = {}
    for r in watermarks.learned_pieces(regions(spark)).collect():
        found.setdefault(r.kind, {})[r.value] = r.pages
    assert found["word"] == {"홍길동": 2, "상사": 1}
    assert found["digits"] == {"2025": 2, "01": 2, "09": 2, "00": 2, "09:00": 2}
    assert found["date"] == {"2025-01-01": 2} and set(found["sample"]) == {"홍길동 / 2025-01-01 09:00", "2025-01-01 09:00", "상사/홍길동/"}
    marks = watermarks.dictionaries(regions(spark)).first().marks
    assert (marks.words, marks.dates, marks.protected) == (["상사", "홍길동"], ["2025-01-01"], ["홍길동"])


def test_cleaned_document(spark):
    rows = watermarks.cleaned_document(regions(spark)).orderBy("page", "line_no").collect()
    got = [(r.clean, r.dropped) for r in rows]
    assert got == [
        ("우리가 지켜야 하는 대한민국", None), (None, "watermark"), ("국군의 무겁다", None), ("헌법을 홍길동 지킨다", None), ("홍길동은 이름이다", None), ("1. 헌법의 뜻 나라", None), ("2025 년의 일이다", None), (None, "pageNumber"),
        (None, "watermark"), ("나라를 지킨다", None), (None, "noise"), ("● 본문 이어진다", None), ("● 둘째 항목이다", None), (None, "noise"), (None, "noise"), ("5", None),
    ]
    log = [(r.page, r.line, r.type, r["from"]) for r in watermarks.cleaning_log(watermarks.cleaned_document(regions(spark))).orderBy("page", "line", "n").collect()]
    assert (1, 3, "watermark", "홍길동 / 사명은") in log and (1, 6, "watermark", "2025") in log and (2, 2, "watermark", "09:00") in log
    assert (1, 8, "pageNumber", "정신전력 - 5") in log and (2, 3, "watermark", "2025-01-01") in log and (2, 6, "noise", "※※※") in log
    labels = watermarks.page_labels(watermarks.cleaned_document(regions(spark))).collect()
    assert [(r.page, r.page_label) for r in labels] == [(1, "정신전력 - 5")]


def test_documents_without_marks_stay(spark):
    pages = {1: ["나라와 국민", "a/b와 c", ""], 2: ["헌법 제5조"]}
    rows = watermarks.cleaned_document(regions(spark, pages)).orderBy("page", "line_no").collect()
    assert [(r.clean, r.dropped, r.log) for r in rows] == [("나라와 국민", None, []), ("a/b와 c", None, []), ("헌법 제5조", None, [])]
    assert watermarks.cleaned_document(regions(spark).limit(0)).count() == 0


def test_words_in_a_row(spark):
    """Of several learnt words, the last is kept where it may be content and nothing of a mark is left beside it."""
    from pyspark.sql import functions as F

    from lorespark.operators.cleanup import strip_learned

    words = F.array(F.lit("홍길동"), F.lit("상사"))
    frame = spark.createDataFrame([("나는 홍길동 상사 나라",), ("나는 상사 나라",), ("09:00 상사 나라",)], "t string")
    none = F.array().cast("array<string>")
    assert [r[0] for r in frame.select(strip_learned(F.col("t"), words, F.array(F.lit("09:00")), F.array(F.lit("상사")))["text"]).collect()] == ["나는 상사 나라", "나는 상사 나라", "나라"]
    assert [r[0] for r in frame.select(strip_learned(F.col("t"), words, none, none)["text"]).collect()] == ["나는 나라", "나는 나라", "09:00 나라"]


def test_lines_are_read_a_few_times_only(spark, sf_dir):
    """Lines are read for what is learnt, for stems, and to be cleaned; the log is counted with the lines that go."""
    from lorespark.plans import watermarks as plans

    leaves = lambda frame: frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(plans.cleaning_reasons(spark, sf_dir)) <= 4 and leaves(plans.watermark_log(spark, sf_dir)) <= 4


def test_frequent_and_protected_words(spark):
    lines = ["국군은 / 홍길동 / 2025-01-01", "국군의 국군은 뜻", "(홍길동은)", "끝/", "끝 끝에 a끝", "상사/나라/"]
    marks = watermarks.dictionaries(regions(spark, {1: lines})).first().marks
    assert (marks.words, marks.protected, marks.frequent) == (["국군은", "나라", "상사", "홍길동"], ["홍길동"], ["국군", "끝"])
