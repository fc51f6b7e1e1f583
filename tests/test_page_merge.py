"""Pages merged from two readings, lines put in later, and pages nested and flattened."""

from lorespark.operators import page_merge, structure
from lorespark.sources.tables import settled
from tests.test_points import PAGE


def nodes_of(spark, text):
    return settled(structure.nodes(spark.createDataFrame([(1, text)], "doc_id int, text string")))


def texts(nodes):
    return [(r.kind, r.text) for r in nodes.orderBy("page", "node_no").collect()]


def test_a_page_merged_with_itself_stays(spark):
    nodes = nodes_of(spark, PAGE)
    merged, log, waiting = page_merge.merged_pages(nodes, nodes)
    assert [x for x in texts(merged) if x[0] != "table"] == [x for x in texts(nodes) if x[0] != "table"] and texts(merged)[-1][0] == "table"
    assert {r.verdict for r in log.collect()} == {"same"} and waiting.count() == 0


def test_second_reading(spark):
    local = nodes_of(spark, "[질문] Q1. 왜 그런가?\n[핵심 내용]\n1. 데한민국 헌법의 뜻\n국군의 사명을 다한다.\n나라를 지킨다.")
    other = nodes_of(spark, "[질문] Q2. 왜 그런가?\n[핵심 내용]\n1. 대한민국 헌법의 뜻\n- 국군의 사명\n국군의 사명을 다한다.\n전혀 새로운 문장이 하나 생겼다.")
    merged, log, waiting = page_merge.merged_pages(local, other)
    assert texts(merged) == [("question", "왜 그런가?"), ("section", "대한민국 헌법의 뜻"), ("subsection", "국군의 사명"), ("content", "국군의 사명을 다한다."), ("content", "나라를 지킨다.")]
    assert merged.where("kind = 'question'").first().number == "2"
    verdicts = {(r["from"], r.to): r.verdict for r in log.collect()}
    assert verdicts["데한민국 헌법의 뜻", "대한민국 헌법의 뜻"] == "apply" and verdicts["나라를 지킨다.", None] == "restored" and verdicts[None, "국군의 사명"] == "covered"
    (item,) = waiting.collect()
    assert (item.text, item.kind, item.reason) == ("전혀 새로운 문장이 하나 생겼다.", "content", page_merge.ONLY_SECOND) and item.after in ("국군의 사명을 다한다.", "나라를 지킨다.")
    items = waiting.withColumnRenamed("pos", "seq")
    done = texts(page_merge.with_unverified(merged, items))
    assert done[done.index(("content", item.after)) + 1] == ("content", item.text) and len(done) == 6


def test_lines_put_in(spark):
    nodes = nodes_of(spark, "[핵심 내용]\n가\n나\n가")
    items = spark.createDataFrame([(1, 1, 1, "content", "a", "가"), (1, 1, 2, "title", "b", "가"), (1, 1, 3, "belief", "c", None), (1, 1, 4, "content", "d", "없다"), (1, 1, 5, "content", "e", "없다"), (1, 7, 6, "content", "f", None)], "doc_id int, page int, seq int, kind string, text string, after string")
    found = page_merge.with_unverified(nodes, items)
    assert texts(found) == [("belief", "c"), ("content", "가"), ("content", "b"), ("content", "a"), ("content", "나"), ("content", "가"), ("content", "d"), ("content", "e")]
    assert texts(page_merge.with_unverified(nodes, items.limit(0))) == texts(nodes)


def test_nested_pages(spark):
    nodes = nodes_of(spark, PAGE + "\n[쪽] 5")
    page = page_merge.nested_pages(nodes).first()
    assert [(s.number, s.title, len(s.content), [(x.title, len(x.content)) for x in s.subsections]) for s in page.sections] == [
        (None, "", 1, []), ("1", "헌법 수호와 군인의 사명", 3, [("국가를 지킨다는 것의 의미", 1), ("국민을 지킨다는 것", 0)]), ("2", "헌법과 역사", 0, [("옛 헌법", 1)]),
    ]
    assert page.question.number == "3" and page.page_label == "5" and len(page.beliefs) == 2 and page.tables == ["구분 | 내용"]
    again = page_merge.flat_nodes(page_merge.nested_pages(nodes))
    assert page_merge.nested_pages(again).first() == page
    assert sorted(texts(again)) == sorted(texts(nodes))
