"""Pages of untagged texts and of regions; parts and runs against a line-by-line reader."""

import random
import re

import pytest

from lorespark.operators import structure

UNTAGGED = """우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)
Q3. (★민주주의와 헌법수호) 군인이 헌법을 지키는 것의
의미는 무엇인가?
핵심
내용
1. 국가와 군대의 관계
- 국가와 헌법
대한민국 헌법 제5조 제2항에 국군의 사명이 있다.
구분 | 내용
신념화 ● 국가와 국민은
하나이다.
● 나는 ‘헌법’을 지킨다.
Q4, 다음 질문은?
2. 둘째 제목
본문이다."""


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("page", "node_no").collect()]


def test_untagged_text(spark):
    nodes = structure.nodes(spark.createDataFrame([(1, UNTAGGED)], "doc_id int, text string"))
    assert rows(nodes, "page", "kind", "text") == [
        (1, "title", "우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)"),
        (1, "question", "군인이 헌법을 지키는 것의 의미는 무엇인가?"),
        (1, "section", "국가와 군대의 관계"),
        (1, "subsection", "국가와 헌법"),
        (1, "content", "대한민국 헌법 제5조 제2항에 국군의 사명이 있다."),
        (1, "table", "구분 | 내용"),
        (1, "belief", "국가와 국민은 하나이다."),
        (1, "belief", "나는 ‘헌법’을 지킨다."),
        (2, "question", "다음 질문은?"),
        (2, "section", "둘째 제목"),
        (2, "content", "본문이다."),
    ]
    assert [tuple(r) for r in structure.emphasis(nodes).select("page", "term").collect()] == [(1, "헌법")]
    parts = structure.text_parts(spark.createDataFrame([(1, UNTAGGED), (2, "그냥 글이다.\n1. 목록\n둘째 줄")], "doc_id int, text string"))
    assert {r.doc_id: r.structured for r in structure.is_structured(parts).collect()} == {1: True, 2: False}


def test_untagged_text_as_tagged_one(spark):
    """Rendered with tags and read again, inferred pages stay what they are."""
    nodes = structure.nodes(spark.createDataFrame([(1, UNTAGGED)], "doc_id int, text string"))
    again = structure.nodes(structure.render(nodes))
    assert rows(again, "page", "kind", "text", "number") == rows(nodes, "page", "kind", "text", "number")


def test_regions(spark):
    header, question = (0, "header", 0, 0, "■ 제목줄 (2-1. 국군)"), (0, "question", 0, 0, "Q1. 무엇인가?")
    blocks = [(0, "block", 1, 0, "1. 첫째"), (0, "block", 1, 1, "내용이다"), (0, "block", 2, 0, "나는 지킨다"), (0, "label", 1, 0, "핵심"), (0, "label", 1, 1, "내용"), (0, "footer", 0, 0, "쪽 - 5")]
    other = [(1, "block", 4, 0, "● 다짐이다"), (1, "label", 4, 0, "신념화"), (1, "block", 5, 0, "1) 나중 칸")]
    whole = [(2, "page", 0, k, line) for k, line in enumerate(UNTAGGED.split("\n"))]
    table = spark.createDataFrame([(7, *r) for r in [header, question, *blocks, *other, *whole]], "doc_id int, page int, kind string, index int, line_no int, line string")
    nodes = structure.region_nodes(table)
    assert rows(nodes.where("page < 2"), "page", "kind", "text") == [
        (0, "title", "제목줄 (2-1. 국군)"),
        (0, "question", "무엇인가?"),
        (0, "section", "첫째"),
        (0, "content", "내용이다"),
        (0, "belief", "나는 지킨다"),
        (1, "belief", "다짐이다"),
        (1, "belief", "1) 나중 칸"),
    ]
    alone = structure.nodes(spark.createDataFrame([(1, UNTAGGED)], "doc_id int, text string")).where("page = 1")
    assert rows(nodes.where("page = 2"), "kind", "text") == rows(alone, "kind", "text")
    assert structure.region_nodes(table.limit(0)).count() == 0


class Reader:
    """Reads one line after the other: (page, part, line) of each line that counts."""

    def __init__(self, tagged):
        self.tagged, self.out, self.page = tagged, [], 0

    def open(self):
        self.page += 1
        self.mode, self.asked, self.filled, self.waiting, self.titled, self.text = None, False, False, False, False, ""

    def flush(self):
        self.filled |= self.waiting
        self.waiting = False

    def put(self, line):
        cells = [c for c in line.split("|") if c.strip()]
        self.waiting |= self.mode == "core" and not ("|" in line and len(cells) >= 2) or self.mode == "belief" and self.tagged
        self.out.append((self.page, self.mode, line))

    def read(self, line):
        tag = re.match(structure.TAG, line) if self.tagged else None
        asks = tag and tag[1] == "질문" or not self.tagged and re.search(structure.QUESTION_LINE, line)
        if tag and tag[1] == "제목" or not self.page or asks and (self.asked or self.filled):
            self.open()
        if asks:
            self.flush()
            self.asked, self.mode = True, "question"
            self.text = line if self.tagged else re.sub(structure.QUESTION_TAGS, "", re.sub(structure.QUESTION_NUMBER, "", line))
            return self.out.append((self.page, "question", tag[2].strip() if tag else line))
        if tag and tag[1] in ("제목", "쪽"):
            self.flush()
            return self.out.append((self.page, "title" if tag[1] == "제목" else "label", tag[2].strip()))
        label = (tag[1], tag[2]) if tag else next((((m := re.match(p, line))[1], m[2] if m.re.groups > 1 else "") for p in structure.PART_LABELS if re.match(p, line)), None) if not self.tagged else None
        if label:
            self.flush()
            self.mode = "belief" if "신" in label[0] else "core"
            return self.put(label[1].strip()) if label[1].strip() else None
        if not self.tagged and re.match(structure.SECOND_HALF, line):
            return None
        numbered = re.match(structure.SECTION, line)
        if not self.tagged and not self.mode and not self.asked and not self.titled and not numbered:
            self.titled = bool(re.search("[가-힣0-9(\\[]", line))
            return self.out.append((self.page, "title", line)) if self.titled else None
        if not self.tagged and self.mode == "question":
            if not (numbered or re.match(structure.SUBSECTION, line) or re.search("[?？]$", self.text)):
                self.text = line
                return self.out.append((self.page, "question", line))
            self.flush()
            self.mode = "core"
        self.mode = self.mode or "core"
        return self.put(line) if self.mode != "question" else self.out.append((self.page, "question", line))


LINES = ["본문이다", "latin line", "1. 제목", "- 소제목", "● 항목", "Q1. 질문", "Q2. 끝?", "1. (★x) 물음", "핵심 내용", "신념화", "신념화 ● 다짐", "핵심내용 1. 첫째", "내용", "가 | 나", "정말인가?", "", "  "]
TAGGED_LINES = ["본문이다", "1. 제목", "- 소제목", "● 항목", "[제목] 국가", "[질문] Q1. 질문", "[질문] Q2. 끝?", "[핵심 내용]", "[신념화]", "[신념화] ● 다짐", "[핵심내용] 1. 첫째", "[쪽] 5", "가 | 나", "Q1. 태그 없음", ""]


@pytest.mark.parametrize("lines", [LINES, TAGGED_LINES])
def test_parts_against_a_line_by_line_reader(spark, lines):
    draw = random.Random(len(lines))
    texts = ["\n".join(draw.choices(lines, k=draw.choice([1, 3, 8, 20]))) for _ in range(400)]
    wanted = set()
    for i, text in enumerate(texts):
        reader = Reader(bool(re.search(r"(?m)^\[(질문|핵심\s*내용|신념화)\]", text)))
        for line in filter(None, map(str.strip, text.split("\n"))):
            reader.read(line)
        wanted |= {(i, k, *row) for k, row in enumerate(reader.out)}
    found = structure.text_parts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    by_text, got = {}, set()
    for r in sorted(found, key=lambda r: (r.doc_id, r.n)):
        by_text[r.doc_id] = by_text.get(r.doc_id, -1) + 1
        got.add((r.doc_id, by_text[r.doc_id], r.page, r.part, r.line))
    assert got == wanted


def test_long_texts_take_linear_time(spark):
    text = "\n".join(f"{i % 90}. 줄 {i}" if i % 5 else f"Q{i % 100}. 질문 {i}?" for i in range(30_000))
    assert structure.nodes(spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 30_000


def test_lines_are_judged_once(spark):
    """What a line is, is told before lines become rows, and no filter on rows tells it again."""
    from lorespark.operators import structure

    frame = spark.createDataFrame([(1, "[질문] Q1. 왜?\u3000\n\ufeff \n신 념 화 ● 나는\n내용\n\t본문 x\x0b")], "doc_id int, text string")
    rows = structure._events(frame, ["doc_id"], "text").where("event is distinct from 'skip'")
    assert [(r.n, r.line, r.event, r.area, r.rest) for r in rows.orderBy("n").collect()] == [(0, "[질문] Q1. 왜?", "question", "core", "Q1. 왜?"), (2, "신 념 화 ● 나는", None, "core", ""), (3, "내용", None, "core", ""), (4, "본문 x", None, "core", "")]
    untagged = structure._events(frame.selectExpr("doc_id", "replace(text, '[질문] ', '') as text"), ["doc_id"], "text").orderBy("n").collect()
    assert [(r.event, r.area, r.rest) for r in untagged] == [("question", "core", ""), ("label", "belief", "● 나는"), ("skip", "core", ""), (None, "core", "")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter " in x and ("regexp" in x or "RLIKE" in x)]
