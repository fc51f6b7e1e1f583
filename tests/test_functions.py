"""Golden vectors for texts that the driver's tables do not hold, and properties of folds and plans."""

import re

import pytest
from pyspark.sql import functions as F

from lorespark.functions import korean as k
from lorespark.functions import similarity as s
from lorespark.functions import text as t
from lorespark.operators import alignment, cleanup, progress, quiz, structure
from lorespark.operators.sentences import sentences_with_headings


def values(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in columns))


def apply(spark, f, words):
    n = len(words[0]) if isinstance(words[0], tuple) else 1
    rows = [w if isinstance(w, tuple) else (w,) for w in words]
    names = [f"c{j}" for j in range(n)]
    return [r[0] for r in values(spark, names, rows).orderBy("i").select(f(*map(F.col, names)).alias("v")).collect()]


def test_keys_and_hashes(spark):
    assert apply(spark, t.normalize_text, ["이 성계.", "A B C　D!", None, "a-b_c"]) == ["이성계", "abcd", "", "abc"]
    assert apply(spark, t.hash_string, ["", "abc", "심장"]) == ["45h:0", "3772q3:3", "4hzkm:2"]


def test_particles(spark):
    assert apply(spark, k.strip_particle, ["심장은", "국가는", "뇌는", "마을", "사과", "(학교에서는)", "abc,", None]) == ["심장", "국가", "뇌", "마을", "사과", "학교", "abc", ""]
    assert apply(spark, k.has_batchim, ["심장", "수도", "3", "2", ""]) == [True, False, True, False, False]
    assert apply(spark, lambda c: k.josa(c, "은", "는"), ["심장", "수도"]) == ["심장은", "수도는"]
    assert apply(spark, k.to_jamo, ["수도", "값 a", ""]) == ["ㅅㅜㄷㅗ", "ㄱㅏㅄa", ""]


def test_keywords_and_blanks(spark):
    sentence = "대한민국의 수도는 서울이다."
    found = apply(spark, k.keyword_candidates, [sentence])[0]
    assert [(x.stem, x.score) for x in found] == [("대한민국", 3.0), ("수도", 2.5)]
    assert apply(spark, k.choose_blank, [sentence])[0].answer == "대한민국"
    assert apply(spark, t.make_blank, [(sentence, "서울"), (sentence, "부산")]) == ["대한민국의 수도는 [      ]이다.", None]
    assert apply(spark, k.split_topic, ["심장은 혈액을 순환시킨다."])[0].subject == "심장"
    assert apply(spark, k.is_trivial_answer, ["역할", "은", "", "심장"]) == [True, True, True, False]


def read_sentences(text):
    """Line by line, with what is open."""
    lines = [x for x in text.split("\n") if re.search(r"\S", x)]
    ends, goes = (lambda x: bool(re.search(t.SENTENCE_END, x))), (lambda x: bool(re.search(t.LINE_GOES_ON, x)))
    heads = lambda x: len(x) <= 24 and not re.search(t.LIST_LINE, x) and not ends(x) and not goes(x) and bool(re.search(t.HEADING_START, x) or len(re.findall(r"\s", x)) < 3)
    out, held, heading = [], "", ""
    for n, line in enumerate(lines):
        after = lines[n + 1] if n + 1 < len(lines) else None
        clean = " ".join(re.sub(t.BULLETS, "", line).split())
        if not held and heads(line.strip()):
            heading = clean
            continue
        if not clean:
            continue
        held = f"{held} {clean}".strip()
        stops = after is None or re.match(t.BULLET, after) or heads(after.strip())
        if ends(held) or stops or (not goes(held) and len(held) < 28 and len(clean.split()) < 3):
            out += [(s.strip(), heading) for s in re.split(r"(?<=[.!?。])\s+", held) if s.strip()]
            held = ""
    return out


def test_sentences_against_a_line_by_line_reader(spark):
    import random

    draw = random.Random(4)
    lines = ["심장은 혈액을", "짧다 긴", "두 낱말", "아주 길고 긴 줄로서 스물여덟 글자를 넘기는 말의 줄 하나", "끝난다. 다음", "제목", "1. 첫째 항목", "- 항목 둘", "•", "", " ", "네 낱말로 된 줄", "abc def ghi", "나눈다", "1장 시작"]
    texts = ["\n".join(draw.choices(lines, k=draw.choice([2, 6, 15, 40]))) for _ in range(300)]
    found = sentences_with_headings(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert {(r.doc_id, r.n): (r.sentence, r.heading) for r in found} == {(i, n): s for i, x in enumerate(texts) for n, s in enumerate(read_sentences(x))}


def test_sentences_of_a_long_text_in_linear_time(spark):
    text = "\n".join(f"줄 {i} 은 길게 이어지는 말이고" if i % 7 else f"줄 {i} 은 끝난다." for i in range(30_000))
    assert sentences_with_headings(spark.createDataFrame([(1, text)], "doc_id int, text string")).count() == 4287


def test_sentences(spark):
    text = "심장의 구조\n심장은 혈액을 온몸으로\n보내는 기관이다. 심방과 심실로 나뉜다.\n- 첫째 항목이다"
    rows = sentences_with_headings(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("n").collect()
    assert [(r.doc_id, r.sentence, r.heading) for r in rows] == [
        (1, "심장은 혈액을 온몸으로 보내는 기관이다.", "심장의 구조"), (1, "심방과 심실로 나뉜다.", "심장의 구조"), (1, "첫째 항목이다", "심장의 구조"),
    ]
    assert apply(spark, t.category_of, ["광복은 1945년이다", "심장은 혈액 순환을 담당한다", "꽃이 핀다"]) == ["숫자·날짜", "기능·역할", "특징"]
    assert apply(spark, t.importance_of, ["★ 반드시 기억: 광복은 1945년의 일이다", "예를 들어 꽃"]) == [5, 1]


def test_similarity(spark):
    assert apply(spark, s.similarity, [("night", "nacht"), ("가나다라", "가나다라"), ("a", "a"), ("a", "b"), ("aaaa", "aa")]) == [0.25, 1.0, 1.0, 0.0, 0.5]
    assert apply(spark, s.containment, [("가나다", "마가나다라"), ("a", "xay"), ("abab", "ab")]) == [1.0, 1.0, pytest.approx(1 / 3)]
    assert apply(spark, s.fuzzy_includes, [("대한민국", "우리 대한민국 만세"), ("대한민국", "우리 데한민국 만세"), ("대한민국", "전혀 다른 글"), ("", "x")]) == [True, True, False, False]


def test_similar_pairs_equal_row_wise(spark):
    rows = [(0, "the quick brown fox"), (1, "the quick brown fix"), (2, "quick brown foxes"), (3, "else"), (4, ""), (5, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    got = {(r.a, r.b): r.similarity for r in s.similar_pairs(texts, 0.5).collect()}
    both = texts.alias("x").crossJoin(texts.alias("y")).where("x.id < y.id").select("x.id", F.col("y.id").alias("j"), s.similarity(F.col("x.text"), F.col("y.text")).alias("v"))
    assert got == {(r.id, r.j): pytest.approx(r.v) for r in both.collect() if r.v >= 0.5 and (r.id, r.j) != (4, 5)}


def test_cleanup(spark):
    assert apply(spark, cleanup.is_page_number, ["정신전력 - 5", "- 5 -", "5", "본문이다", "12345"]) == [True, True, True, False, False]
    assert apply(spark, cleanup.normalize_bullets, ["• 하나", "– 둘", "가ㆍ나"]) == ["● 하나", "- 둘", "가 · 나"]
    assert apply(spark, lambda c: cleanup.noise_reason(c, page_level=False), ["", "***", "ㅁㄴ가", "가나다라", "~~~~~~a", "가"]) == ["blank", "symbols", "loose_letters", None, None, "shred"]
    assert apply(spark, cleanup.confusable_diff, [("대할민국", "대한민국"), ("가", "가나"), ("국군", "국군"), ("사과", "나무")]) == [1, -1, 0, -1]
    assert apply(spark, cleanup.is_conjugation_pair, [("지킨", "지킬"), ("국군", "국굳")]) == [True, False]
    assert apply(spark, cleanup.strip_printed_marks, ["홍길동/2025-01-01 09:00 본문", "내용 2024-03-04 10:11"]) == ["본문", "내용"]
    assert apply(spark, cleanup.label_kind, ["핵심 내용", "핵신내용", "신념화", "다른 글"]) == ["core", "core", "belief", None]


def test_term_map(spark):
    counts = spark.createDataFrame([("대한민국", 9), ("대할민국", 1), ("국군", 8), ("국굳", 1), ("지킨", 5), ("지킬", 1), ("자신", 6), ("자산", 1), ("공산", 3)], "word string, n long")
    assert {r.word: r.term for r in cleanup.term_map(counts).collect()} == {"대할민국": "대한민국", "국굳": "국군"}


def test_watermark_words(spark):
    pages = spark.createDataFrame([(1, "/홍길동/김철수/"), (2, "홍길동/2025-01-01 09:00"), (3, "없음")], "page int, text string")
    assert {r.word: r.pages for r in cleanup.watermark_words(pages).collect()} == {"홍길동": 2, "김철수": 1}


@pytest.mark.parametrize(("weight", "outcomes", "levels"), [(1.0, "TTTTFT", [30.0, 54.5, 72.7, 85.0, 51.0, 65.7]), (0.5, "TF", [15.0, 12.0])])
def test_fold(spark, weight, outcomes, levels):
    for n in range(1, len(outcomes) + 1):
        rows = [(1, i, o == "T") for i, o in enumerate(outcomes[:n])]
        out = progress.fold_results(spark.createDataFrame(rows, "target int, n int, correct boolean"), ["target"], ["n"], weight=F.lit(weight)).first()
        assert out.level == levels[n - 1]


def test_decide_count(spark):
    wanted = {0: 0, 1: 5, 3: 6, 5: 10, 6: 10, 8: 10, 9: 12, 12: 15, 13: 15, 20: 23, 26: 30, 30: 30, 31: 31, 50: 50}
    got = spark.createDataFrame([(n,) for n in wanted], "n long").select("n", quiz.decide_count(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == wanted


def test_plan_covers_and_keeps_caps(spark):
    rows = [(u, u * 100 + i, i % 6, float(i * 7 % 100), i % 4, i % 2 == 0) for u in (1, 2) for i in range(4 + 20 * u)]
    targets = spark.createDataFrame(rows, "unit_id long, target_id long, importance int, level double, wrong_count int, studied boolean")
    plan = {r.target_id: r.times for r in quiz.plan_questions(targets).collect()}
    assert plan == {r.target_id: r.times for r in quiz.plan_questions(targets).collect()}
    for _, target, imp, *_ in rows:
        level = imp or 3
        assert plan.get(target, 0) <= quiz.MOST_REPEATS[level]
        assert level < 2 or plan.get(target, 0) >= 1


def test_spread_and_acceptance(spark):
    slots = spark.createDataFrame([(1, t_, n) for n, t_ in enumerate("aaabbbccd")], "session_id int, target_id string, question_id int")
    rows = {r.question_id: r.ord for r in quiz.spread(slots).collect()}
    ids = {r.question_id: r.target_id for r in slots.collect()}
    import hashlib

    wanted = sorted(ids, key=lambda q: hashlib.md5(f"1:1:{q}".encode()).hexdigest())
    before = sum(ids[a] == ids[b] for a, b in zip(wanted, wanted[1:], strict=False))
    for i in range(1, len(wanted)):
        on = [ids[q] for q in wanted]
        partners = [k for k in range(i + 1, len(on)) if on[k] != on[i] and on[k + 1 : k + 2] != [on[i]]]
        if on[i] == on[i - 1] and partners:
            wanted[i], wanted[partners[0]] = wanted[partners[0]], wanted[i]
    order = sorted(rows, key=rows.get)
    assert order == wanted and sorted(rows.values()) == list(range(len(ids)))
    assert sum(ids[a] == ids[b] for a, b in zip(order, order[1:], strict=False)) < before
    questions = spark.createDataFrame([(1, 1, "a", "OX", "what is the capital of korea"), (1, 2, "b", "OX", "what is the capital of koreas"), (1, 3, "a", "OX", "entirely different words"), (1, 4, "c", "OX", "a third unrelated thing")], "session_id int, ord int, target_id string, type string, question string")
    assert [r.accepted for r in quiz.accept_in_order(questions).orderBy("ord").collect()] == [True, False, False, True]


def test_quality_gate(spark):
    rows = [("FILL_BLANK", "대한민국의 수도는 [      ]이다. 알맞은 말은?", "서울"), ("FILL_BLANK", "대한민국의 수도는 서울이다. 알맞은 말은?", "서울"), ("SHORT_ANSWER", "다음 내용에 대해 올바른 것은?", "역할")]
    excerpt = "대한민국의 수도는 서울이다."
    got = apply(spark, lambda kind, q, a: quiz.quality_reasons(kind, q, F.array(a), a, F.lit(excerpt), F.lit(excerpt), F.lit(excerpt), F.lit(3)), rows)
    assert got[0] == []
    assert set(got[1]) == {"no_blank", "answer_in_question"}
    assert {"question_too_short", "vague_question", "trivial_answer"} <= set(got[2])


def test_judge_change(spark):
    rows = [("데한민국", "대한민국", "high"), ("l392", "1392", "high"), ("1392", "1393", "high"), ("가나", "", "high"), ("가 나.", "가나", "low"), ("대한", "대한민국만세입니다", "high"), ("데한민국", "대한민국", "low")]
    assert apply(spark, alignment.judge_change, rows) == ["apply", "apply", "confirm", "reject", "apply", "reject", "confirm"]


def test_alignment_and_consensus(spark):
    left = spark.createDataFrame([(1, 0, "대한민국 헌법"), (1, 1, "국군의 사명"), (1, 2, "마지막 줄입니다")], "page int, line_no int, line string")
    right = spark.createDataFrame([(1, 0, "대한민국 헌법"), (1, 1, "마지막 줄입니다")], "page int, line_no int, line string")
    assert sorted([(r.left_no, r.right_no) for r in alignment.align_pages(left, right).collect()], key=str) == [(0, 0), (1, None), (2, 1)]
    readings = spark.createDataFrame([(1, v, n, line, sc) for v, sc, lines in (("A", 0.9, ["국군은 나라를 지킨다", "둘째 줄이다"]), ("B", 0.8, ["국군은 나라를 지킨다"]), ("C", 0.7, ["국굳은 나라를 지킨다", "둘째 줄이다"])) for n, line in enumerate(lines)], "page int, variant string, line_no int, line string, score double")
    grouped = alignment.grouped_readings(readings)
    lexicon = spark.createDataFrame([("국군", 3)], "stem string, n long")
    assert [(r.line, r.agree) for r in alignment.consensus(grouped, lexicon).orderBy("grp").collect()] == [("국군은 나라를 지킨다", 3), ("둘째 줄이다", 2)]


def test_apply_changes(spark):
    pages = spark.createDataFrame([(1, "데한 민국 만세 데한민국"), (2, None)], "page int, text string")
    changes = spark.createDataFrame([(1, 1, "데한민국", "대한민국"), (1, 2, "데한민국", "대한민국"), (1, 3, "없음", "x")], "page int, ord int, `from` string, `to` string")
    assert [(r.text, r.applied) for r in alignment.apply_changes(pages, changes).orderBy("page").collect()] == [("대한민국 만세 대한민국", 2), ("", 0)]


TAGGED = """[제목] 우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)
[질문] Q3. (★민주주의와 헌법수호) 군인이 헌법을 수호해야 하는 이유는?
[핵심 내용]
1. 헌법의 의미
헌법은 국가의 최고 규범이다.
- 헌법 수호
국군은 헌법을 수호한다.
구분 | 내용
[신념화]
● 나는 헌법을 지킨다.
● 나는 국민을 지킨다."""


def test_structure_round_trip(spark):
    documents = spark.createDataFrame([(1, TAGGED + "\n\n" + TAGGED.replace("Q3", "Q4")), (2, "")], "doc_id int, text string")
    nodes = structure.nodes(documents)
    rows = nodes.where("page = 1").orderBy("node_no").collect()
    assert [r.kind for r in rows] == ["title", "question", "section", "content", "subsection", "content", "table", "belief", "belief"]
    assert (rows[1].number, rows[1].starred, rows[1].tags) == ("3", True, ["민주주의와 헌법수호"])
    assert structure.render(nodes).first().text == documents.first().text
    assert apply(spark, structure.has_tags, [TAGGED, "없다"]) == [True, False]
    assert apply(spark, structure.parse_header, ["우리가 지켜야 하는 대한민국 (1-3. 대한민국을 수호하는 국군)"])[0].lesson == "1-3. 대한민국을 수호하는 국군"


def test_terms(spark):
    got = apply(spark, t.parse_term, ["대퇴골: 인체에서 가장 긴 뼈", "해마 → 기억 형성에 중요한 뇌 구조", "apple 사과", "그냥 글"])
    assert [(g and (g.term, g.definition)) for g in got] == [("대퇴골", "인체에서 가장 긴 뼈"), ("해마", "기억 형성에 중요한 뇌 구조"), ("apple", "사과"), None]
    assert apply(spark, t.parse_json_loose, ['```json\n{"a": 1}\n```', 'text {"b": [2]} more', "none"]) == ['{"a": 1}', '{"b": [2]}', None]


def test_merged_structure(spark):
    local = spark.createDataFrame([(1, 0, "content", "데한민국 헌법을 지킨다"), (1, 1, "content", "국군의 사명을 다한다")], "page int, line_no int, kind string, line string")
    other = spark.createDataFrame([(1, 0, "content", "대한민국 헌법을 지킨다", "high"), (1, 1, "section", "국군의 사명", "high"), (1, 2, "content", "없던 문장이 새로 생겼다", "high")], "page int, line_no int, kind string, line string, confidence string")
    got = {(r.left_no, r.right_no): (r.verdict, r.line) for r in alignment.merged_structure(local, other).collect()}
    assert got[0, 0] == ("apply", "대한민국 헌법을 지킨다")
    assert got[None, 2] == ("unverified", None)
    assert [v for k, v in got.items() if k[0] == 1] == [("confirm", "국군의 사명을 다한다")]


def test_clean_lines(spark):
    rows = [(1, 0, "홍길동/2025-01-01 09:00 대할민국은 나라다"), (1, 1, "- 5 -"), (1, 2, "***"), (1, 3, "• 항목이다"), (1, 4, "2025-01-01 09:00"), (1, 5, "")]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, line string")
    terms = spark.createDataFrame([("대할민국", "대한민국")], "word string, term string")
    got = {r.line_no: (r.clean, r.dropped) for r in cleanup.clean_lines(lines, terms).collect()}
    assert got == {0: ("대한민국은 나라다", None), 1: (None, "pageNumber"), 2: (None, "symbols"), 3: ("● 항목이다", None), 4: (None, "watermark"), 5: (None, "blank")}


def test_strip_learned(spark):
    words, digits, protected = (F.array(*map(F.lit, x)) for x in (["홍길동", "상사"], ["2025", "09:00"], ["상사"]))
    got = apply(spark, lambda c: cleanup.strip_learned(c, words, digits, protected)["text"], ["국가는 홍길동 나라다", "상사 명령에 따른다", "/홍길동 상사 09:00 국가", "조국 2025 통일", "2025 년의 일", "홍길동"])
    assert got == ["국가는 나라다", "상사 명령에 따른다", "국가", "조국 통일", "2025 년의 일", ""]


def test_chunks(spark):
    text = "\n".join("x" * n for n in (3, 4, 2, 30, 1, 1, 5))
    (chunks,) = apply(spark, lambda c: t.chunk_text(c, 10), [text])
    assert "\n".join(chunks) == text
    assert all(len(c) <= 10 or "\n" not in c for c in chunks)
    assert apply(spark, t.chunk_text, [""]) == [[""]]
