"""Candidate questions of every kind for key points: a table from which plans and gates choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.korean import josa, split_topic
from lorespark.functions.text import BLANK, category_of, normalize_text
from lorespark.operators.points import phrase_blank
from lorespark.operators.progress import importance
from lorespark.operators.quiz import CHOICE, ESSAY, TEXT, difficulty, distractors, grade_mode

# ---- Fixed values -------------------------------------------------------------------------------------------------
ASK_TRUTH = "다음 내용이 자료와 일치하면 O, 틀리면 X를 고르시오.\n"
ASK_CHOICE = "다음 [      ]에 들어갈 알맞은 말은?\n"
ASK_BLANK = "빈칸에 들어갈 말을 쓰시오.\n"
ASK_TERM = "다음 설명에 해당하는 것은?\n“{}”"
ASK_SHORT = "다음에서 ○○에 알맞은 말을 한두 단어로 쓰시오.\n"
ASK_ABOUT = "‘{}’에 대해 자료에 나온 핵심 내용을 설명하시오."
#: Essay questions by category: particles for closed and open ends, and the words that follow.
ESSAYS = (
    ("기능·역할", "은", "는", " 어떤 기능(역할)을 하는가? 자료 내용대로 쓰시오."),
    ("정의", "이란", "란", " 무엇인가? 자료의 정의대로 쓰시오."),
    ("원인·결과", "", "", "에 대해 자료에 나온 원인과 결과를 쓰시오."),
    ("구조·위치", "", "", "의 구조나 위치를 자료 내용대로 쓰시오."),
    ("숫자·날짜", "", "", "에 관한 수치·날짜를 포함해 자료 내용대로 쓰시오."),
)
#: Weights of easy, middle and hard kinds for levels below a bound, and for higher ones.
WEIGHTS = (
    (30, {"easy": 1.6, "middle": 1.0, "hard": 0.5}),
    (70, {"easy": 1.0, "middle": 1.3, "hard": 1.0}),
    (None, {"easy": 0.6, "middle": 1.1, "hard": 1.6}),
)
DETAIL_AS_ESSAY, CORE_AS_RECALL, USED, SAME_AS_LAST = 0.2, 1.2, 0.02, 0.35
OTHER_ESSAY = ("자료에 따르면 ", "은", "는", " 어떠한가? 핵심 내용을 쓰시오.")
# -------------------------------------------------------------------------------------------------------------------


def filled(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def essay(subject: Column, category: Column) -> Column:
    out = F.concat(F.lit(OTHER_ESSAY[0]), josa(subject, *OTHER_ESSAY[1:3]), F.lit(OTHER_ESSAY[3]))
    for name, closed, open_, rest in ESSAYS:
        out = F.when(category == name, F.concat(josa(subject, closed, open_), F.lit(rest))).otherwise(out)
    return out


def content_questions(points: DataFrame, seed: int = 1, options: int = 3) -> DataFrame:
    """``point_id, unit_id, type, difficulty, grade_mode, question, options, answer``: what can be asked about each point.

    points: point_id, unit_id, text, importance. Wrong options are other points' answers of the unit. True or false, and
    the order of options, are drawn from a hash of the point and the seed.
    """
    rows = points.select("point_id", "unit_id", "text", importance().alias("importance"), phrase_blank(F.col("text")).alias("blank"), split_topic(F.col("text")).alias("topic"))
    rows = rows.withColumn("category", category_of(F.col("text")))
    wrong = distractors(rows.select("point_id", "unit_id", "text", F.col("blank.answer").alias("answer")), options, sentence="text")
    wrong = wrong.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("n", "option"))).alias("w")).select("point_id", F.transform("w", lambda x: x["option"]).alias("wrong"))
    rows = rows.join(wrong, "point_id", "left")
    answer, blanked, text = F.col("blank.answer"), F.col("blank.blank_text"), F.col("text")
    subject, predicate = F.col("topic.subject"), F.col("topic.predicate")
    none = F.lit(None).cast("array<string>")
    altered = F.replace(blanked, F.lit(BLANK), F.get("wrong", F.lit(0)))
    false = (F.pmod(F.xxhash64(F.lit(seed), F.col("point_id")), F.lit(2)) == 0) & altered.isNotNull()
    shuffled = F.transform(F.array_sort(F.transform(F.concat(F.array(answer), F.col("wrong")), lambda o: F.struct(F.xxhash64(F.lit(seed), F.col("point_id"), o).alias("h"), o.alias("o")))), lambda x: x["o"])
    term = normalize_text(subject) == normalize_text(answer)

    def made(kind: str, when: Column, question: Column, choices: Column, right: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), question.alias("question"), choices.alias("options"), right.alias("answer")))

    kinds = F.array(
        made("OX", text.isNotNull(), F.concat(F.lit(ASK_TRUTH), F.when(false, altered).otherwise(text)), F.array(F.lit("O"), F.lit("X")), F.when(false, "X").otherwise("O")),
        made("MULTIPLE_CHOICE", answer.isNotNull() & (F.size("wrong") >= 2), F.concat(F.lit(ASK_CHOICE), blanked), shuffled, answer),
        made("FILL_BLANK", answer.isNotNull(), F.concat(F.lit(ASK_BLANK), blanked), none, answer),
        made("SHORT_ANSWER", answer.isNotNull(), F.when(term, filled(ASK_TERM, F.regexp_replace(predicate, "[.。]$", ""))).otherwise(F.concat(F.lit(ASK_SHORT), F.replace(blanked, F.lit(BLANK), F.lit("○○")))), none, answer),
        made("SUBJECTIVE", subject.isNotNull(), essay(subject, F.col("category")), none, predicate),
        made("DESCRIPTIVE", F.coalesce(subject, answer).isNotNull() & (F.col("importance") >= 3), filled(ASK_ABOUT, F.coalesce(subject, answer)), none, text),
    )
    out = rows.select("point_id", "unit_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("q")).select("point_id", "unit_id", "q.*")
    return out.select("point_id", "unit_id", "type", difficulty(F.col("type")).alias("difficulty"), grade_mode(F.col("type")).alias("grade_mode"), "question", "options", "answer")


def kind_weights(level: Column, importance_: Column, used: Column, last_kind: Column, counts: Column | None = None, supported: Column | None = None) -> dict[str, Column]:
    """The weight of each kind of question for a target, by its level and importance; lower for kinds it had.

    counts: a map of how often the session has each kind already. supported: how many kinds the target has; the kind it
    had last counts less only where there is another.
    """
    choice = F.lit(True) if supported is None else supported > 1
    out = {}
    for kind in (*CHOICE, *TEXT, *ESSAY):
        family = "easy" if kind in CHOICE else "middle" if kind in TEXT else "hard"
        weight = F.lit(WEIGHTS[-1][1][family])
        for below, by_family in reversed(WEIGHTS[:-1]):
            weight = F.when(level < below, by_family[family]).otherwise(weight)
        if family == "hard":
            weight = weight * F.when(importance_ <= 2, DETAIL_AS_ESSAY).otherwise(1.0)
        if family == "middle":
            weight = weight * F.when(importance_ >= 5, CORE_AS_RECALL).otherwise(1.0)
        if counts is not None:
            weight = weight / (1 + F.coalesce(F.element_at(counts, F.lit(kind)), F.lit(0)))
        out[kind] = weight * F.when(F.array_contains(used, kind), USED).otherwise(1.0) * F.when((last_kind == kind) & choice, SAME_AS_LAST).otherwise(1.0)
    return out


def ordered_kinds(targets: DataFrame, candidates: DataFrame, seed: int = 1) -> DataFrame:
    """``point_id, n, type``: the kinds to try for each target in a weighted random order, without repeats.

    targets: point_id, level, importance, used, last_kind and, if the session has questions already, kind_counts (a map);
    candidates as from :func:`content_questions`.
    """
    counts = F.coalesce("kind_counts", F.create_map().cast("map<string,int>")) if "kind_counts" in targets.columns else None
    weights = kind_weights(F.coalesce("level", F.lit(0.0)), importance(), F.coalesce("used", F.array().cast("array<string>")), F.coalesce("last_kind", F.lit("")), counts, F.col("supported"))
    table = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*weights.values()))
    kinds = candidates.select("point_id", "type").distinct().withColumn("supported", F.count("*").over(Window.partitionBy("point_id")))
    rows = kinds.join(targets, "point_id").withColumn("w", F.element_at(table, F.col("type")))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "point_id", "type"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    place = F.row_number().over(Window.partitionBy("point_id").orderBy(-F.log(unit) / F.col("w"), "type"))
    return rows.withColumn("n", place).select("point_id", "n", "type")
