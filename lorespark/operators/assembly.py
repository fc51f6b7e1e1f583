"""Tests put together from plans and candidate questions, and the forms of questions that come from elsewhere."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import BLANK, normalize_text, text_of
from lorespark.operators.progress import importance
from lorespark.operators.questions import CORE_AS_RECALL, DETAIL_AS_ESSAY, SAME_AS_LAST, USED, WEIGHTS, content_questions
from lorespark.operators.quiz import CHOICE, MOST_REPEATS, TEXT, in_groups, plan_questions, quality_reasons, spread
from lorespark.sources.tables import settled

# ---- Fixed values -------------------------------------------------------------------------------------------------
REFILL_FROM, REFILL_REPEATS, ALIKE_FROM = 4, 3, 0.85
TRUE_WORDS, FALSE_WORDS = ("O", "○", "TRUE", "참", "맞음", "예"), ("X", "×", "FALSE", "거짓", "틀림", "아니오")
ANY_BLANK = r"\[\s*\]|\(\s{2,}\)|_{2,}|\[\s*_+\s*\]"
LEAST_OPTIONS, MOST_OPTIONS = 2, 6
# -------------------------------------------------------------------------------------------------------------------


def _weight(kind: str, row, used: list[str], counts: Counter, supported: int) -> float:
    """As :func:`lorespark.operators.questions.kind_weights`, for one target in the course of an assembly."""
    family = "easy" if kind in CHOICE else "middle" if kind in TEXT else "hard"
    weight = next(by[family] for below, by in WEIGHTS if below is None or (row.level or 0) < below)
    weight *= DETAIL_AS_ESSAY if family == "hard" and row.importance <= 2 else CORE_AS_RECALL if family == "middle" and row.importance >= 5 else 1
    return weight / (1 + counts[kind]) * (USED if kind in used else 1) * (SAME_AS_LAST if row.last_kind == kind and supported > 1 else 1)


class _Assembly:
    """One unit's test in the making."""

    def __init__(self, unit, seed: int):
        self.unit, self.seed = unit, seed
        self.accepted: list[tuple] = []
        self.used: dict[object, list[str]] = {}
        self.counts: Counter = Counter()
        self.attempts: list[tuple] = []

    def kinds(self, row, open_: list[str]) -> list[str]:
        """The kinds in a weighted random order: the least exponential keys, from an md5 of seed, target, round and kind."""
        used = self.used.get(row.target_id, [])

        def key(kind: str) -> tuple[float, str]:
            draw = int(hashlib.md5(f"{self.seed}:{row.target_id}:{len(used)}:{kind}".encode()).hexdigest()[:12], 16)
            return -math.log((draw + 0.5) / (1 << 48)) / _weight(kind, row, used, self.counts, len(open_)), kind

        return sorted(open_, key=key)

    def try_one(self, row, candidate: dict | None, how: str, last_resort: bool = False) -> bool:
        if candidate is None:
            return False
        grams = Counter(candidate["key"][i : i + 2] for i in range(len(candidate["key"]) - 1))
        reasons = [] if candidate["reasons"] is None else list(candidate["reasons"])
        for target, kind, other, key in self.accepted:
            size = sum(grams.values()) + sum(other.values())
            if (target, kind) == (row.target_id, candidate["type"]) or (2 * sum((grams & other).values()) / size if size else float(key == candidate["key"])) >= ALIKE_FROM:
                reasons.append("repeats_another")
                break
        good = not reasons or last_resort
        self.attempts.append((self.unit, len(self.attempts), row.target_id, candidate["type"], how if good else "rejected", reasons))
        if good:
            self.accepted.append((row.target_id, candidate["type"], grams, candidate["key"]))
            self.counts[candidate["type"]] += 1
            self.used.setdefault(row.target_id, []).append(candidate["type"])
        return good

    def slot(self, row, how: str) -> bool:
        by_kind = {c["type"]: c for c in ([] if row.candidates is None else row.candidates)}
        used = self.used.get(row.target_id, [])
        open_ = [k for k in by_kind if how == "planned" or k not in used]
        if any(self.try_one(row, by_kind[k], how) for k in self.kinds(row, open_)):
            return True
        if how != "planned" or used:
            return False
        # Cover the target at any rate: by its plain question, good or not.
        return self.try_one(row, row.fallback, "fallback") or self.try_one(row, row.fallback, "last_resort", True)


def _assembled(rows: list, unit: str, seed: int) -> Iterator[tuple]:
    test = _Assembly(getattr(rows[0], unit), seed)
    rounds = max(row.times for row in rows)
    slots = [row for n in range(rounds) for row in rows if row.times > n]
    missing = sum(not test.slot(row, "planned") for row in slots)
    fillers = sorted((r for r in rows if r.importance >= REFILL_FROM), key=lambda r: (-r.importance, r.level or 0))
    for row in fillers:
        most = max(MOST_REPEATS[min(int(row.importance), 5)], REFILL_REPEATS)
        while missing and len(test.used.get(row.target_id, [])) < most and test.slot(row, "refilled"):
            missing -= 1
    return iter(test.attempts)


def assembled(plan: DataFrame, targets: DataFrame, candidates: DataFrame, fallback: str = "OX", seed: int = 1, unit: str = "unit_id") -> DataFrame:
    """``unit, attempt, target_id, type, result, reasons``: every question tried for a test, in order.

    result: ``planned``, ``fallback``, ``last_resort`` and ``refilled`` are in the test, ``rejected`` is not. For each
    place of the plan the target's kinds are tried in a weighted random order until one is good and neither repeats
    target and kind nor nearly the words of one before. A target that gets none has its ``fallback`` kind, good or not.
    Places left empty are filled with other kinds for important targets, three each.

    plan: unit, target_id, times; targets: target_id, importance, level, last_kind; candidates: target_id, type, question,
    reasons (of :func:`lorespark.operators.quiz.quality_reasons`). What is tried depends on what was taken before, so a
    unit's targets, with six candidates each, meet in one task; a unit is one exam's material.
    """
    one = F.struct("type", normalize_text(F.col("question")).alias("key"), "reasons")
    listed = candidates.groupBy("target_id").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    rows = plan.join(targets.select("target_id", importance().cast("int").alias("importance"), "level", "last_kind"), "target_id").join(listed, "target_id", "left")
    rows = rows.withColumn("fallback", F.get(F.filter("candidates", lambda c: c["type"] == fallback), F.lit(0)))
    kinds = dict(plan.dtypes)
    schema = f"{unit} {kinds[unit]}, attempt int, target_id {kinds['target_id']}, type string, result string, reasons array<string>"
    return in_groups(rows, unit, ["target_id"], lambda r: _assembled(r, unit, seed), schema)


def candidate_questions(points: DataFrame) -> DataFrame:
    """``target_id, type, question, options, answer, reasons``: every question that can be made about each point, with the
    reasons against it. points: unit_id, point_id, text, source_excerpt, importance."""
    own = points.select("point_id", F.col("text").alias("_text"), F.col("source_excerpt").alias("_excerpt"), F.col("importance").alias("_importance"))
    made = content_questions(points.select("point_id", "unit_id", "text", "importance")).join(own, "point_id")
    reasons = quality_reasons(F.col("type"), F.col("question"), F.col("options"), F.col("answer"), F.col("_excerpt"), F.col("_text"), F.col("_excerpt"), F.col("_importance"))
    return made.select(F.col("point_id").alias("target_id"), "type", "question", "options", "answer", reasons.alias("reasons"))


def unit_tests(points: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tests of whole units: the questions in order, what was tried for them, and the plan.

    points: unit_id, point_id, text, source_excerpt, importance, level, wrong_count, studied, last_kind. The plan says how
    often each point is asked (0: a detail left for another test); candidates are made and judged; the test is assembled
    from them and spread, so that questions about one point stand apart.

    Questions: ``unit_id, ord, target_id, type, question, options, answer, result``.
    """
    targets = points.select("unit_id", F.col("point_id").alias("target_id"), "importance", "level", "wrong_count", "studied", "last_kind")
    plan = settled(plan_questions(targets, seed, skipped=True))
    candidates = settled(candidate_questions(points))
    tried = settled(assembled(plan.where("times > 0"), targets, candidates, seed=seed))
    taken = tried.where("result <> 'rejected'").withColumn("question_id", F.concat_ws(":", "unit_id", "attempt"))
    order = spread(taken.select(F.col("unit_id").alias("session_id"), "target_id", "question_id"), seed)
    order = order.select(F.col("session_id").alias("unit_id"), "question_id", "ord")
    first = F.row_number().over(Window.partitionBy("target_id", "type").orderBy("question"))
    made = candidates.withColumn("_n", first).where("_n = 1").drop("_n", "reasons")
    questions = taken.join(order, ["unit_id", "question_id"]).join(made, ["target_id", "type"], "left")
    return questions.select("unit_id", "ord", "target_id", "type", "question", "options", "answer", "result"), tried, plan


def assembly_statistics(attempts: DataFrame, unit: str = "unit_id") -> DataFrame:
    """``unit, built, rejected, taken, refilled, last_resorts``: counts of an assembly's attempts."""
    counted = lambda *names: F.count_if(F.col("result").isin(*names))
    return attempts.groupBy(unit).agg(
        F.count("*").alias("built"), counted("rejected").alias("rejected"), counted("planned", "fallback", "last_resort", "refilled").alias("taken"),
        counted("refilled").alias("refilled"), counted("last_resort").alias("last_resorts"),
    )


def not_covered(targets: DataFrame, attempts: DataFrame) -> DataFrame:
    """Targets of importance 2 and up that no question in the test asks for."""
    taken = attempts.where("result <> 'rejected'").select("target_id")
    return targets.where(importance() >= 2).join(taken, "target_id", "left_anti")


def truth_value(c: Column) -> Column:
    """``O``, ``X`` or null for the words that mean them."""
    word = F.upper(F.trim(text_of(c)))
    return F.when(word.isin(*TRUE_WORDS), "O").when(word.isin(*FALSE_WORDS), "X")


def distinct_options(options: Column) -> Column:
    """The options that are not blank, trimmed, the first of those with equal keys."""
    kept = F.filter(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.trim(text_of(o))), lambda o: o != "")
    keyed = F.transform(kept, lambda o, i: F.struct(o.alias("o"), normalize_text(o).alias("k"), i.alias("i")))
    return F.transform(F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))), lambda x: x["o"])


def valid_questions(questions: DataFrame) -> DataFrame:
    """The questions whose form is right, in the form that the stores have; the others are left out.

    questions: type, question, answer, options, explanation, source_excerpt, context and any other columns. Question,
    answer and an excerpt of three characters or more that the context has are needed. True-or-false answers become O or
    X; a choice needs two to six distinct options, one of them the answer; a text's first blank becomes the usual one.
    """
    excerpt = normalize_text(F.col("source_excerpt"))
    options = distinct_options(F.col("options"))
    chosen = F.get(F.filter(options, lambda o: normalize_text(o) == normalize_text(F.col("answer"))), F.lit(0))
    sized = (F.size(options) >= LEAST_OPTIONS) & (F.size(options) <= MOST_OPTIONS)
    answer = F.when(F.col("type") == "OX", truth_value(F.col("answer"))).when(F.col("type") == "MULTIPLE_CHOICE", F.when(sized, chosen)).otherwise(F.nullif(F.trim(text_of(F.col("answer"))), F.lit("")))
    question = F.trim(text_of(F.col("question")))
    whole = (question != "") & (F.length(excerpt) >= 3) & F.contains(normalize_text(F.col("context")), excerpt) & (F.trim(text_of(F.col("answer"))) != "")
    values = {
        "_question": F.when(F.col("type") == "FILL_BLANK", F.regexp_replace(question, f"(?s)^(.*?)(?:{ANY_BLANK})", f"$1{BLANK}")).otherwise(question),
        "_answer": answer,
        "_options": F.when(F.col("type") == "OX", F.array(F.lit("O"), F.lit("X"))).when(F.col("type") == "MULTIPLE_CHOICE", options),
        "_explanation": F.trim(text_of(F.col("explanation"))),
        "_source_excerpt": F.trim(text_of(F.col("source_excerpt"))),
    }
    kept = questions.where(whole).withColumns(values).where("_answer is not null")
    return kept.withColumns({c[1:]: F.col(c) for c in values}).drop(*values)
