"""Learning levels and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import half_up

CORE_FROM = 4
DEFAULT_IMPORTANCE = 3


def importance(c: str | Column = "importance") -> Column:
    """Null and 0 count as the default."""
    column = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(column, F.lit(0)) == 0, DEFAULT_IMPORTANCE).otherwise(column)


def apply_result(state: Column, correct: Column, weight: Column) -> Column:
    """One answer's effect on ``struct<level, correct, wrong, streak, last>``; the level is kept to a tenth."""
    streak = F.when(correct, state["streak"] + 1).otherwise(0)
    gain = (100.0 - state["level"]) * (0.25 + 0.05 * F.least(streak, F.lit(4))) * weight
    level = F.when(correct, state["level"] + gain).otherwise(state["level"] * (1.0 - 0.4 * weight))
    tenth = F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(100.0)) * 10 + 0.5) / 10.0
    return F.struct(
        tenth.alias("level"),
        (state["correct"] + correct.cast("int")).alias("correct"),
        (state["wrong"] + (~correct).cast("int")).alias("wrong"),
        streak.cast("int").alias("streak"),
        correct.alias("last"),
    )


def fold_results(answers: DataFrame, target: list[str], order: list[str], correct: str = "correct", weight: Column | None = None) -> DataFrame:
    """Each target's level after its answers in order.

    The rounded level makes the fold sequential, so a target's answers (order keys and outcome only) meet in one row.
    """
    w = F.lit(1.0) if weight is None else weight
    kept = answers.where(F.col(correct).isNotNull())
    lists = kept.groupBy(*target).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(correct).alias("_ok"), w.cast("double").alias("_w")))).alias("answers"))
    start = F.struct(F.lit(0.0).alias("level"), F.lit(0).alias("correct"), F.lit(0).alias("wrong"), F.lit(0).alias("streak"), F.lit(None).cast("boolean").alias("last"))
    state = F.aggregate("answers", start, lambda s, a: apply_result(s, a["_ok"], a["_w"]))
    return lists.withColumn("state", state).select(*target, "state.level", "state.correct", "state.wrong", "state.streak", "state.last")


def unit_progress(points: DataFrame) -> DataFrame:
    """Per unit: rounded mean level, that of core points, counts by importance, studied points, last time."""
    level = F.coalesce("level", F.lit(0.0))
    at = lambda n: F.count_if(importance() == n).alias(f"importance_{n}")
    return points.groupBy("unit_id").agg(
        half_up(F.avg(level)).alias("pct"),
        half_up(F.avg(F.when(importance() >= CORE_FROM, level))).alias("core_pct"),
        *(at(n) for n in (5, 4, 3, 2, 1)),
        F.count("*").alias("point_count"),
        F.count_if(F.coalesce("last_studied_at", F.lit(0)) != 0).alias("studied_count"),
        F.nullif(F.max(F.coalesce("last_studied_at", F.lit(0))), F.lit(0)).alias("last_studied_at"),
    )


def subject_progress(units: DataFrame, points: DataFrame, words: DataFrame, materials: DataFrame) -> DataFrame:
    """Per subject, the mean over all items: words, points, and a zero for each unit with materials but no points."""
    own = units.select("unit_id", "subject_id")
    by_points = points.join(own, "unit_id").select("subject_id", F.coalesce("level", F.lit(0.0)).alias("level"), F.lit("point").alias("kind"))
    empty = own.join(materials.select("unit_id").distinct(), "unit_id", "left_semi").join(points.select("unit_id").distinct(), "unit_id", "left_anti")
    phantoms = empty.select("subject_id", F.lit(0.0).alias("level"), F.lit("point").alias("kind"))
    by_words = words.select("subject_id", F.coalesce("level", F.lit(0.0)).alias("level"), F.lit("word").alias("kind"))
    items = by_points.unionByName(phantoms).unionByName(by_words)
    return items.groupBy("subject_id").agg(half_up(F.avg("level")).alias("pct"), F.count_if(F.col("kind") == "point").alias("point_count"), F.count_if(F.col("kind") == "word").alias("word_count"))


def content_progress(units: DataFrame, points: DataFrame, materials: DataFrame) -> DataFrame:
    """Per subject, the mean of its units' rounded levels, over units that have points or materials."""
    levels = points.groupBy("unit_id").agg(half_up(F.avg(F.coalesce("level", F.lit(0.0)))).alias("pct"))
    used = units.join(levels, "unit_id", "left").join(materials.select("unit_id").distinct().withColumn("_has", F.lit(True)), "unit_id", "left")
    return used.where("pct is not null or _has").groupBy("subject_id").agg(half_up(F.avg(F.coalesce("pct", F.lit(0)))).alias("pct"), F.count("*").alias("units"))


def session_scores(questions: DataFrame) -> DataFrame:
    """Per session, from its questions with ``correct`` (null: not answered): counts, percent, core counts."""
    core = importance() >= CORE_FROM
    right = F.coalesce("correct", F.lit(False))
    return questions.groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.count("correct").alias("answered"),
        F.count_if(right).alias("correct_count"),
        (F.count("correct") - F.count_if(right)).alias("wrong_count"),
        half_up(F.count_if(right) * 100.0 / F.count("*")).alias("score_percent"),
        F.count_if(core).alias("core_total"),
        F.count_if(core & right).alias("core_correct"),
    )


def wrong_records(answers: DataFrame, target: list[str], order: Column) -> DataFrame:
    """Per target: running counts and the outcome of the last attempt."""
    return answers.where("correct is not null").groupBy(*target).agg(
        F.count_if(~F.col("correct")).alias("wrong_count"), F.count_if("correct").alias("correct_count"), F.max_by("correct", order).alias("last_correct"),
    )
