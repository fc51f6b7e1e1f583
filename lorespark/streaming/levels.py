"""Learning levels from a stream of answers: the batch fold, one answer after the other, kept per target."""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "level double, correct int, wrong int, streak int"


def next_state(state: tuple, correct: bool, weight: float = 1.0) -> tuple:
    """(level, correct, wrong, streak) after one more answer; the same steps as the batch fold's expression."""
    level, right, wrong, streak = state
    if correct:
        streak += 1
        level = level + (100.0 - level) * (0.25 + 0.05 * min(streak, 4)) * weight
    else:
        streak = 0
        level = level * (1.0 - 0.4 * weight)
    return floor(min(max(level, 0.0), 100.0) * 10 + 0.5) / 10.0, right + correct, wrong + (not correct), streak


def stream_levels(answers: DataFrame, target: str = "target_id", at: str = "ts", tie: str = "event_id", correct: str = "correct", late: str = "1 hour") -> DataFrame:
    """A streaming table of each target's level after every micro-batch that has answers for it (output mode update).

    Answers that come again with the same tie key within the watermark are dropped. In a micro-batch they count in
    order of time; a later micro-batch continues where the one before stopped.
    """
    kind = dict(answers.dtypes)[target]
    fresh = answers.where(f"{correct} is not null").withWatermark(at, late).dropDuplicatesWithinWatermark([tie])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else (0.0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values([at, tie])
        for ok in rows[correct].tolist():
            current = next_state(current, bool(ok))
        state.update(current)
        yield pd.DataFrame([(key[0], *current)], columns=[target, "level", "correct", "wrong", "streak"])

    columns = fresh.select(target, at, tie, correct)
    return columns.groupBy(target).applyInPandasWithState(fold, f"{target} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
