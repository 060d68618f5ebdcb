"""Column functions for spaced review: mastery that fades, and when to ask again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least mastery, and factors of the half-life after a success or a failure by difficulty.
FLOOR = 0.05
SUCCESS, FAILURE = {"easy": 1.2, "medium": 1.6, "hard": 2.0}, {"easy": 0.9, "medium": 0.6, "hard": 0.5}


def effective_mastery(mastery: Column, days: Column, half_life: Column) -> Column:
    return FLOOR + (mastery - FLOOR) * F.pow(F.lit(2.0), -days / half_life)


def next_half_life(half_life: Column, success: Column, difficulty: Column) -> Column:
    def factor(table: dict[str, float]) -> Column:
        return F.coalesce(*[F.when(difficulty == name, x) for name, x in table.items()])

    return F.greatest(F.lit(0.5), F.least(F.lit(180.0), half_life * F.when(success, factor(SUCCESS)).otherwise(factor(FAILURE))))


def review_days(mastery: Column) -> Column:
    """Days until the next review."""
    return F.greatest(F.lit(0.5), F.least(F.lit(60.0), 7 * F.log(mastery / 0.4) / F.log(F.lit(2.0))))


def learning_day(at: Column) -> Column:
    """The day an event counts for: days turn at four in the morning."""
    return F.to_date(at - F.expr("INTERVAL 4 HOURS"))
