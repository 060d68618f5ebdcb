"""Mastery of knowledge points from ordered evidence, corrections by replay, and streaks of learning days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.learning import FAILURE, FLOOR, SUCCESS

#: Mastery at first, what is learnt at each evidence, the greatest mastery, the half-life in days that the first
#: success sets and its bounds, and the chances to guess and to slip by mode.
FIRST, LEARN, MOST = 0.20, 0.10, 0.98
HALF_LIFE, SHORTEST, LONGEST = 7.0, 0.5, 180.0
GUESS, SLIP = {"easy": 0.40, "medium": 0.20, "hard": 0.08}, {"easy": 0.35, "medium": 0.15, "hard": 0.10}


def updated(mastery: float, passed: bool, mode: str) -> float:
    """Mastery after an evidence, by Bayes' rule and a step of learning."""
    slip, guess = SLIP[mode], GUESS[mode]
    right, wrong = (1 - slip, guess) if passed else (slip, 1 - guess)
    known = mastery * right / (mastery * right + (1 - mastery) * wrong)
    return min(MOST, max(FLOOR, known + (1 - known) * LEARN))


class State:
    """What a fold over a point's evidence carries."""

    def __init__(self):
        self.mastery, self.half_life, self.at, self.passed, self.n = FIRST, HALF_LIFE, None, False, 0

    def take(self, at: float, passed: bool, mode: str) -> None:
        """at: in days. Mastery fades since the last evidence before it is updated."""
        prior = self.mastery
        if self.at is not None:
            prior = FLOOR + (prior - FLOOR) * 2.0 ** (-max(0.0, at - self.at) / self.half_life)
        self.mastery = updated(prior, passed, mode)
        if passed and not self.passed:
            self.half_life, self.passed = HALF_LIFE, True
        elif self.passed:
            self.half_life = min(LONGEST, max(SHORTEST, self.half_life * (SUCCESS if passed else FAILURE)[mode]))
        self.at, self.n = at, self.n + 1


def projected(events: DataFrame) -> DataFrame:
    """(user_id, point_id, mastery, half_life, evaluated_at, n) from events (user_id, point_id, at, event_id, mode, passed).

    Evidence is taken in order of time, then event_id. Events without mode or outcome, and of unknown modes, are no evidence. A
    point's half-life is seven days until its first success and from there on changes with each evidence. Points meet in one
    task each, sorted, which carries five numbers and never a list of events; a user's points are dealt apart.
    """
    kinds = dict(events.select("user_id", "point_id").dtypes)
    schema = f"user_id {kinds['user_id']}, point_id {kinds['point_id']}, mastery double, half_life double, at long, n long"
    types = [events.select("user_id", "point_id").limit(0).toArrow().schema.field(k).type for k in range(2)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, state, last = None, State(), 0
        for batch in batches:
            out = []
            for user, name, at, mode, passed in zip(*(c.to_pylist() for c in batch.columns)):
                if (user, name) != point:
                    if state.n:
                        out.append((*point, state.mastery, state.half_life, last, state.n))
                    point, state = (user, name), State()
                state.take(at / 86_400_000_000, passed, mode)
                last = at
            yield rows(out)
        yield rows([(*point, state.mastery, state.half_life, last, state.n)] if state.n else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.float64(), pa.float64(), pa.int64(), pa.int64()])], ["user_id", "point_id", "mastery", "half_life", "at", "n"])

    evidence = events.filter(F.col("mode").isin(*GUESS) & F.col("passed").isNotNull() & F.col("at").isNotNull())
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    ordered = evidence.repartition("user_id", "point_id").sortWithinPartitions("user_id", "point_id", "at", "event_id").select("user_id", "point_id", micros.alias("at"), "mode", "passed")
    found = ordered.mapInArrow(fold, schema)
    return found.select("user_id", "point_id", "mastery", "half_life", F.timestamp_micros("at").cast(events.schema["at"].dataType).alias("evaluated_at"), "n")


def without_replaced(events: DataFrame) -> DataFrame:
    """events (event_id, replaces and more) without those that some other event replaces; a correction's own outcome is evidence at its own time."""
    gone = events.filter("replaces is not null and replaces <> event_id").select(F.col("replaces").alias("event_id")).distinct()
    return events.join(gone, "event_id", "left_anti")


def learning_day(at: Column, zone: Column) -> Column:
    """The day that a time (UTC, without zone) counts for where its user is: days turn at four in the morning, by the zone's own rules."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), zone, at) - F.expr("INTERVAL 4 HOURS"))


def streaks(days: DataFrame, today: Column) -> DataFrame:
    """(user_id, n_days, longest, current) of learning days (user_id, day).

    A streak is a run of consecutive days; the current one ends today or yesterday, and is 0 if there is none. Repeated days count once,
    and so what meets for a user is a row a day.
    """
    distinct = days.filter("day is not null").select("user_id", "day").distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("day"))
    islands = distinct.withColumn("island", F.date_sub("day", place)).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"))
    live = F.when((F.col("last") >= F.date_sub(today, 1)) & (F.col("last") <= today), F.col("n")).otherwise(0)
    return islands.groupBy("user_id").agg(F.sum("n").alias("n_days"), F.max("n").alias("longest"), F.max(live).cast("long").alias("current"))
