"""Grades of assessments by rubric, when to review, and what to offer for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.learning import effective_mastery, review_days

#: The weights of a rubric's criteria, the greatest points of each, and what passes.
WEIGHTS = {"accuracy": 30, "coverage": 25, "mechanism": 20, "transfer": 15, "boundaries": 10}
MOST_POINTS, PASS_SCORE, PASS_ACCURACY = 4, 70, 2


def graded(items: DataFrame) -> DataFrame:
    """(attempt_id, score, accuracy, severe, passed) of score items (attempt_id, criterion, points, disabled, severe).

    The score is the weighted share of the points, of 100, over the criteria that aren't disabled, whose weights make up the whole. An
    attempt passes with 70 or more, 2 points of accuracy or more, and no severe error. Without any criterion it has no score and
    doesn't pass. Points are held between 0 and 4; null points count as none.
    """
    weight = F.coalesce(*(F.when(F.col("criterion") == name, w) for name, w in WEIGHTS.items()))
    points = F.greatest(F.lit(0), F.least(F.lit(MOST_POINTS), F.coalesce("points", F.lit(0))))
    live = items.filter(weight.isNotNull()).select("attempt_id", "criterion", points.alias("points"), F.when(F.coalesce("disabled", F.lit(False)), 0).otherwise(weight).alias("weight"), F.coalesce("severe", F.lit(False)).alias("severe"))
    total, gained = F.sum("weight"), F.sum(F.col("weight") * F.col("points"))
    accuracy = F.max(F.when((F.col("criterion") == "accuracy") & (F.col("weight") > 0), F.col("points")))
    sums = live.groupBy("attempt_id").agg(total.alias("total"), gained.alias("gained"), accuracy.alias("accuracy"), F.max("severe").alias("severe"))
    score = F.when(F.col("total") > 0, 100.0 * F.col("gained") / (MOST_POINTS * F.col("total")))
    enough = (F.col("gained") * 100 >= PASS_SCORE * MOST_POINTS * F.col("total")) & (F.col("total") > 0)
    return sums.select("attempt_id", score.alias("score"), "accuracy", "severe", (enough & F.coalesce(F.col("accuracy") >= PASS_ACCURACY, F.lit(True)) & ~F.col("severe")).alias("passed"))


def next_review(at: Column, mastery: Column, first: Column, passed: Column) -> Column:
    """When a point is due again after evidence: in 12 hours after its first success, in 30 minutes after a failure, else by its mastery."""
    seconds = F.when(~passed, 1800).when(first, 43200).otherwise(F.round(review_days(mastery) * 86400)).cast("long")
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def offered(points: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Points that may be reviewed now, in order: user_id, topic_id, point_id, rank, overdue_days, effective.

    points: user_id, topic_id, point_id, next_review_at, defer_until, remedial, failed_at, mastery, half_life, evaluated_at, available. Due ones
    that aren't put off and whose sources are there, by remedial retry, days overdue, low mastery by now, the latest failure, the time they were
    due, and id. most: of each user's topic; a topic's points are what its sources hold.
    """
    days = F.timestamp_diff("SECOND", F.col("evaluated_at"), now) / 86400.0
    due = points.filter(F.col("available") & (F.col("next_review_at") <= now) & (F.col("defer_until").isNull() | (F.col("defer_until") <= now)))
    each = due.withColumn("overdue_days", F.floor(F.timestamp_diff("SECOND", F.col("next_review_at"), now) / 86400)).withColumn("effective", F.round(effective_mastery(F.col("mastery"), days, F.col("half_life")), 6))
    order = Window.partitionBy("user_id", "topic_id").orderBy(F.desc("remedial"), F.desc("overdue_days"), "effective", F.desc_nulls_last("failed_at"), "next_review_at", "point_id")
    ranked = each.withColumn("rank", F.row_number().over(order))
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("user_id", "topic_id", "point_id", "rank", "overdue_days", "effective")
