"""The outbox: an append-only log of events that publishers claim, deliver once and mark.

events: id, aggregate_type, aggregate_id, event_type, status (pending, publishing, published), attempts, available_at,
locked_by, locked_until, created_at, published_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.streaming.jobs import worker


def _later(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def claimable(events: DataFrame, now: Column) -> DataFrame:
    """Pending events that are due, and those whose publisher's lease has run out."""
    due = (F.col("status") == "pending") & (F.col("available_at") <= now)
    lost = (F.col("status") == "publishing") & (F.col("locked_until") < now)
    return events.filter(due | lost)


def claim(events: DataFrame, publisher: Column, now: Column, n: int = 1, lease_seconds: int = 60) -> DataFrame:
    """The n oldest claimable events (of one time the smaller id first), leased to the publisher."""
    first = claimable(events, now).orderBy("created_at", "id").limit(n)
    return first.withColumn("status", F.lit("publishing")).withColumn("attempts", F.col("attempts") + 1).withColumn("locked_by", publisher).withColumn("locked_until", _later(now, lease_seconds))


def settled(events: DataFrame, publisher: Column, now: Column, delivered: Column, retry_seconds: int = 30) -> DataFrame:
    """The publisher's events after delivery: published, or pending again after a delay; accepted says whether its lease still held.

    delivered: whether an event was. Events of a lease that ran out or of another publisher stay as they are.
    """
    held = F.coalesce((F.col("status") == "publishing") & (F.col("locked_by") == publisher) & (F.col("locked_until") >= now), F.lit(False))
    out, mine = events.withColumn("accepted", held), F.col("accepted")
    return (
        out.withColumn("available_at", F.when(mine & ~delivered, _later(now, retry_seconds)).otherwise(F.col("available_at"))).withColumn("published_at", F.when(mine & delivered, now).otherwise(F.col("published_at")))
        .withColumn("status", F.when(mine, F.when(delivered, "published").otherwise("pending")).otherwise(F.col("status")))
        .withColumn("locked_by", F.when(~mine, F.col("locked_by"))).withColumn("locked_until", F.when(~mine, F.col("locked_until")))
    )


def published_of(events: DataFrame, aggregates: DataFrame, now: Column) -> DataFrame:
    """events with all open ones of the aggregates (aggregate_type, aggregate_id) published."""
    marked = events.join(aggregates.select("aggregate_type", "aggregate_id").distinct().withColumn("_done", F.lit(True)), ["aggregate_type", "aggregate_id"], "left")
    hit = F.col("_done").isNotNull() & F.col("status").isin("pending", "publishing")
    marked = marked.withColumn("_hit", hit)
    for name in ("locked_by", "locked_until"):
        marked = marked.withColumn(name, F.when(~F.col("_hit"), F.col(name)))
    return marked.withColumn("published_at", F.when(F.col("_hit"), now).otherwise(F.col("published_at"))).withColumn("status", F.when(F.col("_hit"), "published").otherwise(F.col("status"))).select(events.columns)


def delivered(spark: SparkSession, path: str) -> DataFrame | None:
    """What was delivered, with the batch that did (batch_id); null before the first delivery."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # no delivery yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return None


def deliver(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch of events under path, each event once.

    A batch that comes again replaces what it wrote, and events that other batches delivered are left out, so
    that neither a batch tried twice nor an event appended twice is delivered twice. Only deliveries of the
    batch's times are read to find those.
    """
    spark = batch.sparkSession
    new, known = batch.dropDuplicates(["id"]), delivered(spark, path)
    if known is not None:
        since = batch.agg(F.min("created_at").alias("since")).first()["since"]
        others = known.filter(F.col("batch_id") != batch_id)
        if since is not None:
            others = others.filter(F.col("created_at") >= F.lit(since))
        new = new.join(others.select("id"), "id", "left_anti").select(batch.columns)
    new.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def deliveries(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Deliver a stream of appended events."""
    return worker(stream, lambda batch, batch_id: deliver(batch, batch_id, path), checkpoint, once)
