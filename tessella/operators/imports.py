"""Imports, publishing and purging of sources as one change each of all the tables they touch.

The tables and their keys are KEYS; a `Library` holds them. Each function derives the changed rows from the tables and a batch
of requests or commands, and `Imports` commits them together, made from one version of the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import stable_id
from tessella.sources.library import Library, keep

KEYS = {
    "content_blobs": ["user_id", "content_hash"], "source_documents": ["id"], "source_revisions": ["id"], "ingestion_runs": ["id"], "topic_source_documents": ["topic_id", "source_document_id"],
    "source_import_requests": ["user_id", "request_key"], "outbox_events": ["id"], "chunks": ["id"], "dense": ["id"], "sparse": ["id", "term"], "purged_runs": ["run_id"],
}
SCHEMAS = {
    "content_blobs": "id string, user_id string, content_hash string, storage_path string, byte_size long, created_at timestamp_ntz",
    "source_documents": "id string, user_id string, candidate_id string, title string, state string, active_revision_id string, source_missing boolean, version long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "source_revisions": "id string, user_id string, source_document_id string, content_blob_id string, mime_type string, content_hash string, active_ingestion_run_id string, created_at timestamp_ntz",
    "ingestion_runs": "id string, user_id string, source_document_id string, source_revision_id string, request_key string, status string, checkpoint string, progress int, last_error string, version long, created_at timestamp_ntz, updated_at timestamp_ntz",
    "topic_source_documents": "topic_id string, source_document_id string, created_at timestamp_ntz",
    "source_import_requests": "id string, user_id string, request_key string, request_hash string, source_document_id string, source_revision_id string, ingestion_run_id string, created_at timestamp_ntz",
    "outbox_events": "id string, aggregate_type string, aggregate_id string, event_type string, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, created_at timestamp_ntz, published_at timestamp_ntz",
    "purged_runs": "run_id string, source_document_id string, purged_at timestamp_ntz",
}


def event(run: Column, kind: Column | str, version: Column, at: Column) -> list[Column]:
    """The columns of a pending event of a run; its id follows from the run, what happened, and the run's version then."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None)
    return [
        stable_id(run, kind, version).alias("id"), F.lit("ingestion_run").alias("aggregate_type"), run.alias("aggregate_id"), kind.alias("event_type"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        at.alias("available_at"), none.cast("string").alias("locked_by"), none.cast("timestamp_ntz").alias("locked_until"), at.alias("created_at"), none.cast("timestamp_ntz").alias("published_at"),
    ]


def outcomes(requests: DataFrame, known: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """requests (user_id, request_key, request_hash, candidate_id, seq and more) with outcome and the ids that answer them.

    conflict: the key came earlier with another hash; replay: it came earlier with this one; repeated: the user has
    the candidate from an earlier request; else created. Earlier is in the tables, or of smaller seq in the batch. The first
    of a key and of a candidate are aggregates that tasks combine; a candidate of the tables answers by its first request.
    """
    key, candidate = ["user_id", "request_key"], ["user_id", "candidate_id"]
    ids = ["source_document_id", "source_revision_id", "ingestion_run_id"]
    own = known.select(*key, F.col("request_hash").alias("known_hash"), *(F.col(c).alias(f"k_{c}") for c in ids))
    first = requests.groupBy(*key).agg(F.min(F.struct("seq", "request_hash")).alias("first"))
    asked = requests.join(own, key, "left").join(first, key)
    before = F.coalesce(F.col("known_hash"), F.when(F.col("seq") != F.col("first.seq"), F.col("first.request_hash")))
    asked = asked.withColumn("before", before)
    live = documents.filter("state <> 'purged'").select("user_id", "candidate_id", F.col("id").alias("source_document_id"))
    held = known.join(live, ["user_id", "source_document_id"]).groupBy(*candidate).agg(F.min_by(F.struct(*ids), F.struct("created_at", "request_key")).alias("held"))
    fresh = asked.filter("before is null").join(held, candidate, "left")
    leads = fresh.filter("held is null").groupBy(*candidate).agg(F.min(F.struct("seq", "request_key")).alias("lead"))
    fresh = fresh.join(leads, candidate, "left")
    made = F.struct(*(stable_id(F.col("user_id"), F.col("lead.request_key"), F.lit(c)).alias(c) for c in ids))
    new = fresh.withColumn("outcome", F.when(F.col("held").isNull() & (F.col("seq") == F.col("lead.seq")), "created").otherwise("repeated")).withColumn("ids", F.coalesce("held", made))
    told = F.when(F.col("known_hash").isNotNull() & (F.col("before") == F.col("request_hash")), F.struct(*(F.col(f"k_{c}").alias(c) for c in ids)))
    old = asked.filter("before is not null").withColumn("outcome", F.when(F.col("before") == F.col("request_hash"), "replay").otherwise("conflict")).withColumn("ids", told)
    columns = [*requests.columns, "outcome", "ids"]
    return new.select(columns).union(old.select(columns)).withColumn("at", now)


def imported(judged: DataFrame, blobs: DataFrame) -> dict[str, DataFrame]:
    """The new rows of the seven tables for judged requests (see outcomes); blobs: those there are."""
    made = judged.filter("outcome = 'created'").select("*", "ids.*")
    asked = judged.filter("outcome in ('created', 'repeated')").select("*", "ids.*")
    blob = stable_id(F.col("user_id"), F.col("content_hash"), F.lit("blob"))
    at, none = F.col("at"), F.lit(None).cast("string")
    run = F.col("ingestion_run_id")
    return {
        "content_blobs": made.join(blobs.select("user_id", "content_hash"), ["user_id", "content_hash"], "left_anti").groupBy("user_id", "content_hash").agg(F.min(F.struct("seq", "storage_path", "content_size", "at")).alias("b"))
        .select(blob.alias("id"), "user_id", "content_hash", "b.storage_path", F.col("b.content_size").alias("byte_size"), F.col("b.at").alias("created_at")),
        "source_documents": made.select(F.col("source_document_id").alias("id"), "user_id", "candidate_id", "title", F.lit("active").alias("state"), none.alias("active_revision_id"), F.lit(False).alias("source_missing"), F.lit(1).cast("long").alias("version"), at.alias("created_at"), at.alias("updated_at")),
        "source_revisions": made.select(F.col("source_revision_id").alias("id"), "user_id", "source_document_id", blob.alias("content_blob_id"), "mime_type", "content_hash", none.alias("active_ingestion_run_id"), at.alias("created_at")),
        "ingestion_runs": made.select(run.alias("id"), "user_id", "source_document_id", "source_revision_id", "request_key", F.lit("queued").alias("status"), F.lit("parsing").alias("checkpoint"), F.lit(0).alias("progress"), none.alias("last_error"), F.lit(1).cast("long").alias("version"), at.alias("created_at"), at.alias("updated_at")),
        "topic_source_documents": made.select("topic_id", "source_document_id", at.alias("created_at")),
        "source_import_requests": asked.select(stable_id(F.col("user_id"), F.col("request_key"), F.lit("request")).alias("id"), "user_id", "request_key", "request_hash", "source_document_id", "source_revision_id", "ingestion_run_id", at.alias("created_at")),
        "outbox_events": made.select(*event(run, "ingestion.run.queued", F.lit(1), at)),
    }


def published(commands: DataFrame, tables: dict[str, DataFrame], now: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Outcomes of publish commands (user_id, run_id, expected_version), and the changed rows of the tables.

    The run must be the user's, of that version, and in the stage of publishing. A source that several commands publish
    gets the run of the greatest id.
    """
    runs = tables["ingestion_runs"]
    found = commands.withColumnRenamed("user_id", "asker").join(runs, (F.col("run_id") == runs["id"]) & (F.col("asker") == runs["user_id"]), "left")
    ready = (F.col("status") == "publishing") & (F.col("checkpoint") == "publishing")
    outcome = F.when(F.col("id").isNull(), "not_found").when(F.col("version") != F.col("expected_version"), "conflict").when(ready, "published").otherwise("invalid")
    told = found.withColumn("outcome", outcome)
    done = told.filter("outcome = 'published'").select(*runs.columns).distinct()
    lead = done.groupBy("source_document_id").agg(F.max_by(F.struct(F.col("id").alias("run"), "source_revision_id"), "id").alias("lead"))
    of_revision = lead.select(F.col("lead.source_revision_id").alias("id"), F.col("lead.run").alias("run"))
    of_document = lead.select(F.col("source_document_id").alias("id"), F.col("lead.source_revision_id").alias("revision"))
    revisions, documents = tables["source_revisions"], tables["source_documents"]
    return told.select("asker", "run_id", "outcome"), {
        "source_revisions": revisions.join(of_revision, "id").withColumn("active_ingestion_run_id", F.col("run")).select(revisions.columns),
        "source_documents": documents.join(of_document, "id").withColumn("active_revision_id", F.col("revision")).withColumn("updated_at", now).withColumn("version", F.col("version") + 1).select(documents.columns),
        "ingestion_runs": done.withColumn("status", F.lit("published")).withColumn("progress", F.lit(100)).withColumn("version", F.col("version") + 1).withColumn("updated_at", now).select(runs.columns),
        "outbox_events": done.select(*event(F.col("id"), "ingestion.run.published", F.col("version") + 1, now)),
    }


def purged(claims: DataFrame, tables: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The changed rows for purge claims (user_id, source_document_id, job_type), and the runs (run_id) whose chunks and index rows go.

    A due purge takes a trashed source, an asked one a purging source; any other state, purged before all, changes nothing, so
    that a claim that comes again after a crash does no harm. Runs go into the log of purged runs.
    """
    documents, runs = tables["source_documents"], tables["ingestion_runs"]
    wanted = claims.select("user_id", F.col("source_document_id").alias("id"), F.when(F.col("job_type") == "source.purge_due", "trashed").otherwise("purging").alias("state")).distinct()
    hit = documents.join(wanted, ["user_id", "id", "state"], "left_semi")
    gone = runs.join(hit.select("user_id", F.col("id").alias("source_document_id")), ["user_id", "source_document_id"], "left_semi").select(F.col("id").alias("run_id"), "source_document_id")
    after = hit.withColumn("state", F.lit("purged")).withColumn("active_revision_id", F.lit(None).cast("string")).withColumn("source_missing", F.lit(True)).withColumn("updated_at", now).withColumn("version", F.col("version") + 1)
    return {"source_documents": after.select(documents.columns), "purged_runs": gone.withColumn("purged_at", now)}, gone.select("run_id")


def compensated(results: DataFrame, tables: dict[str, DataFrame], now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The changed rows for clean-ups that ended (run_id, succeeded), and the runs (run_id) whose chunks and index rows go.

    A run that is compensating becomes failed if an error led there, else cancelled, and compensation_failed if the clean-up
    didn't succeed (then nothing of it goes). Runs in any other state are left alone, and so a second result changes nothing.
    """
    runs = tables["ingestion_runs"]
    ended = runs.join(results.groupBy(F.col("run_id").alias("id")).agg(F.max("succeeded").alias("succeeded")), "id").filter("status = 'compensating'")
    status = F.when(~F.col("succeeded"), "compensation_failed").when(F.col("last_error").isNotNull(), "failed").otherwise("cancelled")
    after = ended.withColumn("status", status).withColumn("version", F.col("version") + 1).withColumn("updated_at", now)
    events = after.select(*event(F.col("id"), F.concat(F.lit("ingestion.run."), F.col("status")), F.col("version"), now))
    return {"ingestion_runs": after.select(runs.columns), "outbox_events": events}, ended.filter("succeeded").select(F.col("id").alias("run_id"))


#: Tables whose rows belong to a run, and go with it.
OF_RUNS = ("chunks", "dense", "sparse")


def parse_inputs(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What parsing a run (id) needs: run_id, storage_path, mime_type, title, from its revision, that one's blob, and the source."""
    r = runs.select(F.col("id").alias("run_id"), "user_id", F.col("source_revision_id").alias("revision"))
    v = tables["source_revisions"].select(F.col("id").alias("revision"), "user_id", "content_blob_id", "mime_type", "source_document_id")
    b = tables["content_blobs"].select(F.col("id").alias("content_blob_id"), "storage_path")
    d = tables["source_documents"].select(F.col("id").alias("source_document_id"), "title")
    return r.join(v, ["revision", "user_id"]).join(b, "content_blob_id").join(d, "source_document_id").select("run_id", "storage_path", "mime_type", "title")


def first_imports(tables: dict[str, DataFrame]) -> DataFrame:
    """The request that first imported each source: source_document_id, candidate_id, request_key, request_hash, run_id, status."""
    q = tables["source_import_requests"].select("source_document_id", "request_key", "request_hash", F.col("ingestion_run_id").alias("run_id"), "created_at")
    first = q.groupBy("source_document_id").agg(F.min(F.struct("created_at", "request_key", "request_hash", "run_id")).alias("q")).select("source_document_id", "q.*")
    d = tables["source_documents"].select(F.col("id").alias("source_document_id"), "candidate_id")
    return first.join(d, "source_document_id").join(tables["ingestion_runs"].select(F.col("id").alias("run_id"), "status"), "run_id").select("source_document_id", "candidate_id", "request_key", "request_hash", "run_id", "status")


class Imports:
    """A library of sources, changed by whole batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.library = spark, Library(spark, root, KEYS)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        found = {t: self.library.read(t, version) for t in SCHEMAS}
        return {t: self.spark.createDataFrame([], SCHEMAS[t]) if df is None else df for t, df in found.items()}

    def import_batch(self, requests: DataFrame, now: Column) -> int:
        version = self.library.version()
        t = self.tables(version)
        # seven tables are written from what is judged, and judging looks at the requests several times: each is made once
        judged = keep(outcomes(keep(requests), t["source_import_requests"], t["source_documents"], now))
        return self.library.commit(imported(judged, t["content_blobs"]), expected=version)

    def publish(self, commands: DataFrame, now: Column) -> int:
        version = self.library.version()
        return self.library.commit(published(commands, self.tables(version), now)[1], expected=version)

    def purge(self, claims: DataFrame, now: Column) -> int:
        version = self.library.version()
        rows, runs = purged(claims, self.tables(version), now)
        return self._without(runs, rows, version)

    def compensate(self, results: DataFrame, now: Column) -> int:
        version = self.library.version()
        rows, runs = compensated(results, self.tables(version), now)
        return self._without(runs, rows, version)

    def _without(self, runs: DataFrame, rows: dict[str, DataFrame], version: int) -> int:
        held, runs = [t for t in OF_RUNS if self.library.read(t, version) is not None], keep(runs)
        return self.library.commit(rows, {t: (runs, ["run_id"]) for t in held}, expected=version)
