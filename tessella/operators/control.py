"""State transitions of sources, runs and jobs as joins with their transition tables, and keyed-table updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import stable_id

#: The run stages with what follows each.
STAGES = [("parsing", "extracting", "running", 20), ("extracting", "chunking", "running", 40), ("chunking", "embedding", "running", 60), ("embedding", "validating", "validating", 80), ("validating", "publishing", "publishing", 90)]
#: Lifecycle commands, the states they start from and end in.
LIFECYCLE = [("archive", "active", "archived"), ("restore", "archived", "active"), ("restore", "trashed", "active"), ("trash", "active", "trashed"), ("trash", "archived", "trashed"), ("purge", "trashed", "purging")]


def lifecycle(commands: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome and new state of commands (source_id, command, expected_version) on sources (source_id, state, version)."""
    table = commands.sparkSession.createDataFrame(LIFECYCLE, "command string, state string, next string")
    found = commands.join(sources, "source_id", "left").join(F.broadcast(table), ["command", "state"], "left")
    outcome = F.when(F.col("version").isNull(), "not_found").when(F.col("version") != F.col("expected_version"), "conflict").when(F.col("next").isNull(), "invalid").otherwise("applied")
    done = outcome == "applied"
    return found.select("source_id", "command", outcome.alias("outcome"), F.when(done, F.col("next")).otherwise(F.col("state")).alias("state"), (F.col("version") + F.when(done, 1).otherwise(0)).alias("version"))


def advance(runs: DataFrame) -> DataFrame:
    """Runs (run_id, checkpoint, version) one stage on: status, checkpoint, progress, version."""
    table = runs.sparkSession.createDataFrame(STAGES, "checkpoint string, next string, status string, progress int")
    return runs.join(F.broadcast(table), "checkpoint").select("run_id", F.col("next").alias("checkpoint"), "status", "progress", (F.col("version") + 1).alias("version"))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that may be claimed: queued and due, or running with a lost lease and attempts left."""
    due = (F.col("status") == "queued") & (F.col("available_at") <= now)
    lost = (F.col("status") == "running") & (F.col("leased_until") < now) & (F.col("attempts") < F.col("max_attempts"))
    return jobs.filter(due | lost)


def claim(jobs: DataFrame, now: Column, n: int = 1, lease_seconds: int = 120) -> DataFrame:
    """The next n jobs by priority, then age, leased."""
    lease = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds).cast("decimal(18,6)"))
    return claimable(jobs, now).orderBy(F.desc("priority"), "created_at", "job_id").limit(n).withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("leased_until", lease)


def fail(jobs: DataFrame, now: Column, retry_seconds: int = 30) -> DataFrame:
    """Failed jobs: queued again after a delay, or failed for good when no attempts are left."""
    over = F.col("attempts") >= F.col("max_attempts")
    later = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(retry_seconds).cast("decimal(18,6)"))
    return jobs.withColumn("available_at", F.when(over, F.col("available_at")).otherwise(later)).withColumn("status", F.when(over, "failed").otherwise("queued"))


def reserve(requests: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Outcome of each request (key, hash, at, seq[, done_at]) by its key's record, which its first request makes.

    created: it is the first one; conflict: it asks for something else; in_progress: the first one isn't done by then
    (if there is a done_at); replay: it is answered as the first one was. A record that has outlived its time counts until it is
    cleared away (see expired_records); with ttl_days, expired says whether the record of a request that didn't make it had by then.
    A key's first request is an aggregate that tasks combine before the shuffle; the join splits hot keys.
    """
    known = "done_at" in requests.columns
    head = F.min(F.struct("at", "seq", "hash", *(["done_at"] if known else []))).alias("first")
    out = requests.join(requests.groupBy("key").agg(head), "key")
    pending = (F.col("first.done_at").isNull() | (F.col("first.done_at") > F.col("at"))) if known else F.lit(False)
    outcome = F.when(F.col("seq") == F.col("first.seq"), "created").when(F.col("hash") != F.col("first.hash"), "conflict").when(pending, "in_progress").otherwise("replay")
    out = out.withColumn("outcome", outcome)
    if ttl_days is not None:
        late = F.col("first.at") + F.make_dt_interval(F.lit(ttl_days)) <= F.col("at")
        out = out.withColumn("expired", (F.col("outcome") != "created") & late)
    return out.drop("first")


def expired_records(records: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """Records (at) that may be cleared away: made ttl_days or more before now."""
    return records.filter(F.col("at") + F.make_dt_interval(F.lit(ttl_days)) <= now)


def active_scope(links: DataFrame, documents: DataFrame, revisions: DataFrame, runs: DataFrame) -> DataFrame:
    """(topic_id, user_id, run_id, versions) of sources that may be searched: active, no duplicate, not missing, published."""
    d = documents.filter("state = 'active' and duplicate_of is null and not source_missing")
    chain = links.join(d, "source_id").join(revisions, d["active_revision_id"] == revisions["revision_id"]).drop(revisions["source_id"])
    r = runs.filter("status = 'published'").withColumnRenamed("user_id", "run_user")
    return chain.join(r, chain["active_run_id"] == r["run_id"]).filter("user_id = run_user").select("topic_id", "user_id", "run_id", "chunking_version", "sparse_version", "dense_version")


def mixed_versions(scope: DataFrame) -> DataFrame:
    """Topics whose active runs were indexed under different versions: they can't be searched."""
    return scope.groupBy("user_id", "topic_id").agg(F.count_distinct(F.struct("chunking_version", "sparse_version", "dense_version")).alias("versions")).filter("versions > 1")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new; new rows win."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_run(index: DataFrame, new: DataFrame, run: str = "run_id") -> DataFrame:
    """The index without the runs of new, and new."""
    return index.join(new.select(run).distinct(), run, "left_anti").unionByName(new)


def canonical(sources: DataFrame) -> DataFrame:
    """The canonical source of each (user_id, topic_id, url): active first, then the oldest, then the smallest id."""
    key = ["user_id", "topic_id", "url"]
    first = F.min_by("source_id", F.struct(F.when(F.col("state") == "active", 0).otherwise(1), "created_at", "source_id"))
    return sources.join(sources.groupBy(*key).agg(first.alias("canonical_id")), key).withColumn("duplicate", F.col("canonical_id") != F.col("source_id"))


#: The states of a run that is under way; what a command on a run needs (status, checkpoint; null: any) and makes of it.
UNDER_WAY = ("queued", "running", "validating", "publishing")
RUN_COMMANDS = [
    ("publish", "publishing", "publishing", "published", 100), *(("cancel", s, None, "cancel_requested", None) for s in UNDER_WAY), *(("fail", s, None, "compensating", None) for s in UNDER_WAY),
    ("compensate", "cancel_requested", None, "compensating", None), ("finish_cancel", "compensating", None, "cancelled", None), ("fail_cancel", "compensating", None, "compensation_failed", None),
]


def transition(commands: DataFrame, runs: DataFrame) -> DataFrame:
    """Compare-and-set of commands (command_id, run_id, command, expected_version) on runs (run_id, status, checkpoint, progress, version, last_error).

    fail sends a run that is under way to its clean-up, with the command's error (if commands have one); a clean-up that ends
    makes it failed if there was an error, else cancelled.
    """
    table = commands.sparkSession.createDataFrame(RUN_COMMANDS, "command string, status string, needs string, next string, done int")
    given = F.col("error") if "error" in commands.columns else F.lit("error")
    found = commands.withColumn("_error", given).join(runs, "run_id", "left").join(F.broadcast(table), ["command", "status"], "left")
    fits = F.col("next").isNotNull() & (F.col("needs").isNull() | (F.col("needs") == F.col("checkpoint")))
    outcome = F.when(F.col("version").isNull(), "not_found").when(F.col("version") != F.col("expected_version"), "conflict").when(fits, "applied").otherwise("invalid")
    done = F.col("outcome") == "applied"
    status = F.when((F.col("command") == "finish_cancel") & F.col("last_error").isNotNull(), "failed").otherwise(F.col("next"))
    return found.withColumn("outcome", outcome).select(
        "command_id", "run_id", "command", "outcome", F.when(done, status).otherwise(F.col("status")).alias("status"), F.when(done, F.coalesce("done", "progress")).otherwise(F.col("progress")).alias("progress"),
        (F.col("version") + F.when(done, 1).otherwise(0)).alias("version"), F.when(done & (F.col("command") == "fail"), F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def retry(commands: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcomes of retries (run_id, request_key) of runs (run_id, status and what they were made from), and the new runs' columns.

    Only a run that ended without a result may be tried again: as a new, queued run from the same revision, whose id
    follows from the old one's and the key, so that each key makes one run of its own.
    """
    found = commands.select("run_id", F.col("request_key").alias("new_key")).distinct().join(runs, "run_id", "left")
    ended = F.col("status").isin("failed", "cancelled", "compensation_failed")
    outcome = F.when(F.col("status").isNull(), "not_found").when(ended, "created").otherwise("not_allowed")
    made = lambda value: F.when(F.col("outcome") == "created", value)
    return found.withColumn("outcome", outcome).select(
        F.col("run_id").alias("retry_of"), F.col("new_key").alias("request_key"), "outcome", made(stable_id(F.col("run_id"), F.col("new_key"), F.lit("retry"))).alias("run_id"), made(F.lit("queued")).alias("status"),
        made(F.lit("parsing")).alias("checkpoint"), made(F.lit(1).cast("long")).alias("version"),
    )


#: The states in which a run waits for a worker.
WAITING = (*UNDER_WAY, "cancel_requested", "compensating")


def next_run(runs: DataFrame, n: int = 1) -> DataFrame:
    """The n runs (status, created_at, run_id) that a worker takes next: the oldest under way or to be cleaned up."""
    return runs.filter(F.col("status").isin(*WAITING)).orderBy("created_at", "run_id").limit(n)


def listed_topics(topics: DataFrame) -> DataFrame:
    """Topics (archived, created_at, topic_id) that aren't archived, oldest first."""
    return topics.filter("not archived").orderBy("created_at", "topic_id")


def unlinked(links: DataFrame, topics: DataFrame) -> DataFrame:
    """Links (topic_id, source_id) left after topics are removed: links alone go, never sources."""
    return links.join(topics.select("topic_id").distinct(), "topic_id", "left_anti")


def topic_changes(commands: DataFrame, topics: DataFrame) -> DataFrame:
    """Outcomes of commands (command_id, topic_id, user_id, command, expected_version, name) on topics (topic_id, user_id, name, archived, version), and what becomes of the topics.

    create makes a topic that isn't there, without a version to expect; update renames one, and archive archives it, if it is the
    user's, not archived yet and of that version. Commands on one topic are judged each against the topic as it is.
    """
    own = topics.select("topic_id", F.col("user_id").alias("owner"), F.col("name").alias("was"), "archived", "version")
    found = commands.withColumn("name", F.nullif(F.btrim("name"), F.lit(""))).join(own, "topic_id", "left")
    missing = F.col("owner").isNull()
    outcome = (
        F.when((F.col("command") != "archive") & F.col("name").isNull(), "invalid").when(F.col("command") == "create", F.when(missing, "created").otherwise("exists"))
        .when(missing | (F.col("owner") != F.col("user_id")), "not_found").when(F.col("version") != F.col("expected_version"), "conflict").when(F.col("archived"), "archived").otherwise("applied")
    )
    done = F.col("outcome").isin("created", "applied")
    return found.withColumn("outcome", outcome).select(
        "command_id", "topic_id", "command", "outcome", F.when(done & (F.col("command") != "archive"), F.col("name")).otherwise(F.col("was")).alias("name"),
        F.when(F.col("outcome") == "created", False).otherwise(F.col("archived") | (done & (F.col("command") == "archive"))).alias("archived"), F.when(F.col("outcome") == "created", 1).otherwise(F.col("version") + F.when(done, 1).otherwise(0)).cast("long").alias("version"),
    )


def hold(jobs: DataFrame, worker: Column, now: Column, action: str, lease_seconds: int = 120) -> DataFrame:
    """Jobs (status, worker_id, leased_until) after their worker renews, releases or completes them; accepted says whether it might.

    Only the owner of an unexpired lease may.
    """
    accepted = (F.col("status") == "running") & (F.col("worker_id") == worker) & (F.col("leased_until") >= now)
    status = {"renew": "running", "release": "queued", "complete": "completed"}[action]
    lease = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds).cast("decimal(18,6)")) if action == "renew" else F.lit(None).cast("timestamp_ntz")
    marked = jobs.withColumn("accepted", F.coalesce(accepted, F.lit(False)))
    own = F.col("accepted")
    out = marked.withColumn("leased_until", F.when(own, lease).otherwise(F.col("leased_until"))).withColumn("status", F.when(own, status).otherwise(F.col("status")))
    return out if action == "renew" else out.withColumn("worker_id", F.when(~own, F.col("worker_id")))


def purge_due(sources: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Trashed sources (state, trashed_at) whose time is over, as purging."""
    return sources.filter((F.col("state") == "trashed") & (F.timestamp_diff("DAY", F.col("trashed_at"), now) >= days)).withColumn("state", F.lit("purging"))


def cancel_runs_of(trashed: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs (source_id, status, version): those of trashed sources that are under way are to be cancelled."""
    gone = trashed.select("source_id").distinct().withColumn("_gone", F.lit(True))
    found = runs.join(gone, "source_id", "left")
    hit = F.col("_gone").isNotNull() & F.col("status").isin(*UNDER_WAY)
    return found.withColumn("version", F.col("version") + F.when(hit, 1).otherwise(0)).withColumn("status", F.when(hit, "cancel_requested").otherwise(F.col("status"))).drop("_gone")


def import_outcomes(requests: DataFrame) -> DataFrame:
    """Outcome of import requests (request_key, request_hash, user_id, content_hash, url, at, seq).

    The first request of a key imports, unless the user has the content or the URL from an earlier request: then it
    repeats that one. Later ones with the key replay it, or conflict if they ask for something else.
    """
    own = requests.groupBy("request_key").agg(F.min(F.struct("at", "seq", "request_hash")).alias("first"))
    firsts = requests.join(own, "request_key").filter(F.col("seq") == F.col("first.seq"))
    by_content = firsts.groupBy("user_id", "content_hash").agg(F.min(F.struct("at", "seq")).alias("c"))
    by_url = firsts.filter("url is not null").groupBy("user_id", "url").agg(F.min(F.struct("at", "seq")).alias("u"))
    known = requests.join(own, "request_key").join(by_content, ["user_id", "content_hash"], "left").join(by_url, ["user_id", "url"], "left")
    earlier = F.least(F.col("c"), F.coalesce("u", "c"))
    outcome = (
        F.when((F.col("seq") != F.col("first.seq")) & (F.col("request_hash") != F.col("first.request_hash")), "conflict").when(F.col("seq") != F.col("first.seq"), "replay")
        .when(earlier["seq"] < F.col("seq"), "repeated").otherwise("created")
    )
    return known.select("seq", "request_key", outcome.alias("outcome"))


def rebuild_run(index: DataFrame, chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """The dense index (id, run_id, vector) with one run's vectors replaced, once they are known to fit its chunks (id, run_id)."""
    both = chunks.select("id", "run_id", F.lit(1).alias("c")).join(vectors.select("id", "vector"), "id", "full_outer")
    bad = both.agg(
        F.count(F.when(F.col("c").isNull() | F.col("vector").isNull(), 1)).alias("unmatched"), F.count(F.when(F.size("vector") != dimension, 1)).alias("misfit"),
        F.count_distinct("run_id").alias("runs"), (F.count("id") - F.count_distinct("id")).alias("repeated"),
    ).first()
    if bad["unmatched"] or bad["misfit"] or bad["repeated"] or bad["runs"] > 1:
        raise ValueError(f"vectors don't fit the run's chunks: {bad.asDict()}")
    return replace_run(index, both.select("id", "run_id", "vector"))


def resolve_sessions(requests: DataFrame, sessions: DataFrame, users: DataFrame, hours: int = 12) -> DataFrame:
    """Who asks: (request_id, user_id, outcome, expires_at) of requests (request_id, token, at).

    sessions: token_hash, user_id, expires_at, revoked_at; users: user_id, active. A session is found by its token's hash, must not be
    revoked or expired by then, and its user must be active; it is then good for `hours` more.
    """
    found = requests.withColumn("token_hash", F.sha2("token", 256)).join(sessions, "token_hash", "left").join(users, "user_id", "left")
    outcome = F.when(F.col("expires_at").isNull(), "not_found").when(F.col("revoked_at") <= F.col("at"), "revoked").when(F.col("expires_at") <= F.col("at"), "expired").when(~F.coalesce("active", F.lit(False)), "inactive").otherwise("ok")
    ok = F.col("outcome") == "ok"
    later = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(hours))
    return found.withColumn("outcome", outcome).select("request_id", F.when(ok, F.col("user_id")).alias("user_id"), "outcome", F.when(ok, F.greatest("expires_at", later)).otherwise(F.col("expires_at")).alias("expires_at"))


def cancel_due_purges(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """jobs (job_type, status, payload as JSON) with the waiting purges of sources (user_id, source_id) that were restored or purged cancelled."""
    asked = jobs.withColumn("_u", F.get_json_object("payload", "$.user_id")).withColumn("_s", F.get_json_object("payload", "$.source_document_id"))
    gone = sources.select(F.col("user_id").alias("_u"), F.col("source_id").alias("_s")).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("_hit").isNotNull() & (F.col("job_type") == "source.purge_due") & (F.col("status") == "queued")
    return asked.join(gone, ["_u", "_s"], "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).select(jobs.columns)
