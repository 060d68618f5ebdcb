"""Transactions over several tables: what readers see, what a crash leaves, and who wins."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import imports as I
from tessella.operators import outbox as X
from tessella.sources.library import CommitConflict, Library, workspace


def day(d):
    return F.lit(f"2024-05-0{d} 00:00:00").cast("timestamp_ntz")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def library(spark):
    return Library(spark, workspace(spark), {"a": ["k"], "b": ["k", "run_id"]})


def frame(spark, *values):
    return spark.createDataFrame(list(values), "k int, run_id string, v string")


def test_newest_rows_and_deletions_after_them_count(spark, library):
    assert library.read("a") is None and library.version() == 0
    assert library.commit({"a": frame(spark, (1, "r", "x"), (2, "s", "y")), "b": frame(spark, (1, "r", "p"))}) == 1
    library.commit({"a": frame(spark, (2, "s", "z"), (3, "r", "w"))}, {"b": (frame(spark, (9, "r", None)), ["run_id"])})
    assert rows(library.read("a")) == [(1, "r", "x"), (2, "s", "z"), (3, "r", "w")] and rows(library.read("b")) == []
    library.commit({"b": frame(spark, (1, "r", "again"))}, {"a": (frame(spark, (0, "r", None)), ["run_id"])})
    assert rows(library.read("a")) == [(2, "s", "z")] and rows(library.read("b")) == [(1, "r", "again")]
    before = library.version()
    library.compact("a")
    assert rows(library.read("a")) == [(2, "s", "z")] and rows(library.read("a", 1)) == [(1, "r", "x"), (2, "s", "y")] and library.version() == before + 1


def test_a_write_that_fails_leaves_the_version_before_it(spark, library):
    library.commit({"a": frame(spark, (1, "r", "x"))})
    broken = frame(spark, (1, "r", "new")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        library.commit({"a": frame(spark, (1, "r", "half"), (2, "r", "half")), "b": broken})
    assert library.version() == 1 and rows(library.read("a")) == [(1, "r", "x")] and library.read("b") is None
    assert library.commit({"b": frame(spark, (1, "r", "p"))}) == 2


def test_of_two_writers_from_one_version_one_is_told(spark, library):
    library.commit({"a": frame(spark, (1, "r", "x"))})
    at = library.version()
    library.commit({"a": frame(spark, (1, "r", "first"))}, expected=at)
    with pytest.raises(CommitConflict):
        library.commit({"a": frame(spark, (1, "r", "second"))}, expected=at)
    with pytest.raises(CommitConflict):
        library._publish({}, library.version())  # a manifest's number can't be taken twice
    assert rows(library.read("a")) == [(1, "r", "first")]


REQUEST = "user_id string, request_key string, request_hash string, candidate_id string, topic_id string, title string, content_hash string, content_size long, mime_type string, storage_path string, seq long"


def request(seq, user, key, h, candidate, content=None):
    return user, key, h, candidate, "t", "title", content or candidate, 1, "text/plain", "p", seq


def test_import_outcomes_in_batches(spark):
    library = I.Imports(spark, workspace(spark))
    library.import_batch(spark.createDataFrame([request(1, "u", "k1", "h1", "A"), request(2, "u", "k2", "h2", "A"), request(3, "u", "k1", "h1", "A"), request(4, "v", "k1", "h1", "A", "C")], REQUEST), day(1))
    t = library.tables()
    assert {n: t[n].count() for n in I.SCHEMAS} == {"content_blobs": 2, "source_documents": 2, "source_revisions": 2, "ingestion_runs": 2, "topic_source_documents": 2, "source_import_requests": 3, "outbox_events": 2, "purged_runs": 0}
    batch = spark.createDataFrame([request(5, "u", "k1", "h1", "A"), request(6, "u", "k1", "other", "B"), request(7, "u", "k3", "h3", "A"), request(8, "u", "k4", "h4", "D", "A"), request(9, "u", "k5", "h5", "D")], REQUEST)
    judged = {r.seq: (r.outcome, r.ids and r.ids.source_document_id) for r in I.outcomes(batch, t["source_import_requests"], t["source_documents"], day(2)).collect()}
    source = {(r.user_id, r.request_key): r.source_document_id for r in t["source_import_requests"].collect()}
    assert source["u", "k1"] == source["u", "k2"] != source["v", "k1"]
    assert judged[5] == ("replay", source["u", "k1"]) and judged[6] == ("conflict", None) and judged[7] == ("repeated", source["u", "k1"])
    assert judged[8][0] == "created" and judged[9] == ("repeated", judged[8][1])
    library.import_batch(batch, day(2))
    t = library.tables()
    assert {n: t[n].count() for n in ("content_blobs", "source_documents", "source_import_requests")} == {"content_blobs": 2, "source_documents": 3, "source_import_requests": 6}


def test_publish_needs_the_stage_the_owner_and_the_version(spark):
    library = I.Imports(spark, workspace(spark))
    library.import_batch(spark.createDataFrame([request(k, "u", f"k{k}", "h", f"c{k}") for k in range(4)], REQUEST), day(1))
    runs = library.tables()["ingestion_runs"]
    ready = runs.filter("request_key <> 'k3'").withColumn("status", F.lit("publishing")).withColumn("checkpoint", F.lit("publishing"))
    library.library.commit({"ingestion_runs": ready})
    run = {r.request_key: r.id for r in runs.collect()}
    commands = spark.createDataFrame([("u", run["k0"], 1), ("u", run["k1"], 2), ("v", run["k2"], 1), ("u", run["k3"], 1), ("u", "none", 1)], "user_id string, run_id string, expected_version long")
    told = {r.run_id: r.outcome for r in I.published(commands, library.tables(), day(2))[0].collect()}
    assert told == {run["k0"]: "published", run["k1"]: "conflict", run["k2"]: "not_found", run["k3"]: "invalid", "none": "not_found"}
    library.publish(commands, day(2))
    t = library.tables()
    assert [(r.status, r.progress, r.version) for r in t["ingestion_runs"].filter("status = 'published'").collect()] == [("published", 100, 2)]
    assert t["source_documents"].filter("active_revision_id is not null").count() == t["source_revisions"].filter("active_ingestion_run_id is not null").count() == 1
    assert t["outbox_events"].filter("event_type = 'ingestion.run.published'").count() == 1
    library.publish(commands, day(2))
    assert library.tables()["outbox_events"].count() == 5


def test_purges_and_clean_ups_can_be_repeated(spark):
    library = I.Imports(spark, workspace(spark))
    library.import_batch(spark.createDataFrame([request(k, "u", f"k{k}", "h", f"c{k}") for k in range(5)], REQUEST), day(1))
    t = library.tables()
    runs = {r.request_key: r for r in t["ingestion_runs"].collect()}
    chunk = spark.createDataFrame([(f"c{k}", runs[f"k{k}"].id, "text") for k in range(5)], "id string, run_id string, text string")
    state = {runs["k0"].source_document_id: "trashed", runs["k1"].source_document_id: "purging"}
    states = spark.createDataFrame(list(state.items()), "id string, s string")
    changed = t["ingestion_runs"].filter(F.col("request_key").isin("k2", "k3", "k4")).withColumn("status", F.lit("compensating")).withColumn("last_error", F.when(F.col("request_key") == "k2", "broken"))
    library.library.commit({"chunks": chunk, "ingestion_runs": changed, "source_documents": t["source_documents"].join(states, "id").withColumn("state", F.col("s")).drop("s")})
    claims = spark.createDataFrame([("u", runs["k0"].source_document_id, "source.purge_due"), ("u", runs["k1"].source_document_id, "source.purge_due"), ("w", runs["k1"].source_document_id, "source.purge"), ("u", runs["k2"].source_document_id, "source.purge")], "user_id string, source_document_id string, job_type string")
    results = spark.createDataFrame([(runs["k2"].id, True), (runs["k3"].id, True), (runs["k4"].id, False), (runs["k1"].id, True)], "run_id string, succeeded boolean")
    for _ in range(2):
        library.purge(claims, day(2))
        library.compensate(results, day(2))
        t = library.tables()
        assert {r.id for r in t["source_documents"].filter("state = 'purged' and source_missing and version = 2").collect()} == {runs["k0"].source_document_id}
        assert {r.run_id for r in t["purged_runs"].collect()} == {runs["k0"].id}
        assert {r.request_key: (r.status, r.version) for r in t["ingestion_runs"].collect()} == {"k0": ("queued", 1), "k1": ("queued", 1), "k2": ("failed", 2), "k3": ("cancelled", 2), "k4": ("compensation_failed", 2)}
        assert {r.id for r in library.library.read("chunks").collect()} == {"c1", "c4"}
        assert t["outbox_events"].count() == 5 + 3


EVENT = "id string, aggregate_type string, aggregate_id string, event_type string, status string, attempts int, available_at timestamp_ntz, locked_by string, locked_until timestamp_ntz, created_at timestamp_ntz, published_at timestamp_ntz"


def test_outbox_leases(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 5, 1, 0, m)
    e = spark.createDataFrame([("a", "t", "1", "x", "pending", 0, at(0), None, None, at(2), None), ("b", "t", "1", "x", "publishing", 1, at(0), "p", at(1), at(1), None), ("c", "t", "2", "x", "publishing", 1, at(0), "p", at(9), at(0), None), ("d", "t", "2", "x", "pending", 0, at(9), None, None, at(0), None)], EVENT)
    now = F.lit(at(5)).cast("timestamp_ntz")
    got = X.claim(e, F.lit("q"), now, 5).collect()
    assert [(r.id, r.attempts, r.locked_by) for r in got] == [("b", 2, "q"), ("a", 1, "q")]
    after = {r.id: r for r in X.settled(e, F.lit("p"), now, F.col("id") != "c").collect()}
    assert not after["b"].accepted and after["b"].status == "publishing"  # its lease had run out
    assert after["c"].accepted and after["c"].status == "pending" and after["c"].available_at == at(5) + dt.timedelta(seconds=30) and after["c"].locked_by is None
    done = {r.id: r.status for r in X.published_of(e, e.filter("aggregate_id = '2'"), now).collect()}
    assert done == {"a": "pending", "b": "publishing", "c": "published", "d": "published"}


def test_events_are_delivered_once(spark):
    path = f"{workspace(spark)}/sink"
    e = spark.range(20).select(F.concat(F.lit("e"), "id").alias("id"), (F.lit("2024-05-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("created_at"))
    assert X.delivered(spark, path) is None
    X.deliver(e.limit(12).union(e.limit(3)), 0, path)
    X.deliver(e.filter("id in ('e3', 'e15', 'e16')"), 1, path)
    X.deliver(e.limit(12), 0, path)  # the first batch again
    assert sorted(r.id for r in X.delivered(spark, path).collect()) == sorted([*(f"e{k}" for k in range(12)), "e15", "e16"])
    X.deliver(e.limit(0), 2, path)
    assert X.delivered(spark, path).count() == 14


def test_runs_are_replaced_in_all_tables_at_once(spark, library):
    library.replace_runs({"a": frame(spark, (1, "r", "x"), (2, "s", "y")), "b": frame(spark, (1, "r", "x"), (2, "s", "y"))})
    library.replace_runs({"a": frame(spark, (3, "r", "z")), "b": frame(spark, (4, "r", "w"))})
    assert rows(library.read("a")) == [(2, "s", "y"), (3, "r", "z")] and rows(library.read("b")) == [(2, "s", "y"), (4, "r", "w")]
    broken = frame(spark, (5, "s", "half")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        library.replace_runs({"a": frame(spark, (5, "s", "half")), "b": broken})
    assert rows(library.read("a")) == [(2, "s", "y"), (3, "r", "z")]
    with pytest.raises(ValueError, match="unsafe"):
        library.replace_runs({"a": frame(spark, (6, "../r", "x"))})
    library.replace_runs({"a": frame(spark, (0, "r", "x")).limit(0)}, frame(spark, (0, "s", "x")).select("run_id"))
    assert rows(library.read("a")) == [(3, "r", "z")]
