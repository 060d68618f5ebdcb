"""Registered queries on a library of sources: imports, publishing, purges and compensation as transactions, and the outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import imports as I
from tessella.operators import outbox as X
from tessella.plans.queries import table
from tessella.sources.library import workspace

AT = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"]


def _at(k: int) -> Column:
    return F.lit(AT[k]).cast("timestamp_ntz")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a request to import it."""
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 7 != 0, "user-1").otherwise("user-2").alias("user_id"), F.concat(F.lit("k"), "doc_id").alias("request_key"), h.alias("request_hash"), h.alias("candidate_id"), F.col("source").alias("topic_id"),
        F.substring("text", 1, 40).alias("title"), h.alias("content_hash"), F.octet_length("text").cast("long").alias("content_size"), F.lit("text/plain").alias("mime_type"), F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(".txt")).alias("storage_path"),
        F.col("doc_id").alias("seq"),
    )


def digests(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """How many rows each table has, and a sum of their hashes over some columns, modulo 2^63: sums of more than some 65,000 rows pass 64 bits."""
    out = None
    for name, names in columns.items():
        row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
        each = F.conv(F.substring(F.sha2(row, 256), 1, 12), 16, 10).cast("long")
        total = F.pmod(F.coalesce(F.sum(each.cast("decimal(28,0)")), F.lit(0)), F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")
        one = tables[name].agg(F.count(F.lit(1)).alias("n"), total.alias("digest")).select(F.lit(name).alias("table"), "n", "digest")
        out = one if out is None else out.union(one)
    return out


COLUMNS = {
    "content_blobs": ["id", "user_id", "content_hash", "byte_size"], "source_documents": ["id", "candidate_id", "state", "active_revision_id", "version"], "source_revisions": ["id", "content_blob_id", "active_ingestion_run_id"],
    "ingestion_runs": ["id", "status", "progress", "version"], "topic_source_documents": ["topic_id", "source_document_id"], "source_import_requests": ["id", "request_hash", "source_document_id"], "outbox_events": ["id", "event_type", "aggregate_id"],
}


def _library(spark: SparkSession, sf_dir: str) -> I.Imports:
    """All documents imported in two batches: even ones, then odd ones with requests that came before, some changed."""
    library, r = I.Imports(spark, workspace(spark)), _requests(spark, sf_dir)
    library.import_batch(r.filter("seq % 2 = 0"), _at(0))
    again = r.filter("seq % 10 in (4, 6)").withColumn("request_hash", F.when(F.col("seq") % 10 == 6, "changed").otherwise(F.col("request_hash"))).withColumn("seq", F.col("seq") + 10**12)
    library.import_batch(r.filter("seq % 2 = 1").union(again), _at(1))
    return library


def _number(runs: DataFrame) -> Column:
    return F.substring(runs["request_key"], 2, 20).cast("long")


def import_transaction(spark, sf_dir):
    """The seven tables after two batches of imports and one of publishing, of which some come too late."""
    library = _library(spark, sf_dir)
    runs = library.tables()["ingestion_runs"]
    due = runs.filter(_number(runs) % 3 == 0)
    library.library.commit({"ingestion_runs": due.withColumn("status", F.lit("publishing")).withColumn("checkpoint", F.lit("publishing")).withColumn("progress", F.lit(90)).withColumn("version", F.lit(6).cast("long"))})
    library.publish(due.select("user_id", F.col("id").alias("run_id"), F.when(_number(runs) % 9 == 0, 5).otherwise(6).cast("long").alias("expected_version")), _at(2))
    return digests(library.tables(), COLUMNS)


def _indexed(spark: SparkSession, sf_dir: str) -> I.Imports:
    """The library with chunks, vectors and postings of its runs."""
    library = _library(spark, sf_dir)
    runs = library.tables()["ingestion_runs"]
    numbered = runs.select(F.col("id").alias("run_id"), _number(runs).alias("n"))
    docs = table(spark, sf_dir, "documents").join(numbered, F.col("doc_id") == F.col("n"))
    vectors = table(spark, sf_dir, "embeddings").join(numbered, F.col("vec_id") == F.col("n"))
    chunk = F.concat(F.lit("c"), "n")
    library.library.commit({
        "chunks": docs.select(chunk.alias("id"), "run_id", "text"), "dense": vectors.select(chunk.alias("id"), "run_id", F.col("embedding").alias("vector")),
        "sparse": docs.select(chunk.alias("id"), "run_id", F.explode(F.array_distinct(F.array("lang", "source"))).alias("term")),
    })
    return library


def _held(library: I.Imports) -> DataFrame:
    """What the run-keyed tables and the states of sources and runs hold."""
    held = {t: library.library.read(t) for t in I.OF_RUNS}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit("").alias("state"), "n") for t, df in held.items()]
    t = library.tables()
    states = [t["source_documents"].groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source_documents").alias("table"), "state", "n"), t["ingestion_runs"].groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ingestion_runs"), "status", "n"), t["purged_runs"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("purged_runs"), F.lit(""), "n")]
    out = states[0]
    for one in [*states[1:], *counts]:
        out = out.union(one)
    return out


def source_purge(spark, sf_dir):
    """What is left after sources are purged, the same claims once more, and the chunks written anew without what is gone."""
    library = _indexed(spark, sf_dir)
    t = library.tables()
    runs, documents = t["ingestion_runs"], t["source_documents"]
    of = runs.select(F.col("source_document_id").alias("id"), "user_id", _number(runs).alias("n"))
    marked = documents.join(of.select("id", "n"), "id").withColumn("state", F.when(F.col("n") % 5 == 0, "trashed").when(F.col("n") % 5 == 1, "purging").otherwise("active"))
    library.library.commit({"source_documents": marked.select(documents.columns)})
    claims = of.filter("n % 5 < 2").select("user_id", F.col("id").alias("source_document_id"), F.when(F.col("n") % 10 == 1, "source.purge").otherwise("source.purge_due").alias("job_type"))
    library.purge(claims, _at(2))
    library.purge(claims, _at(2))
    library.library.compact("chunks")
    return _held(library)


def run_compensation(spark, sf_dir):
    """What is left after clean-ups of runs that were cancelled or failed."""
    library = _indexed(spark, sf_dir)
    runs = library.tables()["ingestion_runs"]
    n = _number(runs)
    changed = runs.withColumn("status", F.when(n % 4 == 0, "compensating").otherwise(F.col("status"))).withColumn("last_error", F.when(n % 8 == 0, "broken"))
    library.library.commit({"ingestion_runs": changed})
    results = runs.select(F.col("id").alias("run_id"), (n % 3 > 0).alias("succeeded"))
    library.compensate(results, _at(2))
    library.compensate(results, _at(2))
    return _held(library)


def import_lookups(spark, sf_dir):
    """What parsing each run needs, and the request that first imported its source."""
    t = _library(spark, sf_dir).tables()
    inputs, firsts = I.parse_inputs(t["ingestion_runs"], t), I.first_imports(t)
    return inputs.join(firsts, "run_id").select("run_id", "storage_path", "mime_type", "title", "source_document_id", "request_key", "status")


def index_swap(spark, sf_dir):
    """What an index of three tables holds after two runs were replaced in all of them at once, one of them by nothing in one table."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("id"), F.concat(F.lit("run-"), "label").alias("run_id"), "vec_id", "embedding")
    library = I.Library(spark, workspace(spark), I.KEYS)
    of = lambda df, n: {"chunks": df.select("id", "run_id", "vec_id"), "dense": df.select("id", "run_id", F.transform("embedding", lambda x: x * n).alias("vector")), "sparse": df.select("id", "run_id", F.lit("term").alias("term"), F.lit(n).alias("tf"))}
    library.replace_runs(of(v, 1))
    new = of(v.filter("run_id in ('run-2', 'run-5') and vec_id % 2 = 0"), 2)
    library.replace_runs({**new, "sparse": new["sparse"].filter("run_id = 'run-2'")}, v.filter("run_id in ('run-2', 'run-5')").select("run_id"))
    chunks, dense, sparse = (library.read(t) for t in I.OF_RUNS)
    letters = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 4096))
    sums = chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")).join(dense.groupBy("run_id").agg(F.sum(letters).alias("total")), "run_id", "left")
    return sums.join(sparse.groupBy("run_id").agg(F.sum("tf").alias("tf")), "run_id", "left")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as an outbox: clicks and views wait, errors are with one of three publishers, others are out."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("click", "view"), "pending").when(F.col("event_type") == "error", "publishing").otherwise("published")
    held = status == "publishing"
    return e.select(
        F.col("event_id").alias("id"), F.lit("user").alias("aggregate_type"), F.col("user_id").alias("aggregate_id"), "event_type", status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").alias("available_at"),
        F.when(held, F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"))).alias("locked_by"), F.when(held, F.timestamp_add("DAY", F.col("event_id") % 40, F.col("ts"))).alias("locked_until"), F.col("ts").alias("created_at"),
        F.when(status == "published", F.col("ts")).alias("published_at"),
    )


OUTBOX_NOW = "2024-01-20 00:00:00"


def _outbox_now() -> Column:
    return F.lit(OUTBOX_NOW).cast("timestamp_ntz")


def outbox_claim(spark, sf_dir):
    """The hundred oldest events that may be published."""
    return X.claim(_events(spark, sf_dir), F.lit("p9"), _outbox_now(), 100).select("id", "status", F.col("attempts").cast("long").alias("attempts"), "locked_by", "locked_until")


def outbox_settle(spark, sf_dir):
    """The outbox after one publisher delivered some of its events and failed on others."""
    after = X.settled(_events(spark, sf_dir), F.lit("p1"), _outbox_now(), F.col("id") % 4 > 0)
    return after.select("id", "status", "accepted", "available_at", "locked_by", "published_at")


def outbox_aggregates(spark, sf_dir):
    """The outbox after all events of some users are marked as published."""
    e = _events(spark, sf_dir)
    users = e.filter("aggregate_id % 5 = 0").select("aggregate_type", "aggregate_id")
    return X.published_of(e, users, _outbox_now()).select("id", "status", "locked_by", "published_at")


def outbox_delivery(spark, sf_dir):
    """What a stream of events delivered, after its first batch came again and a batch held events anew."""
    folder = workspace(spark)
    e = _events(spark, sf_dir)
    raw = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"))
    X.deliveries(stream, f"{folder}/sink", f"{folder}/checkpoint").awaitTermination()
    X.deliver(e.select("id", "event_type", "created_at"), 0, f"{folder}/sink")
    X.deliver(e.filter("id % 3 = 0").select("id", "event_type", "created_at"), 7, f"{folder}/sink")
    out = X.delivered(spark, f"{folder}/sink")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


QUERIES = {f.__name__: f for f in (import_lookups, index_swap, import_transaction, source_purge, run_compensation, outbox_claim, outbox_settle, outbox_aggregates, outbox_delivery)}

_US = "chr(31)"
#: d: each document with its batch's outcome; lead: the document whose request made its source.
_IMPORTED = f"""d0 AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 'user-1' ELSE 'user-2' END AS u, source, lang, text, sha256(text) AS h FROM documents),
d1 AS (SELECT *, first_value(doc_id) OVER (PARTITION BY u, h ORDER BY doc_id % 2, doc_id) AS lead FROM d0),
d AS (SELECT *, sha256(u || {_US} || 'k' || lead || {_US} || 'source_document_id') AS src, sha256(u || {_US} || 'k' || lead || {_US} || 'source_revision_id') AS rev, sha256(u || {_US} || 'k' || lead || {_US} || 'ingestion_run_id') AS run, sha256(u || {_US} || h || {_US} || 'blob') AS blob FROM d1),
m AS (SELECT *, doc_id % 3 = 0 AS due, doc_id % 3 = 0 AND doc_id % 9 <> 0 AS pub FROM d WHERE doc_id = lead)"""


def _digest(name: str, row: str, source: str) -> str:
    return f"SELECT '{name}' AS \"table\", count(*) AS n, CAST(coalesce(sum(CAST('0x' || sha256(concat_ws('|', {row}))[1:12] AS BIGINT)), 0) AS BIGINT) AS digest FROM {source}"


_TABLES = [
    ("content_blobs", "blob, u, h, strlen(text)", "m"), ("source_documents", "src, h, 'active', CASE WHEN pub THEN rev ELSE '' END, CASE WHEN pub THEN 2 ELSE 1 END", "m"), ("source_revisions", "rev, blob, CASE WHEN pub THEN run ELSE '' END", "m"),
    ("ingestion_runs", "run, CASE WHEN pub THEN 'published' WHEN due THEN 'publishing' ELSE 'queued' END, CASE WHEN pub THEN 100 WHEN due THEN 90 ELSE 0 END, CASE WHEN pub THEN 7 WHEN due THEN 6 ELSE 1 END", "m"),
    ("topic_source_documents", "source, src", "m"), ("source_import_requests", f"sha256(u || {_US} || 'k' || doc_id || {_US} || 'request'), h, src", "d"),
    ("outbox_events", f"sha256(run || {_US} || kind || {_US} || v), kind, run", "(SELECT run, 'ingestion.run.queued' AS kind, 1 AS v FROM m UNION ALL SELECT run, 'ingestion.run.published', 7 FROM m WHERE pub)"),
]


def _left(state: str, status: str, gone: str, log: str) -> str:
    stays = f"(SELECT * FROM m WHERE NOT ({gone}))"
    return f"""WITH {_IMPORTED} SELECT 'source_documents' AS "table", {state} AS state, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'ingestion_runs', {status}, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'purged_runs', '', count(*) FROM m WHERE {log}
UNION ALL SELECT 'chunks', '', count(*) FROM {stays} UNION ALL SELECT 'dense', '', count(*) FROM {stays} JOIN embeddings ON vec_id = doc_id UNION ALL SELECT 'sparse', '', CAST(coalesce(sum(CASE WHEN lang = source THEN 1 ELSE 2 END), 0) AS BIGINT) FROM {stays}"""


_PURGED = "doc_id % 5 = 0 OR doc_id % 10 = 1"
_CLEANED = "doc_id % 4 = 0 AND doc_id % 3 > 0"
ORACLES = {
    "index_swap": """WITH v AS (SELECT *, label IN (2, 5) AS new FROM embeddings WHERE label NOT IN (2, 5) OR vec_id % 2 = 0)
SELECT 'run-' || label AS run_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(list_sum([CAST(floor(CAST(x AS DOUBLE) * CASE WHEN new THEN 8192 ELSE 4096 END) AS BIGINT) FOR x IN embedding])) AS BIGINT) AS total, CAST(CASE label WHEN 5 THEN NULL WHEN 2 THEN 2 * count(*) ELSE count(*) END AS BIGINT) AS tf FROM v GROUP BY label""",
    "import_lookups": f"WITH {_IMPORTED} SELECT run AS run_id, h[1:2] || '/' || h || '.txt' AS storage_path, 'text/plain' AS mime_type, text[1:40] AS title, src AS source_document_id, first_value('k' || doc_id) OVER (PARTITION BY u, h ORDER BY doc_id % 2, 'k' || doc_id) AS request_key, 'queued' AS status FROM d QUALIFY doc_id = lead",
    "import_transaction": f"WITH {_IMPORTED} " + " UNION ALL ".join(_digest(*t) for t in _TABLES),
    "source_purge": _left(f"CASE WHEN {_PURGED} THEN 'purged' WHEN doc_id % 5 = 1 THEN 'purging' ELSE 'active' END", "'queued'", _PURGED, _PURGED),
    "run_compensation": _left("'active'", "CASE WHEN doc_id % 4 > 0 THEN 'queued' WHEN doc_id % 3 = 0 THEN 'compensation_failed' WHEN doc_id % 8 = 0 THEN 'failed' ELSE 'cancelled' END", _CLEANED, "false"),
    "outbox_claim": f"SELECT event_id AS id, 'publishing' AS status, event_id % 4 + 1 AS attempts, 'p9' AS locked_by, TIMESTAMP '{OUTBOX_NOW}' + INTERVAL 60 SECONDS AS locked_until FROM events WHERE (event_type IN ('click', 'view') AND ts <= TIMESTAMP '{OUTBOX_NOW}') OR (event_type = 'error' AND ts + to_days(CAST(event_id % 40 AS INTEGER)) < TIMESTAMP '{OUTBOX_NOW}') ORDER BY ts, event_id LIMIT 100",
    "outbox_settle": f"""SELECT event_id AS id, CASE WHEN ok AND event_id % 4 > 0 THEN 'published' WHEN ok THEN 'pending' WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type = 'error' THEN 'publishing' ELSE 'published' END AS status, ok AS accepted,
  CASE WHEN ok AND event_id % 4 = 0 THEN TIMESTAMP '{OUTBOX_NOW}' + INTERVAL 30 SECONDS ELSE ts END AS available_at, CASE WHEN event_type = 'error' AND NOT ok THEN 'p' || event_id % 3 END AS locked_by,
  CASE WHEN ok AND event_id % 4 > 0 THEN TIMESTAMP '{OUTBOX_NOW}' WHEN event_type NOT IN ('click', 'view', 'error') THEN ts END AS published_at
FROM (SELECT *, event_type = 'error' AND event_id % 3 = 1 AND ts + to_days(CAST(event_id % 40 AS INTEGER)) >= TIMESTAMP '{OUTBOX_NOW}' AS ok FROM events)""",
    "outbox_aggregates": f"""SELECT event_id AS id, CASE WHEN user_id % 5 = 0 OR event_type NOT IN ('click', 'view', 'error') THEN 'published' WHEN event_type = 'error' THEN 'publishing' ELSE 'pending' END AS status,
  CASE WHEN event_type = 'error' AND user_id % 5 <> 0 THEN 'p' || event_id % 3 END AS locked_by, CASE WHEN event_type NOT IN ('click', 'view', 'error') THEN ts WHEN user_id % 5 = 0 THEN TIMESTAMP '{OUTBOX_NOW}' END AS published_at FROM events""",
    "outbox_delivery": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
}
