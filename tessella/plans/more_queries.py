"""Further registered queries: imports, runs, leases, purges, hydration, quality, and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import learning as L
from tessella.functions import text as T
from tessella.operators import control as K
from tessella.operators import retrieval as R
from tessella.plans.queries import _now, _sparse, blocks_of_pages, sources, table
from tessella.sources import parsers as P


def html_titles(spark, sf_dir):
    return blocks_of_pages(spark, sf_dir).select("run_id", "title").distinct()


def html_block_texts(spark, sf_dir):
    b = blocks_of_pages(spark, sf_dir).filter("block_no is not null")
    return b.select("run_id", F.col("block_no").cast("long").alias("block_no"), "kind", F.sha2("text", 256).alias("text_hash"), F.size("title_path").cast("long").alias("depth"))


def _runs(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("queued", "running", "validating", "publishing", "published", "cancel_requested", "compensating", "failed", "cancelled")])
    d = table(spark, sf_dir, "documents")
    status = F.get(names, (F.col("doc_id") % 9).cast("int"))
    return d.select(
        F.col("doc_id").cast("string").alias("run_id"), F.col("doc_id").cast("string").alias("source_id"), status.alias("status"), F.when(F.col("doc_id") % 2 == 0, "publishing").otherwise("embedding").alias("checkpoint"),
        (F.col("doc_id") % 100).cast("int").alias("progress"), (F.col("doc_id") % 3).alias("version"), F.concat(F.lit("key-"), "doc_id").alias("request_key"),
        F.when(F.col("doc_id") % 5 < 2, "broken").alias("last_error"),
    )


def cas_classify(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("publish", "cancel", "compensate", "finish_cancel", "fail_cancel", "fail")])
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("command_id"), F.col("event_id").cast("string").alias("run_id"), F.get(names, (F.floor("value") % 6).cast("int")).alias("command"), (F.col("event_id") % 3 + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("expected_version"))
    return K.transition(e, _runs(spark, sf_dir)).select("command_id", "command", "outcome", "status", F.col("progress").cast("long").alias("progress"), "version", "last_error")


def run_retry(spark, sf_dir):
    """Retries of all runs, some of them twice, under two keys."""
    runs = _runs(spark, sf_dir)
    again = runs.select("run_id", F.concat(F.lit("again-"), "run_id").alias("request_key"))
    more = again.filter("cast(run_id as long) % 2 = 0").withColumn("request_key", F.concat("request_key", F.lit("-b")))
    lost = again.filter("cast(run_id as long) % 10 = 0").withColumn("run_id", F.concat(F.lit("x"), "run_id"))
    return K.retry(again.union(more).union(lost), runs)


def next_run(spark, sf_dir):
    """The run that a worker takes: the oldest under way."""
    return K.next_run(_runs(spark, sf_dir).withColumn("created_at", F.col("run_id").cast("long") % 11)).select("run_id", "status", "created_at")


def trash_cancels_runs(spark, sf_dir):
    trashed = table(spark, sf_dir, "documents").filter("doc_id % 4 = 1").select(F.col("doc_id").cast("string").alias("source_id"))
    return K.cancel_runs_of(trashed, _runs(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


def _leased(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "running").otherwise("queued")
    return e.select(F.col("event_id").alias("job_id"), status.alias("status"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("worker_id"), F.col("ts").alias("leased_until"))


def lease_renew(spark, sf_dir):
    return K.hold(_leased(spark, sf_dir), F.lit("w1"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "renew").select("job_id", "status", "accepted", "leased_until")


def lease_complete(spark, sf_dir):
    return K.hold(_leased(spark, sf_dir), F.lit("w2"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), "complete").select("job_id", "status", "accepted", "worker_id")


def request_reservations(spark, sf_dir):
    """Requests with records that are done some hours after, if at all, and outlive their time after seven days."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), (F.col("event_id") % 4).cast("string").alias("hash"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 > 0, F.timestamp_add("HOUR", F.col("event_id") % 100, F.col("ts"))).alias("done_at"),
    )
    return K.reserve(e, 7).select(F.col("seq").alias("event_id"), "outcome", "expired")


def import_outcomes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("k"), (F.col("doc_id") - F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)).cast("string"))
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("u"), F.floor(F.col("doc_id") / 8).cast("string")))
    r = d.select(key.alias("request_key"), F.sha2("text", 256).alias("request_hash"), F.lit("user-1").alias("user_id"), F.sha2("text", 256).alias("content_hash"), url.alias("url"), F.col("doc_id").alias("at"), F.col("doc_id").alias("seq"))
    return K.import_outcomes(r).withColumnRenamed("seq", "doc_id")


def purge_due(spark, sf_dir):
    s = sources(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "trashed").otherwise(F.col("state")).alias("state"), F.timestamp_add("DAY", F.col("doc_id") % 60, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("trashed_at"))
    return K.purge_due(s, _now()).select("doc_id", "state", "trashed_at")


def topic_listing(spark, sf_dir):
    """Topics that aren't archived, oldest first, with their place."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("created_at"), F.count(F.lit(1)).alias("n_sources"))
    return K.listed_topics(d.withColumn("archived", F.col("created_at") % 3 == 1).withColumnRenamed("source", "topic_id")).select("topic_id", "created_at", "n_sources")


def topic_unlink(spark, sf_dir):
    """Links left after topics are removed: links only, never sources."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic_id"))
    gone = d.groupBy("topic_id").agg(F.min("doc_id").alias("first")).filter("first % 3 = 1").select("topic_id")
    return K.unlinked(d, gone).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_links"))


def topic_changes(spark, sf_dir):
    """Commands on topics, which are pages here."""
    p = table(spark, sf_dir, "pages")
    topics = p.filter("page_id % 3 > 0").select("page_id", F.col("page_id").alias("topic_id"), F.concat(F.lit("u"), F.col("page_id") % 4).alias("user_id"), F.col("url").alias("name"), (F.col("page_id") % 5 == 0).alias("archived"), (F.col("page_id") % 2).alias("version")).drop("page_id")
    e = table(spark, sf_dir, "events")
    command = F.get(F.array(*map(F.lit, ("create", "update", "archive"))), (F.floor("value") % 3).cast("int"))
    commands = e.select(F.col("event_id").alias("command_id"), (F.col("event_id") % 400).alias("topic_id"), F.concat(F.lit("u"), F.when(F.col("event_id") % 11 == 0, 9).otherwise(F.col("event_id") % 400 % 4)).alias("user_id"), command.alias("command"), (F.col("user_id") % 2).alias("expected_version"), F.when(F.col("event_id") % 13 == 0, "  ").otherwise(F.concat(F.lit(" n"), "event_type")).alias("name"))
    return K.topic_changes(commands, topics)


def session_users(spark, sf_dir):
    """Events as requests under sessions of their users, some of them revoked, expired or of users who left."""
    e = table(spark, sf_dir, "events")
    token = F.concat(F.lit("t"), F.col("user_id") % 40)
    users = e.select(F.col("user_id")).distinct().select("user_id", (F.col("user_id") % 6 > 0).alias("active"))
    start = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    one = users.filter("user_id < 30").select(F.sha2(F.concat(F.lit("t"), "user_id"), 256).alias("token_hash"), "user_id", F.timestamp_add("DAY", F.col("user_id") % 20, start).alias("expires_at"), F.when(F.col("user_id") % 4 == 1, F.timestamp_add("DAY", F.col("user_id") % 9, start)).alias("revoked_at"))
    return K.resolve_sessions(e.select(F.col("event_id").alias("request_id"), token.alias("token"), F.col("ts").alias("at")), one, users)


def purges_cancelled(spark, sf_dir):
    """Purge jobs of documents after some of those were restored."""
    d = table(spark, sf_dir, "documents")
    user = F.when(F.col("doc_id") % 7 != 0, "user-1").otherwise("user-2")
    jobs = d.select(F.col("doc_id").alias("job_id"), F.when(F.col("doc_id") % 3 == 0, "source.purge").otherwise("source.purge_due").alias("job_type"), F.when(F.col("doc_id") % 5 == 0, "running").otherwise("queued").alias("status"), F.to_json(F.struct(user.alias("user_id"), F.col("doc_id").cast("string").alias("source_document_id"))).alias("payload"))
    restored = d.filter("doc_id % 2 = 0").select(F.lit("user-1").alias("user_id"), F.col("doc_id").cast("string").alias("source_id"))
    return K.cancel_due_purges(jobs, restored).select("job_id", "job_type", "status")


def redirect_targets(spark, sf_dir):
    """Where redirects from pages lead, and times as they are told and read."""
    p = table(spark, sf_dir, "pages")
    reference = F.get(F.array(F.lit("/a/b"), F.lit("?q=1"), F.lit("https://other.org/x")), (F.col("page_id") % 3).cast("int"))
    at = F.timestamp_add("MINUTE", F.col("page_id") * 7919, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    told = F.concat(F.substring(T.iso_text(at), 1, 19), F.when(F.col("page_id") % 2 == 0, "Z").otherwise("+05:30"))
    return p.select("page_id", T.joined_url(F.regexp_replace("url", "[?#].*$", ""), reference).alias("target"), T.iso_text(at).alias("told"), T.iso_time(told).alias("read"))


def _fused(spark, sf_dir, by_rank=False):
    d = table(spark, sf_dir, "documents")
    hits = lambda order: d.select(F.concat(F.lit("c"), "doc_id").alias("id"), "doc_id", "n_chars").orderBy(*order).limit(20)
    from pyspark.sql import Window

    ranked = lambda order: hits(order).select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("id"), F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string")).alias("parent_chunk_id"))
    return R.fuse(ranked([F.desc("n_chars"), F.col("doc_id")]), ranked([F.desc(F.col("n_chars") % 1000), F.col("doc_id")]), chunks, parent_limit=10, by_rank=by_rank)


def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select(F.col("rank").cast("long").alias("rank"), "parent_chunk_id", F.round("score", 9).alias("score"), F.size("evidence").cast("long").alias("n_evidence"))


def rrf_fusion_by_rank(spark, sf_dir):
    """The same with ties broken by the better rank in either channel."""
    return _fused(spark, sf_dir, True).select(F.col("rank").cast("long").alias("rank"), "parent_chunk_id", F.round("score", 9).alias("score"))


def hydrated_parents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    parents = d.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string")).alias("id"), F.concat(F.lit("run-"), "doc_id").alias("run_id"), "text")
    scope = d.select(F.concat(F.lit("run-"), "doc_id").alias("run_id"), F.when(F.col("doc_id") % 3 == 0, "dense-v0").otherwise("dense-v1").alias("dense_version"), F.lit("bm25-v1").alias("sparse_version"))
    return R.hydrate(_fused(spark, sf_dir), parents, scope, "dense-v1", "bm25-v1").select("parent_chunk_id", "run_id", F.sha2("text", 256).alias("text_hash"), F.round("score", 9).alias("score"))


def retrieval_quality(spark, sf_dir):
    """Hit rate, reciprocal rank and queries without a hit, of benchmark passages as queries over all documents."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = sources(spark, sf_dir)
    hits = _sparse(docs, q, 3)
    held = hits.join(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), "id").join(q, "query_id").filter(F.contains("text", "query")).select("query_id", "id")
    return R.quality(hits, held, q).select("n_queries", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "no_result_rate")])


def dense_rebuild(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("run_id"), F.col("embedding").alias("vector"))
    own = v.filter("run_id = 2")
    new = own.select("id", F.transform("vector", lambda x: (x * 2).cast("float")).alias("vector"))
    size = v.select(F.size("vector").alias("n")).first()
    return K.rebuild_run(v, own.select("id", "run_id"), new, size["n"] if size else 0).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 4096))).alias("total"))


def redact_nested(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    props = F.concat(F.lit('{"user":{"Api_Key":"x","n":'), F.col("event_id").cast("string"), F.lit('},"list":[{"password":{"a":1}},"'), "event_type", F.lit('"]}'))
    return e.select("event_id", T.redact(props).alias("props"))


def canonical_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    json = F.concat(F.lit('{"b": "'), "event_type", F.lit('", "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", T.canonical_json_hash(json).alias("hash"))


def title_rule(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.title_or_default(F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise("  ")).alias("title"))


def text_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", F.sha2(T.utf8_sig(raw), 256).alias("hash"))


def text_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse(F.col("text")), 256).alias("hash"))


def request_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.request_hash(F.col("user_id"), F.col("event_type")).alias("hash"))


def index_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", T.index_version(F.col("event_type"), "local", "http://host", "model", 8, "l2", "cosine").alias("version"))
    return e.select("event_id", "version", T.collection_name(F.col("version")).alias("collection"))


def etag_versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tag = F.concat(F.when(F.col("event_id") % 2 == 0, 'W/"').otherwise('"'), (F.col("event_id") % 5).cast("string"), F.lit('"'))
    return e.select("event_id", F.coalesce(T.etag_version(tag), F.lit(0)).cast("long").alias("version"))


def consent_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    consent = F.struct((F.col("event_id") % 5 > 0).alias("allowed"), F.lit("u1").alias("user_id"), F.lit("r1").alias("run_id"), F.lit("local").alias("provider"), F.array(F.lit("text"), F.lit("click")).alias("categories"))
    user = F.when(F.col("user_id") % 3 > 0, "u1").otherwise("u2")
    return e.filter(T.consented(F.array(consent), user, F.lit("r1"), F.lit("local"), F.col("event_type"))).select("event_id")


def review_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p, days = (F.col("event_id") % 90 + 5) / 100.0, (F.col("event_id") % 30).cast("double")
    level = F.get(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("event_id") % 3).cast("int"))
    return e.select(
        "event_id", F.round(L.effective_mastery(p, days, F.lit(7.0)), 9).alias("effective"), F.round(L.next_half_life(days + 1, F.col("event_type") == "purchase", level), 9).alias("half_life"), F.round(L.review_days(p), 9).alias("days"),
        L.learning_day(F.col("ts")).cast("string").alias("day"),
    )


QUERIES = {f.__name__: f for f in (
    html_titles, html_block_texts, cas_classify, run_retry, next_run, trash_cancels_runs, lease_renew, lease_complete, request_reservations, import_outcomes, purge_due, topic_listing, topic_unlink, topic_changes, session_users, purges_cancelled, redirect_targets, rrf_fusion, rrf_fusion_by_rank,
    hydrated_parents, retrieval_quality, dense_rebuild, redact_nested, canonical_json, title_rule, text_decode, text_collapse, request_hashes, index_names, etag_versions, consent_filter, review_schedule,
)}

_STATUS = "['queued', 'running', 'validating', 'publishing', 'published', 'cancel_requested', 'compensating', 'failed', 'cancelled'][doc_id % 9 + 1]"
_RUNS = f"(SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 'broken' END AS last_error, CAST(doc_id AS VARCHAR) AS run_id, {_STATUS} AS status, CASE WHEN doc_id % 2 = 0 THEN 'publishing' ELSE 'embedding' END AS checkpoint, doc_id % 100 AS progress, doc_id % 3 AS version FROM documents)"
_ACTIVE = "('queued', 'running', 'validating', 'publishing')"
def _unescaped(sql: str) -> str:
    """sql with the character references of the test pages decoded; the ampersand comes last, so that nothing is decoded twice."""
    for name, char in (("quot", '"'), ("middot", "\u00b7"), ("copy", "\u00a9"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        sql = f"replace({sql}, '&{name};', '{char}')"
    return sql


_HTML = f"""b AS (SELECT page_id, unnest(found) AS x, unnest(range(0, len(found))) AS block_no FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<style>.*?</style>|<script>.*?</script>', '', 'g'), '(?s)<h1>.*?</h1>|<p>.*?</p>|<li>.*?</li>') AS found FROM pages)),
t AS (SELECT page_id, block_no, x[2:3] AS tag, trim(regexp_replace({_unescaped("regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text FROM b)"""
#: Children of pages as Markdown: blocks grouped into parents one by one, then windows over each parent's tokens.
_HTML_CHUNKS = f"""m0 AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS k, CASE tag WHEN 'li' THEN '- ' ELSE '' END || text AS txt, coalesce(last_value(CASE WHEN tag = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no), '') AS path FROM t WHERE text <> ''),
m1 AS (SELECT *, len(regexp_extract_all(txt, '{T.CHUNK_RE}')) AS n FROM m0),
gr AS (SELECT page_id, k, CAST(0 AS BIGINT) AS parent, n AS held, path FROM m1 WHERE k = 1
  UNION ALL SELECT m1.page_id, m1.k, CASE WHEN m1.path = gr.path AND held + m1.n <= 2500 THEN parent ELSE parent + 1 END, CASE WHEN m1.path = gr.path AND held + m1.n <= 2500 THEN held + m1.n ELSE m1.n END, m1.path FROM gr JOIN m1 ON m1.page_id = gr.page_id AND m1.k = gr.k + 1),
pr AS (SELECT gr.page_id, parent, any_value(gr.path) AS path, string_agg(txt, chr(10) || chr(10) ORDER BY gr.k) AS text FROM gr JOIN m1 ON m1.page_id = gr.page_id AND m1.k = gr.k GROUP BY 1, 2),
tk AS (SELECT page_id, parent, regexp_extract_all(text, '{T.CHUNK_RE}') AS t, regexp_split_to_array(text, '{T.CHUNK_RE}') AS g FROM pr),
fl AS (SELECT page_id, parent, len(t) AS n, unnest(t) AS tok, unnest(g[1:len(t)]) AS gap, unnest(range(0, len(t))) AS i FROM tk),
sp AS (SELECT page_id, parent, n, i, length(tok) AS size, CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY page_id, parent ORDER BY i) AS BIGINT) AS e FROM fl),
w0 AS (SELECT page_id, parent, n, unnest(range(0, CASE WHEN n <= 600 THEN 1 ELSE 1 + CAST(ceil((n - 600) / 520.0) AS BIGINT) END)) AS ordinal FROM (SELECT DISTINCT page_id, parent, n FROM sp)),
w1 AS (SELECT w0.page_id, w0.parent, w0.ordinal, min(sp.e - sp.size) AS s, max(sp.e) AS e, count(*) AS n FROM w0 JOIN sp ON sp.page_id = w0.page_id AND sp.parent = w0.parent AND sp.i >= w0.ordinal * 520 AND sp.i < least(w0.ordinal * 520 + 600, w0.n) GROUP BY 1, 2, 3),
ch AS (SELECT w1.*, pr.path, substr(pr.text, w1.s + 1, w1.e - w1.s) AS text, sha256('page-' || w1.page_id || chr(31) || w1.parent || chr(31) || 'parent-child-v1') AS pid FROM w1 JOIN pr ON pr.page_id = w1.page_id AND pr.parent = w1.parent)"""
_FUSED = """a AS (SELECT 'c' || doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
h AS (SELECT 'c' || doc_id AS id, row_number() OVER (ORDER BY n_chars % 1000 DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
fu AS (SELECT coalesce(a.id, h.id) AS id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + h.rank), 0) AS rrf FROM a FULL JOIN h ON a.id = h.id),
ev AS (SELECT 'p' || (CAST(id[2:] AS BIGINT) // 2) AS parent_chunk_id, rrf, row_number() OVER (PARTITION BY CAST(id[2:] AS BIGINT) // 2 ORDER BY rrf DESC, id) AS place FROM fu),
pa AS (SELECT parent_chunk_id, max(rrf) AS score, count(*) AS n FROM ev WHERE place <= 2 GROUP BY 1 ORDER BY score DESC, parent_chunk_id LIMIT 10)"""


def oracles(bm25) -> dict[str, str]:
    quality = bm25("(SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents)", "(SELECT item_id AS query_id, text AS query FROM benchmark)", 3)
    return {
        "html_titles": "SELECT 'page-' || page_id AS run_id, trim(regexp_replace(" + _unescaped("regexp_extract(html, '<title>([^<]*)', 1)") + ", '\\s+', ' ', 'g')) AS title FROM pages",
        "html_blocks": f"""WITH {_HTML}, n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS block_no, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS kind, text,
  coalesce(last_value(CASE WHEN tag = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no), '') AS title_path FROM t WHERE text <> '')
SELECT 'page-' || p.page_id AS run_id, nullif(trim(regexp_replace({_unescaped("regexp_extract(p.html, '<title>([^<]*)', 1)")}, '\\s+', ' ', 'g')), '') AS title, CAST(block_no AS INTEGER) AS block_no, CASE WHEN block_no IS NOT NULL THEN 1 END AS page_number, kind, text, title_path FROM pages p LEFT JOIN n ON n.page_id = p.page_id""",
        "html_chunks": f"""WITH RECURSIVE {_HTML}, {_HTML_CHUNKS} SELECT sha256(pid || chr(31) || ordinal || chr(31) || 'parent-child-v1') AS id, pid AS parent_chunk_id, 'page-' || page_id AS ingestion_run_id, path AS heading_path, ordinal, CAST(s AS INTEGER) AS parent_char_start, CAST(e AS INTEGER) AS parent_char_end, CAST(n AS INTEGER) AS token_count, sha256(text) AS text_hash FROM ch""",
        "html_markdown": f"""WITH {_HTML} SELECT 'page-' || page_id AS run_id, trim(string_agg(CASE tag WHEN 'h1' THEN '# ' WHEN 'li' THEN '- ' ELSE '' END || text, chr(10) || chr(10) ORDER BY block_no), ' ') || chr(10) AS markdown FROM t WHERE text <> '' GROUP BY page_id""",
        "mastery_projection": """WITH RECURSIVE o AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0.2 AS DOUBLE) AS p FROM o UNION ALL SELECT o.user_id, o.k, least(0.98, greatest(0.05, q + (1 - q) * 0.1)) FROM (SELECT o.user_id, o.k, CASE WHEN ok THEN p * 0.85 / (p * 0.85 + (1 - p) * 0.2) ELSE p * 0.15 / (p * 0.15 + (1 - p) * 0.8) END AS q FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) o)
SELECT user_id, round(p, 9) AS mastery, k AS n FROM f WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
        "html_block_texts": f"WITH {_HTML} SELECT 'page-' || page_id AS run_id, row_number() OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS block_no, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS kind, sha256(text) AS text_hash, CAST(count(CASE WHEN tag = 'h1' THEN 1 END) OVER (PARTITION BY page_id ORDER BY block_no) > 0 AS BIGINT) AS depth FROM t WHERE text <> ''",
        "cas_classify": f"""WITH w(s) AS (VALUES ('queued'), ('running'), ('validating'), ('publishing')),
t AS (SELECT * FROM (VALUES ('publish', 'publishing', 'publishing', 'published', 100), ('compensate', 'cancel_requested', NULL, 'compensating', NULL), ('finish_cancel', 'compensating', NULL, 'cancelled', NULL), ('fail_cancel', 'compensating', NULL, 'compensation_failed', NULL)) AS x(command, status, needs, next, done)
  UNION ALL SELECT 'cancel', s, NULL, 'cancel_requested', NULL FROM w UNION ALL SELECT 'fail', s, NULL, 'compensating', NULL FROM w),
e AS (SELECT event_id, ['publish', 'cancel', 'compensate', 'finish_cancel', 'fail_cancel', 'fail'][CAST(floor(value) AS BIGINT) % 6 + 1] AS command, event_id % 3 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS ev FROM events),
o AS (SELECT e.event_id, e.command, r.status, r.progress, r.version, r.last_error, t.next, t.done, CASE WHEN r.doc_id IS NULL THEN 'not_found' WHEN r.version <> e.ev THEN 'conflict' WHEN t.next IS NOT NULL AND (t.needs IS NULL OR t.needs = r.checkpoint) THEN 'applied' ELSE 'invalid' END AS outcome FROM e LEFT JOIN {_RUNS} r ON r.doc_id = e.event_id LEFT JOIN t ON t.command = e.command AND t.status = r.status)
SELECT event_id AS command_id, command, outcome, CASE WHEN outcome = 'applied' AND command = 'finish_cancel' AND last_error IS NOT NULL THEN 'failed' WHEN outcome = 'applied' THEN next ELSE status END AS status, CAST(CASE WHEN outcome = 'applied' THEN coalesce(done, progress) ELSE progress END AS BIGINT) AS progress,
  version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END AS version, CASE WHEN outcome = 'applied' AND command = 'fail' THEN 'error' ELSE last_error END AS last_error FROM o""",
        "run_retry": f"""WITH c AS (SELECT run_id, 'again-' || run_id AS key FROM {_RUNS} UNION ALL SELECT run_id, 'again-' || run_id || '-b' FROM {_RUNS} WHERE doc_id % 2 = 0 UNION ALL SELECT 'x' || run_id, 'again-' || run_id FROM {_RUNS} WHERE doc_id % 10 = 0),
o AS (SELECT c.run_id, key, CASE WHEN r.status IS NULL THEN 'not_found' WHEN r.status IN ('failed', 'cancelled', 'compensation_failed') THEN 'created' ELSE 'not_allowed' END AS outcome FROM c LEFT JOIN {_RUNS} r ON r.run_id = c.run_id)
SELECT run_id AS retry_of, key AS request_key, outcome, CASE WHEN outcome = 'created' THEN sha256(run_id || chr(31) || key || chr(31) || 'retry') END AS run_id, CASE WHEN outcome = 'created' THEN 'queued' END AS status, CASE WHEN outcome = 'created' THEN 'parsing' END AS checkpoint, CASE WHEN outcome = 'created' THEN CAST(1 AS BIGINT) END AS version FROM o""",
        "topic_changes": """WITH t AS (SELECT page_id AS topic_id, 'u' || page_id % 4 AS owner, url AS was, page_id % 5 = 0 AS archived, page_id % 2 AS version FROM pages WHERE page_id % 3 > 0),
c AS (SELECT event_id AS command_id, event_id % 400 AS topic_id, 'u' || CASE WHEN event_id % 11 = 0 THEN 9 ELSE event_id % 400 % 4 END AS u, ['create', 'update', 'archive'][CAST(floor(value) AS BIGINT) % 3 + 1] AS command, user_id % 2 AS ev, CASE WHEN event_id % 13 > 0 THEN 'n' || event_type END AS name FROM events),
o AS (SELECT c.*, t.owner, t.was, t.archived AS gone, t.version AS v, CASE WHEN command <> 'archive' AND name IS NULL THEN 'invalid' WHEN command = 'create' AND owner IS NULL THEN 'created' WHEN command = 'create' THEN 'exists' WHEN owner IS NULL OR owner <> u THEN 'not_found' WHEN v <> ev THEN 'conflict' WHEN t.archived THEN 'archived' ELSE 'applied' END AS outcome FROM c LEFT JOIN t ON t.topic_id = c.topic_id)
SELECT command_id, topic_id, command, outcome, CASE WHEN outcome = 'created' OR (outcome = 'applied' AND command = 'update') THEN name ELSE was END AS name, CASE WHEN outcome = 'created' THEN false WHEN outcome = 'applied' AND command = 'archive' THEN true ELSE gone END AS archived,
  CASE WHEN outcome = 'created' THEN 1 WHEN outcome = 'applied' THEN v + 1 ELSE v END AS version FROM o""",
        "next_run": f"SELECT run_id, status, doc_id % 11 AS created_at FROM {_RUNS} WHERE status IN ('queued', 'running', 'validating', 'publishing', 'cancel_requested', 'compensating') ORDER BY created_at, run_id LIMIT 1",
        "trash_cancels_runs": f"SELECT CASE WHEN doc_id % 4 = 1 AND status IN {_ACTIVE} THEN 'cancel_requested' ELSE status END AS status, count(*) AS n, CAST(sum(version + CASE WHEN doc_id % 4 = 1 AND status IN {_ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS versions FROM {_RUNS} GROUP BY 1",
        "lease_renew": "SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 'running' ELSE 'queued' END AS status, event_type = 'error' AND event_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-10' AS accepted, CASE WHEN event_type = 'error' AND event_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-10' THEN TIMESTAMP '2024-01-10 00:02:00' ELSE ts END AS leased_until FROM events",
        "lease_complete": "SELECT event_id AS job_id, CASE WHEN ok THEN 'completed' WHEN event_type = 'error' THEN 'running' ELSE 'queued' END AS status, ok AS accepted, CASE WHEN NOT ok THEN 'w' || event_id % 3 END AS worker_id FROM (SELECT *, event_type = 'error' AND event_id % 3 = 2 AND ts >= TIMESTAMP '2024-01-10' AS ok FROM events)",
        "request_reservations": """WITH e AS (SELECT event_id, user_id || ':' || event_type AS key, event_id % 4 AS hash, ts, CASE WHEN event_id % 3 > 0 THEN ts + to_hours(CAST(event_id % 100 AS INTEGER)) END AS done_at FROM events),
f AS (SELECT *, first_value(event_id) OVER w AS f_id, first_value(hash) OVER w AS f_hash, first_value(ts) OVER w AS f_ts, first_value(done_at) OVER w AS f_done FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
SELECT event_id, CASE WHEN event_id = f_id THEN 'created' WHEN hash <> f_hash THEN 'conflict' WHEN f_done IS NULL OR f_done > ts THEN 'in_progress' ELSE 'replay' END AS outcome, event_id <> f_id AND ts >= f_ts + INTERVAL 7 DAYS AS expired FROM f""",
        "import_outcomes": """WITH r AS (SELECT doc_id, 'k' || (doc_id - CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END) AS request_key, sha256(text) AS h, CASE WHEN doc_id % 4 = 0 THEN 'u' || (doc_id // 8) END AS url FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY request_key) AS first_id, first_value(h) OVER (PARTITION BY request_key ORDER BY doc_id) AS first_h FROM r),
k AS (SELECT *, min(CASE WHEN doc_id = first_id THEN doc_id END) OVER (PARTITION BY h) AS c, CASE WHEN url IS NOT NULL THEN min(CASE WHEN doc_id = first_id THEN doc_id END) OVER (PARTITION BY url) END AS u FROM f)
SELECT doc_id, request_key, CASE WHEN doc_id <> first_id AND h <> first_h THEN 'conflict' WHEN doc_id <> first_id THEN 'replay' WHEN least(c, coalesce(u, c)) < doc_id THEN 'repeated' ELSE 'created' END AS outcome FROM k""",
        "purge_due": "SELECT doc_id, 'purging' AS state, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS trashed_at FROM documents WHERE doc_id % 5 = 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) + INTERVAL 30 DAYS <= TIMESTAMP '2024-02-01'",
        "topic_listing": "SELECT source AS topic_id, min(doc_id) AS created_at, count(*) AS n_sources FROM documents GROUP BY 1 HAVING min(doc_id) % 3 <> 1",
        "topic_unlink": "SELECT source AS topic_id, count(*) AS n_links FROM documents GROUP BY 1 HAVING min(doc_id) % 3 <> 1",
        "rrf_fusion": f"WITH {_FUSED} SELECT row_number() OVER (ORDER BY score DESC, parent_chunk_id) AS rank, parent_chunk_id, round(score, 9) AS score, n AS n_evidence FROM pa",
        "session_users": """WITH u AS (SELECT DISTINCT user_id, user_id % 6 > 0 AS active FROM events),
s AS (SELECT user_id, TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 20 AS INTEGER)) AS x, CASE WHEN user_id % 4 = 1 THEN TIMESTAMP '2024-01-10' + to_days(CAST(user_id % 9 AS INTEGER)) END AS r FROM u WHERE user_id < 30),
o AS (SELECT event_id, ts, s.user_id, x, CASE WHEN x IS NULL THEN 'not_found' WHEN r <= ts THEN 'revoked' WHEN x <= ts THEN 'expired' WHEN NOT active THEN 'inactive' ELSE 'ok' END AS outcome FROM events e LEFT JOIN s ON s.user_id = e.user_id % 40 LEFT JOIN u ON u.user_id = s.user_id)
SELECT event_id AS request_id, CASE WHEN outcome = 'ok' THEN user_id END AS user_id, outcome, CASE WHEN outcome = 'ok' THEN greatest(x, ts + INTERVAL 12 HOURS) ELSE x END AS expires_at FROM o""",
        "purges_cancelled": "SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 'source.purge' ELSE 'source.purge_due' END AS job_type, CASE WHEN doc_id % 5 = 0 THEN 'running' WHEN doc_id % 3 > 0 AND doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN 'cancelled' ELSE 'queued' END AS status FROM documents",
        "redirect_targets": """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919) AS t FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(u, '^[^:]*://[^/]*') || '/a/b' WHEN 1 THEN u || '?q=1' ELSE 'https://other.org/x' END AS target, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS told, CASE WHEN page_id % 2 = 0 THEN t ELSE t - INTERVAL 330 MINUTES END AS read FROM p""",
        "rrf_fusion_by_rank": f"""WITH {_FUSED}, bu AS (SELECT coalesce(a.id, h.id) AS id, least(a.rank, h.rank) AS br, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + h.rank), 0) AS rrf FROM a FULL JOIN h ON a.id = h.id),
be AS (SELECT 'p' || (CAST(id[2:] AS BIGINT) // 2) AS parent_chunk_id, rrf, br FROM bu QUALIFY row_number() OVER (PARTITION BY CAST(id[2:] AS BIGINT) // 2 ORDER BY rrf DESC, br, id) = 1)
SELECT row_number() OVER (ORDER BY rrf DESC, br, parent_chunk_id) AS rank, parent_chunk_id, round(rrf, 9) AS score FROM be QUALIFY rank <= 10""",
        "hydrated_parents": f"WITH {_FUSED} SELECT parent_chunk_id, 'run-' || doc_id AS run_id, sha256(text) AS text_hash, round(score, 9) AS score FROM pa JOIN documents ON doc_id % 2 = 0 AND parent_chunk_id = 'p' || (doc_id // 2) WHERE doc_id % 3 <> 0",
        "retrieval_quality": f"""WITH {quality}, r AS (SELECT query_id, rank FROM hits JOIN documents ON CAST(doc_id AS VARCHAR) = hits.id JOIN benchmark ON item_id = query_id WHERE contains(documents.text, benchmark.text)),
e AS (SELECT item_id, (SELECT min(rank) FROM r WHERE query_id = item_id) AS rank, item_id IN (SELECT query_id FROM hits) AS found FROM benchmark)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(CASE WHEN found THEN 0.0 ELSE 1.0 END), 6) AS no_result_rate FROM e""",
        "dense_rebuild": "SELECT label AS run_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(list_sum([CAST(floor(CAST(x AS DOUBLE) * CASE WHEN label = 2 THEN 8192 ELSE 4096 END) AS BIGINT) FOR x IN embedding])) AS BIGINT) AS total FROM embeddings GROUP BY 1",
        "redact_nested": """SELECT event_id, '{"user":{"Api_Key":"[REDACTED]","n":' || event_id || '},"list":[{"password":"[REDACTED]"},"' || event_type || '"]}' AS props FROM events""",
        "canonical_json": """SELECT event_id, sha256('{"a":' || event_id || ',"b":"' || event_type || '"}') AS hash FROM events""",
        "title_rule": "SELECT doc_id, coalesce(nullif(substr(regexp_replace(CASE WHEN doc_id % 9 > 0 THEN text ELSE '  ' END, '^\\s+|\\s+$', '', 'g'), 1, 512), ''), 'Untitled source') AS title FROM documents",
        "text_decode": "SELECT doc_id, sha256(text) AS hash FROM documents",
        "text_collapse": "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash FROM documents",
        "request_hashes": "SELECT event_id, sha256(encode(CAST(user_id AS VARCHAR)) || '\\x00'::BLOB || encode(event_type)) AS hash FROM events",
        "index_names": "SELECT event_id, version, 'dense_' || sha256(version)[1:24] AS collection FROM (SELECT event_id, 'dense-local-' || sha256(array_to_string(['local', 'http://host', 'model', '8', 'l2', 'cosine', event_type], chr(31)))[1:24] AS version FROM events)",
        "etag_versions": "SELECT event_id, event_id % 5 AS version FROM events",
        "consent_filter": "SELECT event_id FROM events WHERE event_id % 5 > 0 AND user_id % 3 > 0 AND event_type IN ('text', 'click')",
        "review_schedule": """WITH e AS (SELECT event_id, event_type, ts, (event_id % 90 + 5) / 100.0::DOUBLE AS p, CAST(event_id % 30 AS DOUBLE) AS d FROM events)
SELECT event_id, round(0.05 + (p - 0.05) * pow(2.0, -d / 7), 9) AS effective, round(greatest(0.5, least(180.0, (d + 1) * CASE WHEN event_type = 'purchase' THEN [1.2, 1.6, 2.0][event_id % 3 + 1] ELSE [0.9, 0.6, 0.5][event_id % 3 + 1] END)), 9) AS half_life, round(greatest(0.5, least(60.0, 7 * ln(p / 0.4) / ln(2.0))), 9) AS days, CAST(CAST(ts - INTERVAL 4 HOURS AS DATE) AS VARCHAR) AS day FROM e""",
    }
