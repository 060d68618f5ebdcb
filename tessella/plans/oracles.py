"""DuckDB SQL for the registered queries."""

from tessella.functions.text import CHUNK_RE, SEARCH_RE
from tessella.plans import more_queries
from tessella.plans.queries import QUERY, SOURCE_NAMES

_S = "(SELECT doc_id, 'run-' || doc_id AS run_id, source AS topic_id, CASE WHEN doc_id % 7 <> 0 THEN 'user-1' ELSE 'user-2' END AS user_id, CASE WHEN doc_id % 10 = 9 THEN 'archived' ELSE 'active' END AS state, CASE WHEN doc_id % 13 = 12 THEN 'failed' ELSE 'published' END AS status, text FROM documents)"
_SCOPE = f"(SELECT * FROM {_S} WHERE topic_id = 'src1' AND user_id = 'user-1' AND state = 'active' AND status = 'published')"
_TERMS = f"[replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(text, '{SEARCH_RE}')]"
_US = "chr(31)"


def _chunks(docs: str) -> str:
    """CTEs parents (p) and children (c) of single-block documents."""
    return f"""
tok AS (SELECT run_id, text, regexp_extract_all(text, '{CHUNK_RE}') AS t, regexp_split_to_array(text, '{CHUNK_RE}') AS g FROM {docs}),
flat AS (SELECT run_id, text, len(t) AS n, unnest(t) AS tok, unnest(g[1:len(t)]) AS gap, unnest(range(0, len(t))) AS i FROM tok),
span AS (SELECT run_id, text, n, i, CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY run_id ORDER BY i) AS BIGINT) AS e, length(tok) AS k FROM flat),
p0 AS (SELECT run_id, text, i // 2500 AS ordinal, min(e - k) AS s, max(e) AS e, min(i) AS i0, count(*) AS n FROM span GROUP BY ALL),
p AS (SELECT sha256(run_id || {_US} || ordinal || {_US} || 'parent-child-v1') AS id, run_id, ordinal, s, e, n, i0, substr(text, s + 1, e - s) AS text FROM p0),
c0 AS (SELECT p.id AS parent_id, p.run_id, p.text, p.s AS ps, p.i0, p.n, unnest(range(0, CASE WHEN p.n <= 600 THEN 1 ELSE 1 + CAST(ceil((p.n - 600) / 520.0) AS BIGINT) END)) AS ordinal FROM p),
c1 AS (SELECT c0.parent_id, c0.run_id, c0.ordinal, c0.text, min(span.e - span.k) - c0.ps AS s, max(span.e) - c0.ps AS e, count(*) AS n FROM c0 JOIN span ON span.run_id = c0.run_id AND span.i >= c0.i0 + c0.ordinal * 520 AND span.i < least(c0.i0 + c0.ordinal * 520 + 600, c0.i0 + c0.n) GROUP BY c0.parent_id, c0.run_id, c0.ordinal, c0.text, c0.ps),
c AS (SELECT sha256(parent_id || {_US} || ordinal || {_US} || 'parent-child-v1') AS id, parent_id, run_id, ordinal, s, e, n, substr(text, s + 1, e - s) AS text FROM c1)"""


def _bm25(docs: str, queries: str, limit: int) -> str:
    """CTE hits (query_id, id, score, rank) for docs (id, text) and queries (query_id, query)."""
    return f"""
q AS (SELECT query_id, unnest(terms) AS term, unnest(range(0, len(terms))) AS place FROM (SELECT query_id, list_distinct(terms) AS terms FROM (SELECT query_id, [replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(query, '{SEARCH_RE}')] AS terms FROM {queries}))),
b AS (SELECT id, {_TERMS} AS terms FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM b),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM b) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= {limit})"""


def _dense(where: str) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), s AS (
  SELECT v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q WHERE {where})
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 20"""


_ONE = f"(SELECT CAST(1 AS BIGINT) AS query_id, '{QUERY}' AS query)"
_IDS = "(SELECT CAST(doc_id AS VARCHAR) AS id, text FROM {})"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_NORMAL = f"""(SELECT page_id, url AS raw, lower(regexp_extract(url, '{_URL}', 1)) || '://' || lower(regexp_extract(url, '{_URL}', 3)) || CASE WHEN regexp_extract(url, '{_URL}', 5) = '' THEN '/' ELSE regexp_extract(url, '{_URL}', 5) END
  || CASE WHEN regexp_extract(url, '{_URL}', 6) = '' THEN '' ELSE '?' || regexp_extract(url, '{_URL}', 6) END AS url, lower(regexp_extract(url, '{_URL}', 3)) AS host FROM pages)"""
_UUID = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{SOURCE_NAMES}:topic-1:' || url))"

ORACLES: dict[str, str] = {
    "tokenize_search": f"SELECT doc_id, CAST(len({_TERMS}) AS BIGINT) AS n_tokens, sha256(array_to_string({_TERMS}, ' ')) AS digest FROM documents",
    "token_count_chunk": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{CHUNK_RE}')) AS BIGINT) AS n_tokens FROM documents",
    "text_normalise": "SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS content_hash, CASE WHEN trim(text) = '' THEN 'empty' WHEN strlen(text) > 1000000 THEN 'too_large' ELSE 'ok' END AS outcome FROM documents",
    "content_dedupe": f"SELECT doc_id, min(doc_id) OVER w AS canonical_id, count(*) OVER w AS copies, doc_id <> min(doc_id) OVER w AS duplicate FROM {_S} WINDOW w AS (PARTITION BY user_id, sha256(text))",
    "request_idempotency": "SELECT event_id, user_id || ':' || event_type AS key, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN sha256(props) = first_value(sha256(props)) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
    "source_identity_uuid5": f"SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS candidate_id FROM (SELECT page_id, {_UUID} AS h FROM {_NORMAL})",
    "url_normalise": f"SELECT page_id, url, host, true AS allowed FROM {_NORMAL}",
    "chunk_parents": f"WITH {_chunks(_S)} SELECT id, run_id AS ingestion_run_id, ordinal, CAST(s AS INTEGER) AS document_char_start, CAST(e AS INTEGER) AS document_char_end, CAST(n AS INTEGER) AS token_count, sha256(text) AS text_hash FROM p",
    "chunk_children": f"WITH {_chunks(_S)} SELECT id, parent_id AS parent_chunk_id, ordinal, CAST(s AS INTEGER) AS parent_char_start, CAST(e AS INTEGER) AS parent_char_end, 1 AS page_start, 1 AS page_end, CAST(n AS INTEGER) AS token_count, sha256(text) AS text_hash FROM c",
    "text_blocks": f"SELECT run_id, CAST(0 AS BIGINT) AS block_no, 'paragraph' AS kind, sha256(text) AS text_hash, CAST(0 AS BIGINT) AS depth FROM {_S}",
    "sparse_postings": f"SELECT CAST(doc_id AS VARCHAR) AS id, term, count(*) AS tf, CAST(n AS BIGINT) AS document_length FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {_TERMS} AS t FROM documents)) GROUP BY doc_id, term, n",
    "sparse_stats": f"SELECT count(*) AS n, round(avg(len({_TERMS})), 6) AS avgdl FROM {_SCOPE}",
    "bm25_topk": f"WITH {_bm25(_IDS.format('documents'), _ONE, 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM hits",
    "bm25_scoped_topk": f"WITH {_bm25(_IDS.format(_SCOPE), _ONE, 20)} SELECT query_id, id, round(score, 6) AS score, rank FROM hits",
    "dense_topk": _dense("true"),
    "dense_scoped_topk": _dense("v.label IN (1, 3, 5)"),
    "hybrid_retrieval": f"""WITH {_chunks(_SCOPE)}, {_bm25('(SELECT id, text FROM c)', _ONE, 20)},
fc AS (SELECT min(id) AS id, CAST(run_id[5:] AS BIGINT) AS vec_id FROM c WHERE ordinal = 0 GROUP BY run_id),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
dn AS (SELECT fc.id, row_number() OVER (ORDER BY list_cosine_similarity(v.e, z.e) DESC, fc.id) AS rank FROM fc JOIN v USING (vec_id), (SELECT e FROM v WHERE vec_id = 0) z QUALIFY rank <= 20),
fu AS (SELECT coalesce(a.id, h.id) AS id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + h.rank), 0) AS rrf FROM dn a FULL JOIN hits h ON a.id = h.id),
ev AS (SELECT c.parent_id, fu.rrf, row_number() OVER (PARTITION BY c.parent_id ORDER BY fu.rrf DESC, fu.id) AS place FROM fu JOIN c USING (id)),
pa AS (SELECT parent_id, max(rrf) AS score, count(*) AS n FROM ev WHERE place <= 2 GROUP BY 1)
SELECT row_number() OVER (ORDER BY score DESC, parent_id) AS rank, parent_id AS parent_chunk_id, p.run_id, 1 AS page_start, 1 AS page_end, sha256(p.text) AS text_hash, length(p.text) AS n_chars, round(score, 9) AS score, pa.n AS n_evidence FROM pa JOIN p ON p.id = parent_id ORDER BY score DESC, parent_id LIMIT 3""",
    "scope_resolution": f"SELECT topic_id, user_id, count(*) AS n_runs, CAST(1 AS BIGINT) AS n_versions FROM {_S} WHERE state = 'active' AND status = 'published' GROUP BY 1, 2",
    "source_listing": f"SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id DESC) AS place FROM {_S} WHERE user_id = 'user-1' AND state = 'active' QUALIFY place <= 5",
    "lifecycle_transition": f"""WITH t(command, state, next) AS (VALUES ('archive', 'active', 'archived'), ('restore', 'archived', 'active'), ('restore', 'trashed', 'active'), ('trash', 'active', 'trashed'), ('trash', 'archived', 'trashed'), ('purge', 'trashed', 'purging')),
e AS (SELECT event_id AS source_id, CASE event_type WHEN 'click' THEN 'archive' WHEN 'view' THEN 'restore' WHEN 'error' THEN 'trash' ELSE 'purge' END AS command, event_id % 3 AS ev FROM events),
s AS (SELECT doc_id, state, doc_id % 2 AS version FROM {_S}),
o AS (SELECT e.command, s.state AS was, t.next, s.version, CASE WHEN s.doc_id IS NULL THEN 'not_found' WHEN s.version <> e.ev THEN 'conflict' WHEN t.next IS NULL THEN 'invalid' ELSE 'applied' END AS outcome FROM e LEFT JOIN s ON s.doc_id = e.source_id LEFT JOIN t ON t.command = e.command AND t.state = s.state)
SELECT command, outcome, CASE WHEN outcome = 'applied' THEN next ELSE was END AS state, count(*) AS n, CAST(coalesce(sum(version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END), 0) AS BIGINT) AS versions FROM o GROUP BY 1, 2, 3""",
    "run_advance": "SELECT 'run-' || doc_id AS run_id, ['extracting', 'chunking', 'embedding', 'validating', 'publishing'][doc_id % 6 + 1] AS checkpoint, ['running', 'running', 'running', 'validating', 'publishing'][doc_id % 6 + 1] AS status, CAST([20, 40, 60, 80, 90][doc_id % 6 + 1] AS BIGINT) AS progress, doc_id % 4 + 1 AS version FROM documents WHERE doc_id % 6 < 5",
    "job_claim": "SELECT event_id AS job_id, 'running' AS status, event_id % 4 + 1 AS attempts, CAST(floor(value) AS BIGINT) % 10 AS priority, TIMESTAMP '2024-02-01 00:02:00' AS leased_until FROM events WHERE (event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-02-01') OR (event_type = 'error' AND ts < TIMESTAMP '2024-02-01' AND event_id % 4 < 3) ORDER BY priority DESC, ts, event_id LIMIT 25",
    "job_fail_requeue": "SELECT event_id AS job_id, CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'queued' END AS status, CASE WHEN event_id % 4 >= 3 THEN ts ELSE TIMESTAMP '2024-02-01 00:00:30' END AS available_at FROM events WHERE event_type = 'error'",
    "outbox_latest_status": "SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) AS n_events FROM events GROUP BY 1",
    "session_ttl": "SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 12 HOURS AS expires_at, count(*) AS n_events FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOURS THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s",
    "index_delete_runs": "SELECT label AS run_id, count(*) AS n FROM embeddings WHERE label NOT IN (1, 4) GROUP BY 1",
    "index_replace_run": "SELECT label AS run_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE label <> 2 OR vec_id % 2 = 0 GROUP BY 1",
    "index_integrity": "SELECT 'no_vector' AS \"check\", count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'no_document', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "redact_props": "SELECT event_id, '{\"token\":\"[REDACTED]\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS props FROM events",
    "retrieval_metrics": f"WITH {_bm25(_IDS.format('documents'), '(SELECT item_id AS query_id, text AS query FROM benchmark)', 3)} SELECT item_id AS query_id, count(hits.id) AS n_hits, round(max(hits.score), 6) AS best FROM benchmark LEFT JOIN hits ON query_id = item_id GROUP BY 1",
    "conversation_export": "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '## ' || role || chr(10) || chr(10) || text) AS markdown FROM conversations GROUP BY 1",
    "canonical_sources": f"SELECT lpad(CAST(page_id AS VARCHAR), 8, '0') AS source_id, first_value(lpad(CAST(page_id AS VARCHAR), 8, '0')) OVER w AS canonical_id, first_value(lpad(CAST(page_id AS VARCHAR), 8, '0')) OVER w <> lpad(CAST(page_id AS VARCHAR), 8, '0') AS duplicate FROM {_NORMAL} WINDOW w AS (PARTITION BY host ORDER BY CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END, page_id % 5, page_id)",
    "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
ORACLES |= more_queries.oracles(_bm25)
