import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunks as C
from tessella.operators import control as K
from tessella.operators import retrieval as R
from tessella.sources import parsers as P
from tessella.sources import store as S
from tessella.streaming import jobs as J

BLOCKS = "run_id string, block_no int, page_number int, kind string, text string, title_path array<string>"


def test_search_tokens(spark):
    df = spark.createDataFrame([("山Alpha_9 GROẞE größe x-ray ½",)], "t string")
    assert df.select(T.search_tokens(F.col("t")).alias("x")).head().x == ["山", "alpha_9", "gro", "sse", "gr", "össe", "x", "ray", "½"]


def test_parents_break_at_headings_and_children_overlap(spark):
    rows = [("run-9", 0, 3, "paragraph", "red green blue cyan pink", ["Colours"]), ("run-9", 1, 4, "paragraph", "oak elm fir", ["Trees"])]
    parents = C.parents(spark.createDataFrame(rows, BLOCKS), maximum=50)
    found = parents.orderBy("ordinal").collect()
    assert [(p.text, p.page_start, p.page_end, p.token_count, p.document_char_start, p.document_char_end) for p in found] == [("red green blue cyan pink", 3, 3, 5, 0, 24), ("oak elm fir", 4, 4, 3, 26, 37)]
    kids = C.children(parents, maximum=3, overlap=2).orderBy("ingestion_run_id", "parent_chunk_id", "ordinal").collect()
    own = [(k.text, k.parent_char_start, k.token_count) for k in kids if k.parent_chunk_id == found[0].id]
    assert own == [("red green blue", 0, 3), ("green blue cyan", 4, 3), ("blue cyan pink", 10, 3)]
    with pytest.raises(ValueError):
        C.with_windows(parents, "text", 3, 3)


def test_pages_of_children(spark):
    rows = [("run-9", k, k + 1, "paragraph", f"w{k}a w{k}b w{k}c", ["One"]) for k in range(3)]
    kids = C.children(C.parents(spark.createDataFrame(rows, BLOCKS), maximum=90), maximum=4, overlap=0).orderBy("ordinal").collect()
    assert [(k.text, k.page_start, k.page_end) for k in kids] == [("w0a w0b w0c\n\nw1a", 1, 2), ("w1b w1c\n\nw2a w2b", 2, 3), ("w2c", 3, 3)]


def test_one_block_of_many_units(spark):
    text = "".join(chr(0x5000 + k) for k in range(11))
    parents = C.parents(spark.createDataFrame([("run-9", 0, None, "paragraph", text, ["A"])], BLOCKS), maximum=5).orderBy("ordinal").collect()
    assert [(p.token_count, p.page_start) for p in parents] == [(5, 1), (5, 1), (1, 1)] and "".join(p.text for p in parents) == text


def test_windows_of_a_long_text(spark):
    """Offsets by sums over slices equal offsets by a plain scan."""
    import random
    import re

    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", ", ", " ", "\n", "9", ". "]) for _ in range(3000))
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9_]+|[^\w\s]", text)]
    got = C.with_windows(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t", 70, 13).collect()
    starts = range(0, max(1, len(spans) - 13), 57)
    assert [tuple(w) for w in got[0].windows] == [(spans[k][0], spans[min(k + 70, len(spans)) - 1][1], min(70, len(spans) - k)) for k in starts]
    assert got[1].windows == []


def test_small_blocks_share_a_parent(spark):
    rows = [("run-9", k, 1, "paragraph", f"m{k} n{k} o{k}", ["B"]) for k in range(4)]
    parents = C.parents(spark.createDataFrame(rows, BLOCKS), maximum=7).orderBy("ordinal").collect()
    assert [p.text for p in parents] == ["m0 n0 o0\n\nm1 n1 o1", "m2 n2 o2\n\nm3 n3 o3"]


def test_text_blocks(spark):
    df = spark.createDataFrame([("run-9", "opening\n# Birds \nowl\nwren\n\n### Nests\r\n twigs \n####### no heading")], "run_id string, text string")
    rows = P.text_blocks(df).orderBy("block_no").collect()
    assert [(r.kind, r.text, r.title_path) for r in rows] == [
        ("paragraph", "opening", []), ("heading", "Birds", ["Birds"]), ("paragraph", "owl\nwren", ["Birds"]), ("heading", "Nests", ["Birds", "Nests"]), ("paragraph", "twigs\n####### no heading", ["Birds", "Nests"]),
    ]


def test_html_blocks(spark):
    page = "<!doctype html><title>Owls &amp; wrens</title><!-- <p>no</p> --><h1>Owls</h1><blockquote>Night <i>birds</i>!</blockquote><script>if (a < b) '<p>x</p>'</script><h3>Food</h3><ol><li>Mice<li>Voles</li></ol><pre>a  b</pre><div>lost</div><p>open"
    df = spark.createDataFrame([("run-9", page), ("empty", "")], "run_id string, html string")
    blocks = P.html_blocks(df)
    rows = blocks.filter("run_id = 'run-9'").orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in rows] == [("heading", "Owls"), ("paragraph", "Night birds !"), ("heading", "Food"), ("list_item", "Mice Voles"), ("code", "a b")]
    assert rows[0].title == "Owls & wrens" and rows[3].title_path == ["Owls", "Food"]
    assert [(r.title, r.kind) for r in blocks.filter("run_id = 'empty'").collect()] == [(None, None)]
    assert P.markdown(blocks).head().markdown == "# Owls\n\nNight birds !\n\n## Food\n\n- Mice Voles\n\n```\na b\n```\n"


def test_urls(spark):
    df = spark.createDataFrame([(" HTTP://me@Owls.TEST:80?x=2#top ",), ("https://owls.test:8443/a",), ("http://10.1.2.3/",), ("mailto:x",), ("https://[::1]/",)], "u string")
    rows = df.select(T.normal_url(F.col("u")).alias("n"), T.web_target(F.col("u")).alias("ok")).collect()
    assert [r.ok for r in rows] == [False, True, False, False, False]
    assert [r.n for r in rows[:3]] == ["http://owls.test/?x=2", "https://owls.test:8443/a", "http://10.1.2.3/"]


def test_normal_forms(spark):
    df = spark.createDataFrame([("nin\u0303o\rzwei\r\n",)], "t string")
    assert df.select(T.nfc(T.unix_lines(F.col("t"))).alias("x")).head().x == "ni\u00f1o\nzwei\n"


def test_etag_and_redaction(spark):
    df = spark.createDataFrame([('W/"12"',), ('"7"',), ('W/"0"',), ("7",)], "e string")
    assert [r[0] for r in df.select(T.etag_version(F.col("e"))).collect()] == [12, 7, None, None]
    nested = spark.createDataFrame([('{"a": [{"My_Token": {"x": 1}}, 2], "b": {"cookies": "ü", "c": null}}',), (None,)], "j string")
    assert [r[0] for r in nested.select(T.redact(F.col("j"))).collect()] == ['{"a":[{"My_Token":"[REDACTED]"},2],"b":{"cookies":"[REDACTED]","c":null}}', None]


def test_bm25_term(spark):
    chunks = spark.createDataFrame([("k2", "owls hunt at night"), ("k1", "owls, owls and a wren"), ("k3", "trees")], "id string, text string")
    queries = spark.createDataFrame([(1, "OWLS"), (2, "nothing")], "query_id long, query string")
    assert [(r.query_id, r.id, r.rank) for r in R.bm25(chunks, queries).orderBy("rank").collect()] == [(1, "k1", 1), (1, "k2", 2)]
    assert R.bm25(chunks, queries, limit=0).count() == 0


def test_fusion_and_hydration(spark):
    hits = "id string, rank int"
    dense = spark.createDataFrame([("a1", 1), ("b1", 2), ("a2", 3), ("gone", 4)], hits)
    sparse = spark.createDataFrame([("c1", 1), ("a2", 2), ("b1", 5)], hits)
    chunks = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "id string, parent_chunk_id string")
    top = R.fuse(dense, sparse, chunks)
    rows = top.orderBy("rank").collect()
    assert [(r.parent_chunk_id, [e["id"] for e in r.evidence]) for r in rows] == [("A", ["a2", "a1"]), ("B", ["b1"]), ("C", ["c1"])]
    parents = spark.createDataFrame([("A", "r1", "text a"), ("B", "r2", "text b"), ("C", "r3", "text c")], "id string, run_id string, text string")
    scope = spark.createDataFrame([("r1", "d2", "s1"), ("r2", "d1", "s1"), ("r3", "d2", "s0")], "run_id string, dense_version string, sparse_version string")
    assert [r.text for r in R.hydrate(top, parents, scope, "d2", "s1").collect()] == ["text a"]
    with pytest.raises(ValueError):
        R.fuse(dense, sparse, chunks, evidence_limit=0)


def test_quality(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 4), (3, "d", 1)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (2, "c"), (3, "x"), (4, "y")], "query_id long, id string")
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    assert tuple(R.quality(hits, relevant, queries).head()) == (4, 0.25, (0.5 + 0.25) / 4, 0.25)


def test_conflicting_ids(spark):
    df = spark.createDataFrame([("k1", "owl"), ("k2", "owl"), ("k2", "wren"), ("k1", "owl")], "id string, text string")
    assert [r.id for r in R.conflicting_ids(df).collect()] == ["k2"]


def test_dense_rebuild(spark):
    index = spark.createDataFrame([("x", "r1", [1.0, 2.0]), ("y", "r2", [3.0, 4.0])], "id string, run_id string, vector array<double>")
    chunks = spark.createDataFrame([("z", "r2"), ("w", "r2")], "id string, run_id string")
    vectors = lambda rows: spark.createDataFrame(rows, "id string, vector array<double>")
    good = K.rebuild_run(index, chunks, vectors([("z", [0.0, 1.0]), ("w", [1.0, 0.0])]), 2)
    assert sorted(r.id for r in good.collect()) == ["w", "x", "z"]
    for bad in ([("z", [0.0, 1.0])], [("z", [0.0]), ("w", [1.0, 0.0])], [("z", [0.0, 1.0]), ("w", [1.0, 0.0]), ("v", [1.0, 1.0])]):
        with pytest.raises(ValueError):
            K.rebuild_run(index, chunks, vectors(bad), 2)


def test_job_leases(spark):
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "queued", t, t, t, 0, 3, 1), ("b", "running", t, t, t - dt.timedelta(seconds=1), 1, 3, 5), ("c", "running", t, t, t - dt.timedelta(seconds=1), 3, 3, 9)], "job_id string, status string, available_at timestamp_ntz, created_at timestamp_ntz, leased_until timestamp_ntz, attempts int, max_attempts int, priority int")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert [(r.job_id, r.attempts) for r in K.claim(jobs, now, 5).collect()] == [("b", 2), ("a", 1)]
    assert {r.job_id: r.status for r in K.fail(jobs, now).collect()}["c"] == "failed"


def test_requests(spark):
    t = lambda day: dt.datetime(2024, 3, day)
    rows = [("q", "h", t(1), 1, t(2)), ("q", "h", t(1), 2, None), ("q", "g", t(3), 3, None), ("q", "h", t(4), 4, None), ("q", "h", t(9), 5, None), ("p", "h", t(2), 6, None), ("p", "h", t(3), 7, None)]
    df = spark.createDataFrame(rows, "key string, hash string, at timestamp_ntz, seq int, done_at timestamp_ntz")
    assert [r.outcome for r in K.reserve(df).orderBy("seq").collect()] == ["created", "in_progress", "conflict", "replay", "replay", "created", "in_progress"]
    assert sorted(r.seq for r in K.expired_records(df, F.lit("2024-03-09 00:00:00").cast("timestamp_ntz")).collect()) == [1, 2, 6]


def test_clean_ups_end_as_they_began(spark):
    runs = spark.createDataFrame([(f"r{k}", s, "embedding", 10, 1, e) for k, (s, e) in enumerate([("running", None), ("compensating", None), ("compensating", "broken"), ("cancel_requested", None), ("failed", "x")])], "run_id string, status string, checkpoint string, progress int, version long, last_error string")
    commands = spark.createDataFrame([(1, "r0", "fail", 1, "why"), (2, "r1", "finish_cancel", 1, None), (3, "r2", "finish_cancel", 1, None), (4, "r3", "compensate", 1, None), (5, "r4", "fail", 1, "y"), (6, "r0", "fail", 2, "z")], "command_id int, run_id string, command string, expected_version long, error string")
    got = {r.command_id: (r.outcome, r.status, r.version, r.last_error) for r in K.transition(commands, runs).collect()}
    assert got == {1: ("applied", "compensating", 2, "why"), 2: ("applied", "cancelled", 2, None), 3: ("applied", "failed", 2, "broken"), 4: ("applied", "compensating", 2, None), 5: ("invalid", "failed", 1, "x"), 6: ("conflict", "running", 1, None)}


def test_each_retry_key_makes_one_run(spark):
    runs = spark.createDataFrame([("a", "failed"), ("b", "running")], "run_id string, status string")
    got = K.retry(spark.createDataFrame([("a", "k1"), ("a", "k1"), ("a", "k2"), ("b", "k3"), ("c", "k4")], "run_id string, request_key string"), runs).collect()
    assert sorted((r.retry_of, r.outcome) for r in got) == [("a", "created"), ("a", "created"), ("b", "not_allowed"), ("c", "not_found")]
    assert len({r.run_id for r in got if r.outcome == "created"}) == 2 and all(r.run_id is None for r in got if r.outcome != "created")


def test_topics_change_by_version(spark):
    topics = spark.createDataFrame([("t", "u", "old", False, 3), ("s", "u", "shut", True, 1)], "topic_id string, user_id string, name string, archived boolean, version long")
    rows = [(1, "n", "u", "create", None, " new "), (2, "t", "u", "create", None, "x"), (3, "t", "u", "update", 3, "better"), (4, "t", "u", "update", 2, "late"), (5, "t", "w", "archive", 3, None), (6, "t", "u", "archive", 3, None), (7, "s", "u", "update", 1, "x"), (8, "t", "u", "update", 3, " ")]
    got = {r.command_id: (r.outcome, r.name, r.archived, r.version) for r in K.topic_changes(spark.createDataFrame(rows, "command_id int, topic_id string, user_id string, command string, expected_version long, name string"), topics).collect()}
    assert got == {1: ("created", "new", False, 1), 2: ("exists", "old", False, 3), 3: ("applied", "better", False, 4), 4: ("conflict", "old", False, 3), 5: ("not_found", "old", False, 3), 6: ("applied", "old", True, 4), 7: ("archived", "shut", True, 1), 8: ("invalid", "old", False, 3)}


def test_leases(spark):
    t = dt.datetime(2024, 3, 1)
    jobs = spark.createDataFrame([("a", "running", "w1", t), ("b", "running", "w1", t - dt.timedelta(seconds=1)), ("c", "running", "w2", t)], "job_id string, status string, worker_id string, leased_until timestamp_ntz")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    done = {r.job_id: (r.accepted, r.status, r.worker_id) for r in K.hold(jobs, F.lit("w1"), now, "complete").collect()}
    assert done == {"a": (True, "completed", None), "b": (False, "running", "w1"), "c": (False, "running", "w2")}
    assert {r.job_id: r.leased_until for r in K.hold(jobs, F.lit("w1"), now, "renew").collect()}["a"] == t + dt.timedelta(seconds=120)


def test_store(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, "id string, run_id string")
    S.write_runs(frame([("a", "r1"), ("b", "r2")]), path)
    S.write_runs(frame([("c", "r2")]), path)
    assert sorted((r.id, r.run_id) for r in S.read_runs(spark, path).collect()) == [("a", "r1"), ("c", "r2")]
    S.drop_run(spark, path, "r1")
    spark.catalog.refreshByPath(path)
    assert [r.id for r in S.read_runs(spark, path, ["r1", "r2"]).collect()] == ["c"]
    with pytest.raises(ValueError):
        S.write_runs(frame([("x", "../up")]), path)
    with pytest.raises(ValueError):
        S.drop_run(spark, path, "r2/../..")


def test_appends_and_orphans(spark, tmp_path):
    path = str(tmp_path / "blobs")
    frame = lambda rows: spark.createDataFrame(rows, "hash string, body string")
    S.append_new(frame([("h1", "x"), ("h1", "x")]), path, "hash", spark)
    S.append_new(frame([("h1", "y"), ("h2", "z")]), path, "hash", spark)
    spark.catalog.refreshByPath(path)
    assert sorted((r.hash, r.body) for r in spark.read.parquet(path).collect()) == [("h1", "x"), ("h2", "z")]
    kids = spark.createDataFrame([("k", "A"), ("l", "B")], "id string, parent_chunk_id string")
    assert [r.id for r in S.orphans(kids, spark.createDataFrame([("A",)], "id string")).collect()] == ["l"]


def test_streaming_requests(spark, tmp_path):
    events = str(tmp_path / "events")
    spark.createDataFrame([("k1", dt.datetime(2024, 1, 1)), ("k1", dt.datetime(2024, 1, 2)), ("k2", dt.datetime(2024, 1, 2))], "key string, ts timestamp").write.parquet(events)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(events)
    seen = []
    J.worker(J.first_requests(stream, "key", "ts"), lambda df, _: seen.extend(r.key for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["k1", "k2"]


def test_registered_queries_have_rows():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_retrieval" in entry.queries()
