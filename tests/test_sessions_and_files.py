"""Generation sessions as a table and as a stream, and files of several kinds."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import generation as G
from tessella.sources import files as S

PIECES = "session_id string, seq long, at long, kind string, text string"


def sessions(seed=0):
    rng, rows = random.Random(seed), []
    for s in range(6):
        at = 0
        for k in range(1, 60):
            at += rng.choice([1, 20, 90, 250])
            rows.append((f"s{s}", k, at, "delta", "x" * rng.choice([0, 5, 60, 300]) + str(k)))
        rows.append((f"s{s}", 60, at, "session_done", None))
    return rows


def test_events_are_numbered_and_keep_all_text(spark):
    rows = sessions()
    got = G.session_events(spark.createDataFrame(rows[::-1], PIECES).repartition(3)).orderBy("session_id", "event_id").collect()
    for s in {r[0] for r in rows}:
        own = [r for r in got if r.session_id == s]
        assert [r.event_id for r in own] == [*range(1, len(own) + 1)] and own[-1].kind == "session_done"
        assert "".join(r.text for r in own) == "".join(r[4] or "" for r in rows if r[0] == s)
        assert all(len(r.text) < 512 + 302 for r in own)


def test_pieces_are_gathered_by_time_and_size():
    take = lambda s, *pieces: [e for p in pieces for e in s.take(*p, 200, 10)]
    s = G.Session()
    assert take(s, (1, 0, "delta", "ab"), (2, 199, "delta", "c"), (3, 200, "delta", "d")) == [(1, "delta", 199, "abc")]
    assert take(s, (3, 201, "delta", "again"), (4, 210, "delta", "0123456789")) == [(2, "delta", 210, "d0123456789")]
    assert take(s, (5, 220, "delta", ""), (6, 230, "delta", "z"), (7, 240, "session_failed", None)) == [(3, "delta", 230, "z"), (4, "session_failed", 240, "")]


def test_a_stream_gives_the_same_events(spark, tmp_path):
    """Pieces in three files, one a batch, the second of which repeats pieces of the first."""
    rows = sessions(1)
    files = [[r for r in rows if r[1] <= 25], [r for r in rows if 15 < r[1] <= 40], [r for r in rows if r[1] > 40]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, PIECES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for name in os.listdir(f"{tmp_path}/in/{k}"):
            if name.startswith("part-"):
                os.utime(f"{tmp_path}/in/{k}/{name}", (time.time() - 100 + 10 * k,) * 2)
    stream = spark.readStream.schema(PIECES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = G.stream_events(stream, wait=60_000, idle=False).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, G.session_events(spark.createDataFrame(rows, PIECES), wait=60_000).collect()))


def test_replay_after_the_last_event_seen(spark):
    events = spark.createDataFrame([("s", k, "delta", k, f"t{k}") for k in range(1, 6)] + [("s", 6, "session_done", 9, "")], "session_id string, event_id long, kind string, at long, text string")
    seen = spark.createDataFrame([("s", "new", 0), ("s", "late", 3), ("s", "all", 6), ("x", "lost", 0)], "session_id string, reader string, last_event_id long")
    got = sorted((r.reader, r.event_id, r.kind, r.text) for r in G.replay(events, seen, 4).collect())
    assert got == [("late", 4, "delta", "t4"), ("late", 5, "delta", "t5"), ("late", 6, "session_done", ""), ("new", 5, "result_snapshot", "t1t2t3t4t5"), ("new", 6, "session_done", "")]
    assert {r.kind for r in G.replay(events, seen.filter("reader = 'late'"), 9, 3).collect()} == {"result_snapshot", "session_done"}


@pytest.fixture
def folder(tmp_path):
    contents = {
        "a.md": "# T\r\n\r\none\r\ntwo".encode(), "deep/b.HTML": b"\xef\xbb\xbf<title>x</title><h1>H</h1><p>p &amp; q</p>", "c.txt": b"\xef\xbb\xbfplain \xff text", "d.pdf": b"%PDF", "e.bin": b"\0", "f.txt": b"",
    }
    for name, data in contents.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    os.utime(f"{tmp_path}/a.md", (1_600_000_000,) * 2)
    return str(tmp_path)


def test_files_go_to_their_parsers(spark, folder):
    files = S.scan(spark, folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert {r.n: r.mime_type for r in files.select(name.alias("n"), "mime_type").collect()} == {"a.md": "text/markdown", "b.HTML": "text/html", "c.txt": "text/plain", "d.pdf": "application/pdf", "e.bin": None}
    got = sorted((r.run_id, r.block_no, r.kind, r.text, tuple(r.title_path)) for r in S.parsed(files, name).collect())
    assert got == [("a.md", 0, "heading", "T", ("T",)), ("a.md", 1, "paragraph", "one\ntwo", ("T",)), ("b.HTML", 0, "heading", "H", ("H",)), ("b.HTML", 1, "paragraph", "p & q", ("H",)), ("c.txt", 0, "paragraph", "plain � text", ())]
    assert {r.n for r in S.unparsed(files).select(name.alias("n")).collect()} == {"d.pdf", "e.bin"}


def test_a_scan_takes_up_where_it_left_off(spark, folder):
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.select("path").collect()}
    assert "a.md" not in names(S.scan(spark, folder, since="2021-01-01T00:00:00")) and len(names(S.scan(spark, folder, since="2021-01-01T00:00:00"))) == 4
    assert names(S.scan(spark, folder, glob="*.txt")) == {"c.txt"}


def test_charsets(spark):
    df = spark.createDataFrame([(bytearray("é\r\nx".encode("iso-8859-1")),)], "b binary")
    assert df.select(S.decoded(F.col("b"), "ISO-8859-1").alias("t")).first().t == "é\nx"
    assert df.select(S.decoded(F.col("b")).alias("t")).first().t == "�\nx"
