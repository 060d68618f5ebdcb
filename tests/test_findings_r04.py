"""What the findings of round 4 showed, on small tables."""

import datetime as dt
import hashlib
import os
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import discovery as D
from tessella.plans import registry
from tessella.sources import files as S


def test_chunks_of_a_long_block_equal_sql(spark, tmp_path):
    """a block of more than 2,500 tokens stays whole, alone in its parent, and so do blocks that begin, end or consist of what is no token."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    bodies = [f"<p>a b</p><p>{words(6000)}</p><p>c</p>", f"<h1>t</h1><p>{words(2500)}</p><li>{words(2501)}</li>", f"<p>{words(2400)}</p><p>{words(100)}</p><p>x</p>", "<p>\u0663 a b \u0663</p><p>\u0663</p><p>c</p>", "<p>\u0663</p>", ""]
    pages = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "page_id long, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = registry.QUERIES["html_chunks"](spark, str(tmp_path))
    want = db.execute(registry.ORACLES["html_chunks"])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert len(want) > 20
    assert sorted(tuple(r) for r in got.select(names).collect()) == want


def test_files_are_written_without_folders_of_their_own(spark, tmp_path):
    """texts become a file each in few folders; what is read is what was written, also by Spark's writer."""
    texts = {f"run-{k}~{k}.{'html' if k % 2 else 'txt'}": f"<p>é {k}</p>\n" * (k % 4) for k in range(3000)}
    df = spark.createDataFrame([(n, t or None) for n, t in texts.items()], "name string, text string").repartition(3)
    assert S.write_each(df, f"file://{tmp_path}/a") == (3000, sum(len(t.encode()) for t in texts.values()))
    paths = [os.path.join(at, n) for at, _, names in os.walk(tmp_path / "a") for n in names]
    assert len({os.path.dirname(p) for p in paths}) <= 1000
    assert {os.path.basename(p): open(p, newline="").read() for p in paths} == texts


def test_files_elsewhere_are_written_by_spark(spark, tmp_path, monkeypatch):
    """the same texts in a file system that tasks don't reach by themselves."""
    monkeypatch.setattr(S, "mounted", lambda spark, folder: None)
    df = spark.createDataFrame([("page-1~1.html", "<p>a</p>"), ("run-1~2.txt", "b\n\nc"), ("run-2~3.txt", None)], "name string, text string")
    assert S.write_each(df, str(tmp_path / "b")) == (3, 12)
    name = F.regexp_extract("path", r"([^/=]+~[0-9]+\.[a-z]+)", 1)
    files = S.scan(spark, str(tmp_path / "b")).withColumn("mime_type", S.mime_type(name))
    assert sorted((r.run_id, r.block_no, r.text) for r in S.parsed(files, name).collect()) == [("page-1~1.html", 0, "a"), ("run-1~2.txt", 0, "b"), ("run-1~2.txt", 1, "c")]


def test_scanned_files_equal_sql_where_ids_repeat(spark, tmp_path):
    """files are read once, and two documents of one id are two files."""
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (2, None), (3, "<p>&amp;lt;</p>")], "page_id long, html string")
    docs = spark.createDataFrame([(1, "a\n\nb"), (1, "c"), (2, ""), (3, None), (None, "d")], "doc_id long, text string")
    db = duckdb.connect()
    for name, df in (("pages", pages), ("documents", docs)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = registry.QUERIES["scanned_files"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") == 1
    rows = sorted((r.run_id or "", r.kind, r.text_hash) for r in got.collect())
    want = [(f"page-{k}", kind, t) for k, kind, t in ((1, "heading", "a"), (1, "paragraph", "b"), (3, "paragraph", "&lt;"))] + [("run-1", "paragraph", t) for t in "abc"] + [("", "paragraph", "d")]
    assert rows == sorted((r, k, hashlib.sha256(t.encode()).hexdigest()) for r, k, t in want)


def test_scanned_files_of_empty_tables(spark, tmp_path):
    """no file, no block."""
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["scanned_files"](spark, str(tmp_path)).collect() == []


def test_reservations_tell_whose_record_outlived_its_time(spark, tmp_path):
    """the seven days of a record are judged again, in the query and in its SQL, which give what the SQL of before did."""
    at = lambda day, second=0: dt.datetime(2024, 3, day, 12, 0, second)
    rows = [(4, 1, "click", at(1)), (8, 1, "click", at(2)), (12, 1, "click", at(8)), (5, 1, "click", at(8)), (16, 1, "click", at(7)), (20, 1, "click", at(9)), (6, 2, "click", at(20)), (10, 2, "click", at(26, 1))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = registry.QUERIES["request_reservations"](spark, str(tmp_path)).select("event_id", "outcome", "expired")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(registry.ORACLES["request_reservations"]).fetchall())
    before = {r.event_id: "expired" if r.expired else r.outcome for r in got.collect()}
    assert before == {4: "created", 8: "replay", 16: "replay", 12: "expired", 5: "expired", 20: "expired", 6: "created", 10: "in_progress"}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def varied(rng, base: str, most: int) -> str:
    t = list(base)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(t) + 1) if rng.random() < 0.7 else 0
        t[at : at + rng.randrange(2)] = rng.choice(["", "x", "é"])
    return "".join(t)


def test_edits_and_letter_counts():
    """pairs within their edits are those of the whole table of distances, and letter counts pass every one of them."""
    rng = random.Random(8)
    pairs = [(a := "".join(rng.choice("ab é😀") for _ in range(rng.randrange(60))), varied(rng, a, 9)) for _ in range(9_000)]
    most = [rng.randrange(8) for _ in pairs]
    texts, others = (pa.array(list(x), pa.string()) for x in zip(*pairs))
    want = [edits(a, b) <= k for (a, b), k in zip(pairs, most)]
    assert 1_000 < sum(want) < 8_000
    assert D.edits_within()(texts, others, pa.array(most, pa.int32())).to_pylist() == want
    counts = [[c.to_pylist() for c in D.letter_counter()(x).flatten()] for x in (texts, others)]
    apart = [sum(((x[k] ^ y[k]) % 2**64).bit_count() for x, y in zip(*counts)) for k in range(len(pairs))]
    assert all(apart[k] <= 2 * m for k, m in enumerate(most) if want[k])


def test_like_titles_are_connected_without_their_pairs(spark, monkeypatch):
    """a family of like titles is compared with one of them, not each with each; components are those of all pairs."""
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(2)]
    bases += [b[:40] + "".join(rng.choice("ijklmnop ") for _ in range(30)) for b in bases]
    titles = sorted({varied(rng, b, 4).strip() for b in bases for _ in range(250)} | {varied(rng, varied(rng, b, 7), 7).strip() for b in bases for _ in range(30)})
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(titles)], "topic_id string, id int, t string")
    pairs = [(i, j) for i in range(len(titles)) for j in range(i)]
    allowed = [max(len(titles[i]), len(titles[j])) // 10 for i, j in pairs]
    near = D.edits_within()(*(pa.array([titles[p[at]] for p in pairs], pa.string()) for at in (0, 1)), pa.array(allowed, pa.int32())).to_pylist()
    links = [p for p, is_near in zip(pairs, near) if is_near]
    component = list(range(len(titles)))
    before = None
    while before != component:
        before = list(component)
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
    compared, near = [], D.near_titles
    monkeypatch.setattr(D, "near_titles", lambda pairs, *more: compared.append(pairs.count()) or near(pairs, *more))
    none = spark.createDataFrame([], "a struct<topic_id:string,id:int>, b struct<topic_id:string,id:int>")
    got = {r.place.id: r.component.id for r in D.title_components(df, none, 0.1).collect()}
    assert got == dict(enumerate(component))
    assert sum(compared) < len(links) / 2
