"""What the findings of round 3 showed, on small tables."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from tessella.functions.text import CHUNK_RE
from tessella.operators import chunks as C
from tessella.operators import discovery as D
from tessella.operators import imports as I
from tessella.operators import overlaps as V
from tessella.operators import retrieval as R
from tessella.plans.library_queries import digests
from tessella.sources import parsers as P
from tessella.sources.library import workspace


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_pair_of_like_titles_is_missed(spark):
    """titles meet wherever their edits are, also where a letter before all others moves the rest."""
    rng = random.Random(3)
    titles = set()
    for _ in range(12):
        base = "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(3, 90))).strip()
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(len(base) // 8 + 2)):
                at = rng.randrange(len(t) + 1) if rng.random() < 0.7 else 0
                t[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
            titles.add("".join(t))
    titles = sorted(titles - {""})
    want = {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and edits(a, b) <= max(len(a), len(b)) // 10}
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(titles)], "topic_id string, id int, t string")
    assert len(want) > 50
    assert {(r.a, r.b) for r in D.similar_titles(df, 0.1).collect()} == want


def test_many_overlaps_make_no_pairs(spark):
    """what moves is a row an interval, however many of a document overlap."""
    rows = [("q", k, "d", k % 7, 1000 + k % 11, float(k % 5)) for k in range(3000)]
    df = spark.createDataFrame(rows, "query_id string, id int, document_id string, start int, end int, score double")
    out = V.without_overlaps(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert [r.id for r in out.collect()] == [4]


def test_digests_of_many_rows(spark):
    """the sum of hashes of so many rows passes 64 bits."""
    rows = spark.range(140_000)
    (got,) = digests({"t": rows}, {"t": ["id"]}).collect()
    assert (got.n, got.digest) == (140_000, sum(int(hashlib.sha256(str(k).encode()).hexdigest()[:12], 16) for k in range(140_000)) % 2**63)


def test_references_without_semicolon(spark):
    """F4 to F9: the SQL decodes references that end in a semicolon; by itself the parser reads pages as browsers do."""
    page = "<title>a &amp;&amp</title><h1>b &amp; &lt; &nosuch; &#65; &quo</h1><p>c &amp"
    df = spark.createDataFrame([("r", page + "</p>")], "run_id string, html string")
    assert [(r.title, r.text) for r in P.html_blocks(df, closed=True).orderBy("block_no").collect()] == [("a &&amp", "b & < &nosuch; A &quo"), ("a &&amp", "c &amp")]
    assert [(r.title, r.text) for r in P.html_blocks(df).orderBy("block_no").collect()] == [("a &&", "b & < &nosuch; A &quo"), ("a &&", "c &")]


def test_requests_are_made_once(spark):
    """F13, F15, F16: an import that writes seven tables makes its requests, with their texts' hashes, a single time."""
    made = spark.sparkContext.accumulator(0)

    def counted(text):
        made.add(1)
        return text

    hashed = F.udf(counted, "string")(F.col("id").cast("string"))
    requests = spark.range(20).select(F.lit("u").alias("user_id"), F.concat(F.lit("k"), "id").alias("request_key"), hashed.alias("request_hash"), "id")
    requests = requests.select("user_id", "request_key", "request_hash", F.col("request_hash").alias("candidate_id"), F.lit("t").alias("topic_id"), F.lit("title").alias("title"), F.col("request_hash").alias("content_hash"), F.lit(1).cast("long").alias("content_size"), F.lit("text/plain").alias("mime_type"), F.lit("p").alias("storage_path"), F.col("id").alias("seq"))
    library = I.Imports(spark, workspace(spark))
    library.import_batch(requests, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert made.value == 20
    assert library.tables()["ingestion_runs"].count() == 20


def test_scores_where_chunks_are_equal_scores_by_joins(spark, monkeypatch):
    """scores summed in each chunk's place are those of the joins, ties too; F14: tokens counted in place."""
    rng = random.Random(5)
    rows = [(str(k), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12)))) for k in range(60)]
    chunks, queries = spark.createDataFrame(rows, "id string, text string"), spark.createDataFrame([(1, "a b"), (2, "h a z c"), (3, "")], "query_id long, query string")
    monkeypatch.setattr(R, "CELLS", 20)
    here = {(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in R.bm25(chunks, queries, 5).collect()}
    again = R.bm25(chunks.union(chunks.limit(3)), queries, 5).select("query_id", "id")
    assert again.count() == again.distinct().count()
    monkeypatch.setattr(R, "MANY", 0)
    assert here == {(r.query_id, r.id, round(r.score, 9), r["rank"]) for r in R.bm25(chunks, queries, 5).collect()}
    own = spark.createDataFrame([("x", "r", "a b A"), ("y", "r", ""), ("z", "r", "c a")], "id string, run_id string, text string")
    got = {tuple(r) for r in R.postings(own).collect()}
    assert got == {("x", "r", "a", 2, 3), ("x", "r", "b", 1, 3), ("z", "r", "c", 1, 2), ("z", "r", "a", 1, 2)}


def test_windows_take_less_time_than_their_pattern(spark):
    """texts are cut into windows in less time than the pattern of their tokens takes to be matched once."""
    text = " ".join(f"w{k}, wörter {k}." for k in range(5_000))
    df = spark.range(80).repartition(1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t")).cache()
    df.count()

    def seconds(value):
        start = time.perf_counter()
        value.collect()
        return time.perf_counter() - start

    windows = C.with_windows(df, "t", 600, 80).select(F.sum(F.hash("windows")))
    pattern = df.select(F.sum(F.regexp_count("t", F.lit(CHUNK_RE))))
    for work in (windows, pattern):
        seconds(work)
    assert min(seconds(windows) for _ in range(3)) < min(seconds(pattern) for _ in range(3))
    df.unpersist()


def test_windows_hold_the_tokens_of_the_pattern(spark):
    """tokens by code points are those of CHUNK_RE, in texts of all kinds of characters and of any size."""
    rng = random.Random(5)
    odd = ["a", "Z", "0", "_", "é", "ß", "я", "中", "㐀", "䷀", "Ⅷ", "½", "٣", "ʰ", "\u0301", "!", "—", " ", "\n", "\x0b", "\x1c", "\x85", "\u3000", "😀", "𠀀", "𝟘", "\u200b", "\x00", "\xa0", "ꀀ", "\x7f"]
    texts = [None, "", " ", "é", *("".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(2_000)), "aé 中 " * C.GROUP, "x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    found = C.with_windows(df, "t", 1).withColumn("want", F.coalesce(F.regexp_extract_all("t", F.lit(CHUNK_RE), F.lit(0)), F.array().cast("array<string>")))
    rows = found.orderBy("id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(r.t[w.start : w.end], w.tokens) for w in r.windows] == [(t, 1) for t in r.want]
    assert C.with_windows(df.filter("id < 0"), "t", 3, 1).count() == 0
    broken = spark.sql("select cast(x'ff61206220ff' as string) as t")
    assert [tuple(w) for w in C.with_windows(broken, "t", 9).head().windows] == [(0, 6, 4)]
