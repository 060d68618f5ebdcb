"""Time follows the size of what is read: four times as much takes far less than sixteen times as long."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import chunks as C
from tessella.sources import parsers as P


def seconds(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


ODD = ["<b x ", '<b x="', "<script ", "<!-- ", "<!x ", "</p", "<p>a", '<b "\'', "<style>x</style", "<a b='\">", "<p><h1>a</p>"]


@pytest.mark.parametrize("piece", ODD)
def test_pages_of_unclosed_markup(piece):
    small, large = (min(seconds(lambda n=n: P.page_blocks("<p>" + piece * n + "</p>")) for _ in range(2)) for n in (10_000, 40_000))
    assert large < 0.5 + 8 * small


def test_what_unclosed_markup_leaves():
    assert P.page_blocks("<title>T</title><p>one</p><p>two <b x <i>y</p>") == ("T", [("paragraph", "one", []), ("paragraph", "two y", [])])
    assert P.page_blocks("<p>one</p><p>two</p <p>three") == (None, [("paragraph", "one", []), ("paragraph", "two", [])])
    assert P.page_blocks("<p>one<script>x</p>") == (None, [])
    assert P.page_blocks("<p>one<script/>two</p>") == (None, [("paragraph", "one two", [])])


def test_texts_of_many_lines():
    text = "# a\n\nsome words\nmore\n## b\nx\n\n"
    small, large = (seconds(lambda n=n: list(P.line_blocks(text * n))) for n in (10_000, 40_000))
    assert large < 0.5 + 8 * small
    assert list(P.line_blocks("intro \n\n ## B \ntext\r\n more\n# A\n### C\n#no\n####### seven\n# \x0bx\n")) == [
        ("paragraph", "intro", []), ("heading", "B", ["B"]), ("paragraph", "text\nmore", ["B"]), ("heading", "A", ["A"]), ("heading", "C", ["A", "C"]), ("paragraph", "#no\n####### seven\n#\nx", ["A", "C"]),
    ]


def test_runs_of_many_units(spark):
    def blocks(n):
        path = F.array(F.concat(F.lit("h"), F.floor(F.col("id") / 7).cast("string")))
        return spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("block_no"), F.lit(1).alias("page_number"), F.lit("paragraph").alias("kind"), F.lit("a b c d").alias("text"), path.alias("title_path"))

    def work(n):
        rows = C.parents(blocks(n), maximum=12).groupBy("token_count").count().collect()
        assert {r.token_count: r["count"] for r in rows} == {12: n // 7 * 2, 4: n // 7}

    work(700)
    small, large = (seconds(lambda n=n: work(n)) for n in (7_000, 28_000))
    assert large < 3 + 8 * small


def test_parents_of_blocks_with_headings_and_pages(spark):
    rows = [("r", 0, 1, "p", "one two three four five six", ["First"]), ("r", 1, 2, "p", "seven eight nine ten", ["First"]), ("r", 2, 2, "p", "a", ["Second"]), ("s", 0, None, "p", "x y", []), ("s", 1, None, "p", "", []), ("s", 2, None, "p", "z", [])]
    df = spark.createDataFrame(rows, "run_id string, block_no int, page_number int, kind string, text string, title_path array<string>")
    parents = C.parents(df, maximum=10)
    got = [(r.ingestion_run_id, r.ordinal, r.text, r.token_count, r.page_start, r.page_end) for r in parents.orderBy("ingestion_run_id", "ordinal").collect()]
    assert got == [("r", 0, "one two three four five six\n\nseven eight nine ten", 10, 1, 2), ("r", 1, "a", 1, 2, 2), ("s", 0, "x y\n\nz", 3, 1, 1)]
    kids = C.children(parents, maximum=4, overlap=1).filter("ingestion_run_id = 'r'").orderBy("parent_char_start", "text").collect()
    assert [(r.text, r.page_start, r.page_end) for r in kids if r.parent_chunk_id == kids[-1].parent_chunk_id][-1] == ("seven eight nine ten", 2, 2)


def test_windows_of_long_texts(spark):
    text = " ".join(f"w{k}" for k in range(30_000))
    df = spark.createDataFrame([(text,)], "text string")
    (row,) = C.with_windows(df, "text", 30, 10).select("windows").collect()
    words = text.split()
    assert [text[w.start : w.end] for w in row.windows] == [" ".join(words[k : k + 30]) for k in range(0, 30_000 - 10, 20)]
