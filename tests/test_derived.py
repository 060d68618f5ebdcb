"""Embedding of whole runs, overlap removal and discovery against plain computations."""

import random

import pytest

from tessella.operators import discovery as D
from tessella.operators import embedding as E
from tessella.operators import overlaps as V
from tessella.operators.graphs import connected


#: Tells each text's batch: its size and its first id. A lambda, so that workers, which don't import tests, get it by value.
sizes = lambda batch: [(i, [float(len(batch)), float(batch[0][0].split("-")[1])]) for i, _ in batch]


def fails_on(word, code="embedding_unavailable", retryable=True):
    def embed(batch):
        if any(word in t for _, t in batch):
            raise E.EmbeddingFailure(code, retryable)
        return sizes(batch)

    return embed


def chunks(spark, runs):
    rows = [(run, "u", k, f"{run}-{k}", t) for run, texts in runs.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "run_id string, user_id string, ordinal int, id string, text string").repartition(3)


def consents(spark, *pairs):
    return spark.createDataFrame([("u", run, p) for run, p in pairs], "user_id string, run_id string, provider string")


def test_batches_of_32_cross_arrow_batches(spark):
    runs = {"a": ["x"] * 70, "b": ["x"] * 31, "c": ["x"] * 33}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        _, vectors = E.embedded(chunks(spark, runs), consents(spark, ("a", "p"), ("b", "p"), ("c", "p")), E.Provider("p", "v1", 2, sizes))
        got = {r.id: tuple(r.vector) for r in vectors.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {f"{run}-{k}": (float(min(32, len(t) - k // 32 * 32)), float(k // 32 * 32)) for run, t in runs.items() for k in range(len(t))}
    assert got == want


def test_a_run_has_vectors_of_one_version_or_none(spark):
    runs = {"ok": ["x"] * 40, "late": ["x"] * 39 + ["bad"], "worse": ["bad"] * 2 + ["x"] * 40 + ["worst"], "shut": ["x"], "half": ["bad"]}
    c = chunks(spark, runs).union(spark.createDataFrame([("mix", "u", 0, "mix-0", "x"), ("mix", "w", 1, "mix-1", "x")], "run_id string, user_id string, ordinal int, id string, text string"))
    allowed = consents(spark, *((r, p) for r in ("ok", "late", "worse", "mix") for p in ("p", "q")), ("half", "p"), ("shut", "q"))
    first, second = E.Provider("p", "v1", 2, fails_on("bad")), E.Provider("q", "v2", 2, fails_on("worst"))
    outcomes, vectors = E.embedded(c, allowed, first, second)
    assert {r.run_id: (r.version, r.used_fallback, r.error) for r in outcomes.collect()} == {
        "ok": ("v1", False, None), "late": ("v2", True, None), "worse": ("v2", True, "embedding_unavailable"), "shut": ("v1", False, "embedding_not_authorized"), "half": ("v2", True, "embedding_not_authorized"),
        "mix": ("v1", False, "embedding_run_mixed_identity"),
    }
    held = {(r.run_id, r.version) for r in vectors.collect()}
    assert held == {("ok", "v1"), ("late", "v2")} and vectors.count() == 80
    assert {r.error for r in E.embedded(c, allowed, E.Provider("p", "v1", 2, fails_on("bad", "embedding_rejected", False)), second)[0].filter("run_id = 'late'").collect()} == {"embedding_rejected"}
    assert E.embedded(c, allowed, first)[0].filter("error = 'embedding_unavailable'").count() == 3


@pytest.mark.parametrize("embed, code", [(lambda b: sizes(b)[1:], "count"), (lambda b: sizes(b)[::-1], "reference"), (lambda b: [(i, [1.0]) for i, _ in b], "dimension")])
def test_answers_are_checked(spark, embed, code):
    outcomes, vectors = E.embedded(chunks(spark, {"a": ["x", "y"]}), consents(spark, ("a", "p")), E.Provider("p", "v1", 2, embed), E.Provider("q", "v2", 2, sizes))
    assert [r.error for r in outcomes.collect()] == [f"embedding_{code}_mismatch"] and vectors.isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_go_in_score_order(spark, seed):
    rng = random.Random(seed)
    rows = [(f"q{rng.randrange(2)}", k, f"d{rng.randrange(3)}", s := rng.randrange(400), s + rng.randrange(0, 120), rng.randrange(6) / 2) for k in range(150)]
    got = {tuple(r) for r in V.without_overlaps(spark.createDataFrame(rows, "query_id string, id int, document_id string, start int, end int, score double"), 0.5, 32).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        def meets(o, r=r):
            common = min(o[4], r[4]) - max(o[3], r[3])
            return o[0] == r[0] and o[2] == r[2] and common > 0 and 2 * common >= min(o[4] - o[3], r[4] - r[3])

        if not any(map(meets, kept)):
            kept.append(r)
    assert got == set(kept)
    assert V.without_overlaps(spark.createDataFrame(rows[:0], "query_id string, id int, document_id string, start int, end int, score double")).isEmpty()


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(20, 50)] + [(100, k) for k in range(101, 120)] + [(7, 7), (3, 4), (4, 3)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {k: 20 for k in range(20, 51)} | {k: 100 for k in range(100, 120)} | {3: 3, 4: 3}


def test_candidates_of_one_work(spark):
    title = "A survey of retrieval over very large collections of text"
    rows = [
        ("t", 1, title, "https://doi.org/10.5/ABC", None, None, False, 5), ("t", 2, "Another name", "doi: 10.5/abc", None, None, False, 9), ("t", 3, title.upper() + "!", None, None, "https://h.org/x.pdf", True, 9),
        ("t", 4, "A survey of retrieval over very large colections of texts", None, "http://h.org", None, None, 1), ("t", 5, "Unlike the others", None, "HTTP://H.org:80/", None, None, 2), ("t", 6, None, None, None, None, None, 9),
        ("t", 7, "??", "11.1/x", "", "", None, 9), ("u", 8, title, "10.5/abc", None, None, None, 0),
    ]
    c = spark.createDataFrame(rows, "topic_id string, id int, title string, doi string, url string, pdf_url string, open_access boolean, relevance int")
    assert {r.id: r.work for r in D.works(c).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8}
    assert [(r.rank, r.work, r.id, r.n) for r in D.recommended(c, 2).orderBy("topic_id", "rank").collect()] == [(1, 1, 3, 5), (2, 7, 7, 1), (1, 8, 8, 1)]
