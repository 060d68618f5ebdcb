"""Every corpus query and the pipeline over the whole smallest tables, against SQL or a plain computation."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm import brute_base, brute_components, brute_facts, brute_windows, jaccard

import corpus_pipeline
from tessella.llm import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return db


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    got, want = (f[sorted(f.columns)].astype(str) for f in (queries.QUERIES[name](spark, SF_DIR).toPandas(), tables.execute(queries.ORACLES[name]).df()))
    order = [*got.columns]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_op1(spark, texts):
    rows = run(spark, "op1_pii")
    assert rows.keys() == texts.keys()
    names = ("email", "ip", "card", "phone")
    for i, t in texts.items():
        base = brute_base(t)
        each = [f"{names[k]}:{a}:{b}" for k, a, b in base]
        r = rows[i]
        assert [r[f"n_{n}"] for n in names] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == sha(",".join(each)) and set(each) <= set(r.spans.split(",") if r.spans else [])


def test_op2(spark, texts):
    rows, tok = run(spark, "op2_bpe"), library("word_bpe_49k.json")
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert tuple(rows[i])[1:4] == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op5(spark, texts):
    rows, facts, ids = run(spark, "op5_fingerprints"), brute_facts(texts.items()), sorted(texts)
    off = []
    for k, i in enumerate(ids):
        r, (n, edited) = rows[i], facts[i]
        assert (r.n_chars, r.edited_sha256) == (n, sha(edited))
        off += [r.near_edited - jaccard(texts[i], edited), r.near_next - jaccard(texts[i], texts[ids[(k + 1) % len(ids)]])]
    assert abs(sum(off) / len(off)) < 0.02 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.07
    same = defaultdict(set)
    for i, t in texts.items():
        same[t].add(rows[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_op7(spark, texts):
    rows = run(spark, "op7_sharding")
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    for i, t in texts.items():
        r = rows[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[t].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and set(slots) == set(range(24))
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    largest = Counter()
    for t in texts.values():
        largest[t] += len(t.encode()) + 8
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + max(largest.values())


def test_op8(spark, tables):
    """These pages mark their article, hold no list, link or form in it, and say nothing in short blocks elsewhere."""
    import html

    rows = run(spark, "op8_html")
    pages = tables.execute("SELECT page_id, url, coalesce(html, '') FROM pages").fetchall()
    assert len(rows) == len(pages)
    for i, url, page in pages:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
        parts = re.split(r"</?(?:h1|p)>", article[1]) if article else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts) if x)
        assert (rows[i].url, rows[i].text, rows[i].n_chars) == (url, want, len(want))


def packed_right(rows, texts, tok):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and all(r.length == 2048 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and 1 <= r.length <= 2048 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_op9(spark, texts):
    packed_right(queries.QUERIES["op9_packing"](spark, SF_DIR).collect(), texts, library("byte_bpe_50k.json"))


def test_op10(spark, texts, tables):
    rows = run(spark, "op10_toxicity")
    labels = dict(tables.execute("SELECT doc_id, max(toxic) FROM labels WHERE toxic IS NOT NULL GROUP BY 1").fetchall())
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    again = run(spark, "op10_toxicity")
    assert {i: r.score for i, r in rows.items()} == {i: r.score for i, r in again.items()}
    small = sum(labels.values()) < 30  # too few to learn from
    assert small or sum(rows[i].predicted for i, x in labels.items() if x) > sum(labels.values()) / 2


def test_pipeline(spark, texts):
    """Each stage does to its own input what a plain computation does, and run() is their composition."""
    from tessella.llm.common import cut, read

    docs = read(spark, SF_DIR, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_dedup", "substring_dedup", "pii", "packing"]

    def step(name, docs):
        out = cut(stages[name](spark, docs, SF_DIR))
        assert name == "packing" or out.columns == columns
        return out, {r.doc_id: r.text or "" for r in out.collect()} if name != "packing" else None

    scores = run(spark, "op10_toxicity")
    docs, held = step("toxicity", docs)
    assert held == {i: t for i, t in texts.items() if not scores[i].predicted}
    parts = brute_components(held.items(), 5, 80)
    docs, fewer = step("near_dedup", docs)
    assert fewer == {i: t for i, t in held.items() if parts[i][2]}
    left = brute_windows(fewer.items(), 20)
    docs, shorter = step("substring_dedup", docs)
    assert shorter.keys() == fewer.keys()
    for i, t in shorter.items():
        assert t == fewer[i] if left[i][1] == 0 else sha(t) == left[i][2]
    docs, masked = step("pii", docs)
    assert masked.keys() == shorter.keys()
    for i, t in masked.items():
        kinds = Counter(k for k, _, _ in brute_base(shorter[i]))
        assert t == shorter[i] or "[" in t
        assert not brute_base(t) and all(t.count(f"[{name}]") >= min(1, kinds[k]) for k, name in ((0, "EMAIL"), (2, "CARD"), (3, "PHONE")))
    packed, _ = step("packing", docs)
    packed_right(packed.collect(), masked, library("byte_bpe_50k.json"))
    whole = corpus_pipeline.run(spark, SF_DIR)
    facts = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(facts).collect())) == sorted(map(tuple, packed.select(facts).collect()))


EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}
ODD = {
    "documents": ([(None, None, 1, "x"), (None, "a b", 2, "y"), (3, "", 3, None), (3, "", 3, None), (4, "a b " * 30, 4, "z"), (5, "a b " * 30, 5, "z"), (6, "mail q@r.ss now " * 2000, 6, "z")], "doc_id long, text string, n_words int, spans string"),
    "embeddings": ([(None, [1.0], "x"), (0, None, "y"), (100, [1.0, None], None), (200, [2.0, 1.0], "z"), (200, [2.0, 1.0], "z"), (1, [1.0, 1.0], "z"), (2, [1.0, 1.0], "z")], "vec_id long, embedding array<float>, score string"),
    "pages": ([(None, None, None, 1), (2, "u", "<p>" + "the people of the village were glad " * 3000, 2)], "page_id long, url string, html string, text int"),
    "conversations": ([(None, 0, "user", None, 1), (1, None, None, "x", 1), (1, 0, "assistant", "y" * 100_000, 1), (1, 0, "assistant", "y" * 100_000, 1), (2, 5, "user", "", 1)], "conv_id long, turn long, role string, text string, segments int"),
    "labels": ([(None, 1, 1), (4, None, 2), (5, 1, 3)], "doc_id long, toxic int, score int"),
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (name == "op13_chat_format")  # its own conversation


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nulls_ties_repeated_rows_and_clashing_columns(spark, tmp_path, name):
    more = {"documents": F.lit(None).cast("string").alias("lang"), "embeddings": F.lit(None).cast("int").alias("label")}
    for table, (rows, schema) in ODD.items():
        spark.createDataFrame(rows, schema).select("*", *([more[table]] if table in more else [])).write.parquet(f"{tmp_path}/{table}.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op4_topk":
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == {(200, 1, 1, 3 * 1024**2), (200, 2, 2, 3 * 1024**2)}
    elif name == "op8_html":
        assert sorted(r.n_chars for r in found) == [0, len(("the people of the village were glad " * 3000).strip())]
    elif name == "op11_collocations":
        assert found and {r.lang for r in found} == {"und"}
    elif name == "op12_vector_codes":
        assert Counter((r.vec_id, r.error is None) for r in found) == Counter([(None, True), (1, False), (2, False), (200, False), (200, False)])
    elif name == "op13_chat_format":
        assert {r.conv_id: (r.n_turns, r.loss_chars) for r in found} == {None: (1, 0), 1: (3, 200_000), 2: (1, 0), -1: (2, 34)}
    else:
        assert len(found) >= 7 and len({r.doc_id for r in found}) == 5


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_and_odd_tables(spark, tmp_path, stage):
    rows, schema = ODD["documents"]
    odd = spark.createDataFrame([(i, t, a, b, 1, 2) for i, t, a, b in rows], schema + ", toxic int, _id int")
    spark.createDataFrame(ODD["labels"][0], ODD["labels"][1]).write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, odd, str(tmp_path))
    assert stage == "packing" or out.columns == odd.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} >= {None, 3, 4, 6}
    assert f(spark, odd.limit(0), str(tmp_path)).count() == 0


NOTED = [
    ([(3, "A"), (5, "A"), (5, "B")], [(3, "A"), (5, "B")]),
    ([(5, "B"), (5, "A"), (3, "A"), (3, "A"), (4, "B")], [(3, "A"), (4, "B")]),
    ([(None, "N"), (None, "N")], [(None, "N"), (None, "N")]),
    ([(None, "N"), (None, "N"), (7, "N"), (7, "N")], [(None, "N"), (None, "N"), (7, "N")]),
    ([(1, None), (1, ""), (2, None)], [(1, None), (1, ""), (2, None)]),
]


@pytest.mark.parametrize("rows, want", NOTED)
def test_near_dedup_stage_judges_documents_that_share_an_id_one_by_one(spark, rows, want):
    words = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "ABN"} | {None: None, "": ""}
    docs = spark.createDataFrame([(i, words[t], "x") for i, t in rows], "doc_id long, text string, component_id string")
    out = corpus_pipeline.near_dedup(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, words[t]) for i, t in want)
