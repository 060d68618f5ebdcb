"""Collocations, vector codes and chat formatting on small tables, against plain computations."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import chat_format, collocations, vector_codes


def brute_collocations(docs, least, percent, most, longest=3):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    held = Counter()
    for (lang, *w), a in f.items():
        if a >= least and len(w) <= longest:
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    held[(lang, *w[i : i + k])] = max(held[(lang, *w[i : i + k])], a)
    rows = defaultdict(list)
    for (lang, *w), a in f.items():
        if a < least or len(w) < 2 or (held[(lang, *w)] and 100 * held[(lang, *w)] >= percent * a):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        rows[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)}


def texts(rng, n, words):
    pool = [f"w{i}" for i in range(words)] + ["Über", "été", "a|b", "\x00", "x y"]
    ends = [" ", " ", " ", "\t", ", ", ". ", "\n", "  ", "!?"]
    return ["".join(pool[int(rng.zipf(1.5)) % len(pool)] + ends[rng.integers(len(ends))] for _ in range(rng.integers(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("shard, most_bits", [(400_000, 30), (7, 30), (50, 4)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, shard, most_bits):
    """Whatever shards cut texts, and however few bits the bitmap has."""
    rng = np.random.default_rng(shard)
    docs = [(t, [None, "en", "de"][i % 3]) for i, t in enumerate(texts(rng, 60, 12))] + [(None, "en"), ("", None), ("A a A a a a A" * 3, "und"), ("w1 w2 " * 3000, "en")]
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "phrase_counts", lambda d, a, b, counts=collocations.phrase_counts: counts(d, a, b, most_bits=most_bits))
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in docs], "text string, lang string, phrase string, f int").repartition(5)
    for least, most in ((4, 2000), (4, 3)):
        got = {tuple(r) for r in collocations.collocations(df, least=least, most=most).collect()}
        assert got == brute_collocations(docs, least, 50, most)


def test_collocations_of_four_words(spark):
    docs = [("a b c d. a b c d! b c x, a b", "en")] * 5
    got = {tuple(r) for r in collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), longest=4, least=5).collect()}
    assert got == brute_collocations(docs, 5, 50, 2000, longest=4)


def test_sketch_leaves_few_rare_phrases_and_every_frequent_one(spark):
    rng = np.random.default_rng(5)
    docs = [(" ".join(f"v{x}" for x in rng.integers(0, 3000, 300)) + " one two three", "en") for _ in range(40)]
    df = spark.createDataFrame(docs, "text string, lang string")
    letters = sum(len(t) for t, _ in docs)
    bits = int(np.ceil(np.log2(3 * letters)))
    heavy = collocations.heavy_counters(df.select("lang", "text"), 3, 10, bits, 3)
    bitmap, size = collocations.candidate_bitmap(heavy, bits, 3, 16, 30)
    shard = next(iter(collocations.shards(iter(df.select("lang", "text").toArrow().to_batches()), 3)))[1]
    passed = Counter(k for _, k, _ in collocations.counted(shard, [], bitmap, size))
    found = {p for p, _, _ in collocations.counted(shard, [], bitmap, size)}
    assert {"one two three", "one two", "two three", "one"} <= found
    assert passed[3] < 0.2 * len(np.unique(shard.hashes[2]))


def brute_codes(vectors, entries, parts, rounds):
    v = [[int(np.floor(float(x) * 256)) for x in e] for e in vectors]
    w = len(v[0]) // parts
    cut = [[tuple(e[p * w : (p + 1) * w]) for p in range(parts)] for e in v]
    books = [[e[p] for e in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for e in cut:
                own[near(e[p], books[p])[1]].append(e[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else y for k, y in enumerate(books[p])]
    found = [[near(e[p], books[p]) for p in range(parts)] for e in cut]
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("kind", ["normal", "ties", "few", "large"])
def test_codes_equal_plain_codes(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    if kind == "ties":
        x = rng.integers(-2, 3, size=(300, 32)) / 256
    if kind == "few":
        x = x[:5]
    if kind == "large":
        x *= 40_000
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), i % 3) for i in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int").repartition(7)
    got, books = vector_codes.encode(df, carry=("code",), entries=16, parts=8)
    got = {r[0]: tuple(r) for r in got.collect()}
    codes, errors, want = brute_codes(x, 16, 8, 2)
    assert [b.tolist() for b in books] == [[list(y) for y in b] for b in want]
    assert got == {i: (i, i % 3, codes[i], errors[i]) for i in range(len(x))}


def test_trees_leave_entries_out_and_agree_with_all_distances():
    rng = np.random.default_rng(0)
    for scale, size in ((3, 4), (300, 4), (2**28, 3), (1, 1)):
        entries = rng.integers(-scale, scale + 1, size=(64, size))
        points = rng.integers(-scale, scale + 1, size=(2000, size))
        tree = vector_codes.Tree(entries)
        index, best = tree.nearest(points)
        d = ((points[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
        if scale == 300:
            assert tree.visits < 0.7 * d.size


def test_code_rows_of_odd_vectors(spark):
    rows = [(None, [1.0, 2.0], "n"), (2, [1.0, None], "x"), (3, [float("nan"), 1.0], "x"), (4, None, "x"), (1, [0.5, 0.5], None), (1, [0.25, 0.5], None), (5, [1.0], "x"), (6, [1e30, 1.0], "x"), (7, [], "y")]
    got, books = vector_codes.encode(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), carry=("label",), entries=2, parts=2)
    codes, errors, _ = brute_codes([[0.25, 0.5], [0.5, 0.5], [1.0, 2.0]], 2, 2, 2)
    want = [*zip((1, 1, None), (None, None, "n"), codes, errors), *((i, label, None, None) for i, label in ((5, "x"), (6, "x"), (7, "y")))]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert [b.shape for b in books] == [(2, 1), (2, 1)]


CHATS = [
    [("user", "hi"), ("user", "there"), ("assistant", "yes"), ("assistant", ""), ("assistant", "<|im_sep|>no<|im_end|>\n")],
    [("system", "<|im_start|>user\nx"), ("assistant", "a<\\|b<\\\\|c<|d<"), ("assistant", "|im_end|>")],
    [("assistant", None), (None, "lost"), ("", "also"), ("a\nb<|nl|>", "\n\n"), ("assistant", "ü" * 50_000)],
    [("user", "")],
]


def test_chats_read_back_what_went_in(spark):
    rows = [(c, t, role, text, "x") for c, turns in enumerate(CHATS) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string, t string").repartition(3)
    from pyspark.sql import functions as F

    out = chat_format.chats(df).select("conv_id", "segments", chat_format.formatted(F.col("segments")).alias("whole"), chat_format.loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in out.select("*", chat_format.turns_of(F.col("whole")).alias("turns")).collect()}
    for c, turns in enumerate(CHATS):
        clean = [(role or "", text or "") for role, text in turns]
        assert [tuple(t) for t in got[c].turns] == clean
        assert got[c].loss == "".join(text for role, text in clean if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(clean, clean[1:]))
        assert got[c].whole.count("<|im_start|>") == got[c].whole.count("<|im_end|>\n") == blocks
        assert got[c].whole.count("<|im_sep|>") == len(clean) - blocks
    assert got[0].whole.startswith("<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n<|im_start|>assistant\nyes<|im_sep|><|im_sep|>")


def test_chats_time_follows_turns(spark):
    """Twice as many turns take about twice as long: no part of a conversation is copied once a turn."""
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 20).alias("text"))
        start = time.perf_counter()
        out = chat_format.chats(df).select(F.explode(F.array(chat_format.formatted(F.col("segments")))).alias("w"))
        assert out.select(F.size(chat_format.turns_of(F.col("w"))).alias("n")).first().n == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 3 + 8 * seconds(10_000)


def test_chats_in_native_expressions_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PROSE = "The people of the village were glad that the rain had come, for it was late in the year and there was little water in the wells."


@pytest.mark.parametrize(
    "page, want",
    [
        # a teaser is marked and the article isn't: the text decides
        ("<div>" + f"<p>{PROSE * 3}" * 4 + f"</div><article><p>{PROSE}</article>", "\n\n".join([PROSE * 3] * 4 + [PROSE])),
        # long text of many stop words beside the article stays
        (f"<article><p>{PROSE * 4}</article><div><p>{PROSE * 3}</div>", f"{PROSE * 4}\n\n{PROSE * 3}"),
        (f"<main><p>{PROSE}<div class=ad-slot>{PROSE}</div><div class='related-articles'>{PROSE}</div><div id=comment-body>{PROSE}</div><div class=articles>{PROSE}</div></main>", f"{PROSE}\n\n{PROSE}"),
        ("<p>See <a href=x>this page</a> for it</p>", "See this page for it"),
        ("<p><a href=x>Home</a></p>", ""),
        (f"<p>{PROSE}<p>Hetible noneth brought stones eleven granite, marble, copper, forty tons alone.<p>{PROSE}", f"{PROSE}\n\nHetible noneth brought stones eleven granite, marble, copper, forty tons alone.\n\n{PROSE}"),
        (f"<p>Hetible noneth brought stones eleven granite, marble, copper, forty tons alone.<p>{PROSE}", PROSE),
    ],
)
def test_text_decides_and_marks_help(page, want):
    from tessella.llm import main_text

    assert main_text.main_text(page) == want


def test_most_blocks_keep_their_label_without_marks():
    import os

    import pyarrow.parquet as pq

    from tessella.llm import main_text

    pages = pq.read_table(os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001") + "/pages.parquet", columns=["html"])["html"].to_pylist()
    same = [x == y for page in pages for x, y in zip(main_text.label(main_text.blocks(page or "")), main_text.label(main_text.blocks(re.sub("<(/?)article>", r"<\1div>", page or ""))))]
    assert sum(same) > 0.95 * len(same)


def test_toxicity_scores_equal_plain_ones(spark):
    """The lexicon from plain counts, and every document's score from it by the definitions, over a whole table."""
    import math
    import os

    from pyspark.sql import functions as F
    from test_llm import slow_segments

    from tessella.llm import toxicity as X
    from tessella.llm.common import read

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = X.training_rows(docs, labels, ~X.held_out(), 200_000).collect()
    shared = Counter(k for r in rows for k in r["keys"])
    counts = defaultdict(lambda: [0, 0])
    for r in rows:
        w = max(1, round(64 / min(shared[k] for k in r["keys"])))
        for f in {f for word in re.findall(r"[^\W\d_]+", r.text.lower()) for f in (word, *(word[:k] + "*" for k in (6, 5, 4) if len(word) >= k))}:
            counts[f][r.toxic] += w
    counts = {f: (a / 64, b / 64) for f, (a, b) in counts.items()}
    n0, n1 = (sum(c[k] for c in counts.values()) for k in (0, 1))
    lexicon = {}
    for f, (a, b) in counts.items():
        if a + b < 3 or not n1:
            continue
        one, zero, mass = b + 0.02 * (a + b), a + 0.02 * (a + b), 0.02 * (n0 + n1)
        delta = math.log(one / (n1 + mass - one)) - math.log(zero / (n0 + mass - zero))
        z = abs(delta) / math.sqrt(1 / one + 1 / zero)
        if z >= 4 or z >= 2 and delta >= 3.9:
            lexicon[f] = max(-3.0, min(6.0, delta))
    model = X.learn(docs, labels, ~X.held_out())
    assert model.scores.keys() == lexicon.keys() and all(abs(model.scores[f] - s) < 1e-9 for f, s in lexicon.items())

    def word_score(token):
        best = -3.0
        for word in re.findall(r"[^\W\d_]+", token) or [""]:
            best = max(best, next((lexicon[f] for f in (word, *(word[:k] + "*" for k in (6, 5, 4) if len(word) >= k)) if f in lexicon), 0.0))
        return min(6.0, best) - 0.15

    def plain(text):
        scores = [word_score(t) for t in text.lower().split()]
        found = [math.fsum(scores[a:b]) for a, b in slow_segments(scores)]
        logs = [math.log(model.k * len(scores)) - model.lam * s for s in found]
        evidence = math.fsum(-e for e in logs if e <= math.log(0.05)) or 0.001 * max(found, default=0.0)
        at = min(evidence / 0.25, 398.999)
        curve = model.curve[int(at)] + (model.curve[int(at) + 1] - model.curve[int(at)]) * (at - int(at))
        return 0.98 * curve + 0.02 * evidence / (1 + evidence) * (max(model.curve) > 0)

    got = {r.doc_id: r.score for r in X.toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    assert all(abs(got[i] - plain(t)) < 1e-6 for i, t in texts.items() if len(t) < 1500)  # the plain search takes cubic time
    toxic = {r.doc_id for r in labels.groupBy("doc_id").agg(F.max("toxic").alias("t")).filter("t = 1").collect()}
    caught = {i for i, s in got.items() if s >= 0.3}
    if len(toxic) >= 30:
        assert len(caught & toxic) > 0.6 * len(toxic) and len(caught - toxic) < 0.1 * len(texts)
