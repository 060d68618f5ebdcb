"""Toxic passages by maximum-scoring segments of token log-odds.

Learning counts, in labelled training documents, how many toxic and other documents hold a feature: a word, or
the first 4, 5 or 6 letters of one, so that inflected forms never seen share their stem's evidence. Near copies
weigh as one document together: a document's weight is one over the number of training documents of its label
that share a least four-word hash, the largest of four such shares; none is left out. Log-odds with a Dirichlet
prior (its weights follow the features' overall counts) and their z-scores give the lexicon; a word scores as its
most specific significant feature, less a drift that makes ordinary text negative.

Scoring runs the linear-time search for all maximal scoring segments over a text's words. Under the null a
text of n words has about K n exp(-lambda S) segments of score S or more. Segments with a small expected count are
significant passages, their negative log expectations add up to the document's evidence, and a monotone fit turns
evidence into a probability. lambda, K and the fit come from training documents scored by a lexicon that
`PARTS` - 1 in `PARTS` of the others taught: parts are dealt by a least four-word hash, so that near copies fall together.

The sample: at most `sample` labelled documents (all, if there are no more), chosen by a hash of doc_id, and a
lexicon of at most `lexicon` features, the most significant; both only bound the model. Every text is scored
whole. Null texts are empty; an empty text has no evidence and the lowest score, and a long one is scanned in one
pass. Labels that repeat a doc_id count as toxic if one is; null labels and null ids teach nothing, and each row
of documents that repeats a labelled doc_id teaches. Without any toxic training document all scores are 0. An
empty table has no rows. Of documents only doc_id and text are read; other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_texts, read, release, slices, text_or_empty
from tessella.llm.near_dedup import FACTORS, mixed, shingle_sets

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
STEMS = (6, 5, 4)
PRIOR, LEAST_Z, STRONG, DRIFT, TOP, LOW = 0.02, 4.0, 3.9, 0.15, 6.0, -3.0
LOG_SIGNIFICANT = math.log(0.05)
BIN, BINS = 0.25, 400
#: Least hashes that tell near copies of training documents, and the units of a document's weight.
HASHES, UNIT = 4, 64
#: Parts of the training documents, each scored by what the others teach.
PARTS = 5


def features(word: str) -> list[str]:
    """The word and its stems, the most specific first."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    #: Probability by evidence bin.
    curve: list[float] = field(default_factory=lambda: [0.0] * BINS)

    def log_expectation(self, score: float, n: int) -> float:
        return math.log(self.k * n) - self.lam * score

    def evidence(self, segments: list[float], n: int) -> float:
        found = [-e for s in segments if (e := self.log_expectation(s, n)) <= LOG_SIGNIFICANT]
        return math.fsum(found) if found else 0.001 * max(segments, default=0.0)

    def probability(self, evidence: float) -> float:
        at = min(evidence / BIN, BINS - 1.001)
        low = int(at)
        fit = self.curve[low] + (self.curve[low + 1] - self.curve[low]) * (at - low)
        return 0.98 * fit + 0.02 * evidence / (1 + evidence) * (max(self.curve) > 0)


class WordScores(dict):
    """Scores of white-space tokens in lower case; a bounded cache over the lexicon."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores

    def __missing__(self, token: str) -> float:
        if len(self) > 200_000:
            self.clear()
        get = self.scores.get
        best = LOW
        for word in WORD.findall(token) or [""]:
            best = max(best, next((s for f in features(word) if (s := get(f)) is not None), 0.0))
        value = self[token] = min(TOP, best) - DRIFT
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), after Ruzzo and Tompa, in linear time.

    A candidate keeps the place of the last one before it that starts at a lower total: those between need no look.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    befores, afters = total[positive].tolist(), total[positive + 1].tolist()
    segments: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, last lower one
    for i, before, after in zip(positive.tolist(), befores, afters):
        start, end = i, i + 1
        j = len(segments) - 1
        while True:
            while j >= 0 and segments[j][2] >= before:
                j = segments[j][4]
            if j < 0 or segments[j][3] >= after:
                break
            start, _, before, _, lower = segments[j]
            del segments[j:]
            j = lower
        segments.append((start, end, before, after, j))
    return [(a, b, y - x) for a, b, x, y, _ in segments]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample: int) -> DataFrame:
    """(text, toxic, keys) of the training sample. The sampled labels are few by the bound, and so broadcast.

    keys: for each of `HASHES` hashes the least one among the text's runs of four words, mixed with the label.
    """
    usable_labels = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable_labels.count()
    if n > sample:
        share = int(2**32 * sample / n * 0.98)
        usable_labels = usable_labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < share)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(usable_labels), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for shingles, toxic in zip(shingle_sets(batch.column(0).to_pylist(), 4), batch.column(1).to_pylist()):
            low = [int((mixed(shingles * FACTORS[k])).min()) if len(shingles) else 0 for k in range(HASHES)]
            keys.append([(x ^ (2 * k + toxic) * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for k, x in enumerate(low)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["text", "toxic", "keys"])

    return map_texts(rows, lambda: run, "text string, toxic boolean, keys array<long>")


def class_sizes(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys that several training rows have, sorted, and how many have each (at most `HASHES` x sample)."""
    found = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def weight(keys: list[int], sizes: tuple[np.ndarray, np.ndarray]) -> int:
    """A row's weight in `UNIT`s: one over the size of the smallest class it is in."""
    known, n = sizes
    if not len(known):
        return UNIT
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return max(1, round(UNIT / np.where(known[at] == keys, n[at], 1).min()))


def part_of(keys: list[int]) -> int:
    return keys[0] % PARTS


def feature_counts(rows: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(feature, part, n0, n1): the summed weights of rows of each label that hold the feature, by part."""
    shared = rows.sparkSession.sparkContext.broadcast(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], dict[str, int]] = {(part, toxic): defaultdict(int) for part in range(PARTS) for toxic in (False, True)}

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(PARTS):
                zero, one = counts[k, False], counts[k, True]
                names = [*(zero.keys() | one.keys())]
                columns = [pa.array(names, pa.string()), pa.array([k] * len(names), pa.int32()), *(pa.array([c.get(f, 0) for f in names], pa.int64()) for c in (zero, one))]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "part", "n0", "n1"])
            for c in counts.values():
                c.clear()

        for batch in batches:
            for rows_of in slices(batch, "text"):
                for text, toxic, keys in zip(*(c.to_pylist() for c in rows_of.columns)):
                    own, w = counts[part_of(keys), toxic], weight(keys, shared.value)
                    for f in {f for word in {*WORD.findall(text.lower())} for f in features(word)}:
                        own[f] += w
            if sum(map(len, counts.values())) > 200_000:
                yield from flush()
        yield from flush()
        release()

    return rows.mapInArrow(run, "feature string, part int, n0 long, n1 long").groupBy("feature", "part").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def log_odds(counts: DataFrame, lexicon: int) -> dict[str, float]:
    """The most significant features with their log-odds."""
    counts = counts.groupBy("feature").agg((F.sum("n0") / UNIT).alias("n0"), (F.sum("n1") / UNIT).alias("n1"))
    n0, n1 = (x or 0 for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        return {}
    mass, prior = PRIOR * (n0 + n1), PRIOR * (F.col("n0") + F.col("n1"))
    a, b = F.col("n1") + prior, F.col("n0") + prior
    delta = F.log(a / (n1 + mass - a)) - F.log(b / (n0 + mass - b))
    scored = counts.filter("n0 + n1 >= 3").select("feature", delta.alias("s"), (F.abs(delta) / F.sqrt(1 / a + 1 / b)).alias("z"))
    rows = scored.filter((F.col("z") >= LEAST_Z) | (F.col("z") >= LEAST_Z / 2) & (F.col("s") >= STRONG)).orderBy(F.desc("z"), "feature").limit(lexicon).collect()
    return {r["feature"]: max(LOW, min(TOP, r["s"])) for r in rows}


def root(histogram: dict[float, float]) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1."""
    scores = np.array([*histogram])
    weights = np.array([*histogram.values()]) / sum(histogram.values())
    low, high = 1e-3, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float(weights @ np.exp(middle * scores)) < 1 else (low, middle)
    return low


def monotone(ones: np.ndarray, zeros: np.ndarray) -> list[float]:
    """Isotonic regression of label shares over bins; empty bins take their neighbours' values."""
    pools: list[list[float]] = []  # ones, all, bins
    for a, b in zip(ones, ones + zeros):
        pools.append([float(a), float(b), 1])
        while len(pools) > 1 and (not pools[-1][1] or not pools[-2][1] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            a, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + n]
    return [x for a, b, n in pools for x in [(a + 0.5 * (a > 0)) / (b + 1)] * int(n)]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 200_000, lexicon: int = 50_000) -> Model:
    rows = cut(training_rows(docs, labels, usable, sample))
    counts = cut(feature_counts(rows, class_sizes(rows)))
    model = Model(log_odds(counts, lexicon))
    if not model.scores:
        return model
    # a row is scored by what the other parts teach
    shared = docs.sparkSession.sparkContext.broadcast([log_odds(counts.filter(F.col("part") != k), lexicon) for k in range(PARTS)])

    def scan():
        known = [WordScores(scores) for scores in shared.value]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for text, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = text.lower().split()
                scores = np.fromiter(map(known[part_of(keys)].__getitem__, words), np.float64, len(words))
                at, n = np.unique(np.round(scores, 1), return_counts=True)
                for column, value in zip(out, (len(words), [s for _, _, s in maximal_segments(scores)], at.tolist(), n.tolist())):
                    column.append(value)
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.list_(pa.int64()))], ["toxic", "n", "segments", "at", "times"])

        return run

    scanned = cut(map_texts(rows, scan, "toxic boolean, n long, segments array<double>, at array<double>, times array<long>"))
    null = scanned.filter("not toxic")
    # at most a hundred score values: scores are cut off on both sides and rounded
    histogram = {r["p"]["at"]: float(r["n"]) for r in null.select(F.explode(F.arrays_zip("at", "times")).alias("p")).groupBy("p.at").agg(F.sum("p.times").alias("n")).select(F.struct("at").alias("p"), "n").collect()}
    for s in np.arange(0.1, TOP, 0.1).round(1).tolist():
        histogram[s] = histogram.get(s, 0.0) + 0.02
    model.lam = root(histogram)
    words, segments = null.agg(F.sum("n"), F.sum(F.size(F.filter("segments", lambda s: s >= 1.0)))).first()
    model.k = ((segments or 0) + 1) * math.exp(model.lam) / max(1, words or 0)

    each = F.transform("segments", lambda s: F.log(F.lit(model.k) * F.col("n")) - model.lam * s)
    evidence = F.aggregate(F.filter(each, lambda e: e <= LOG_SIGNIFICANT), F.lit(0.0), lambda a, e: a - e)
    binned = scanned.select("toxic", F.least(F.floor(evidence / BIN), F.lit(BINS - 1)).cast("int").alias("bin")).groupBy("toxic", "bin").count().collect()
    table = np.zeros((2, BINS))
    for r in binned:
        table[int(r["toxic"]), r["bin"]] += r["count"]
    model.curve = monotone(table[1], table[0])
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages (code-point start and end, segment score, p-value) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = WordScores(shared.value.scores)
        m = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            probabilities, passages = [], []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                found = maximal_segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                probabilities.append(m.probability(m.evidence([s for _, _, s in found], len(words))))
                found = [(a, b, s, math.exp(e)) for a, b, s in found if (e := m.log_expectation(s, len(words))) <= LOG_SIGNIFICANT]
                if found:
                    spans = [x.span() for x in TOKEN.finditer(text)]
                    passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "p_value": -math.expm1(-e)} for a, b, s, e in found])
                else:
                    passages.append([])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

        return run

    return map_texts(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), make, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,p_value:double>>")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ~held_out()))
    at = docs.columns.index("text")

    def make():
        m = shared.value
        known = WordScores(m.scores)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for text in batch.column(at).to_pylist():
                words = (text or "").lower().split()
                found = maximal_segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                keep.append(m.probability(m.evidence([s for _, _, s in found], len(words))) < threshold)
            return batch.filter(pa.array(keep, pa.bool_()))

        return run

    return map_texts(docs, make, docs.schema)


def held_out() -> Column:
    """Rows that teach nothing: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of each row of docs, learned from labels (doc_id, toxic)."""
    model = learn(docs, labels, ~held_out())
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, with how many significant passages it has."""
    found = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("n_passages", F.size("passages")).drop("passages")
