"""Phrases whose words stand together: counted by automata of the candidates that a sketch leaves, scored by their weakest cut.

Texts are lower-cased (A-Z), split at punctuation and line breaks into pieces and those at blanks and tabs into words. f is how
often a phrase of up to `longest` words stands within pieces, overlaps included, in texts of one language.

1. Sketch. Each run of words is one 64-bit hash with its language, whose leading bits name its counter. There is
   a counter for every letter of input or more, so the sketch is never held whole: tasks send the counters they touch, cut off
   at the threshold, to the shard that owns them, and a shard adds up its own. A counter's sum is at least the
   count of each phrase in it.
2. Candidates. Counters that reach the threshold become one bit each in a bitmap of `per_counter` bits for each of them
   (at most 2**`most_bits` bits: beyond, more phrases pass that needn't, and none is lost). The bitmap is broadcast.
3. Scan. A task compiles the phrases of a shard of texts that pass the bitmap into an automaton. Its patterns
   and the text have one blank as delimiter around each word, and a piece's end is a word of its own, so that a match is whole words of
   one piece; matches overlap. Counts are summed over shards, and the threshold is applied to the sums.
4. Scores, from tables of counts alone. Cuts look up their two sides by joins, which Spark splits where a side is very
   frequent; the best rows of a language come from the best ones of its salted parts.

Null texts are empty, a null lang is `und`. Ties in score and count go to the smaller phrase in UTF-8 order. Repeated rows count
each. An empty table has no phrases. A text may be of any length: a shard is cut within a text too. Only text and lang
are read; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, read, release, short_batches, text_or_empty
from tessella.llm.substring_dedup import MULTIPLIERS, mixed

#: The bytes that end a piece become this one, as a word of its own: no word can hold it.
PIECE_END = b"."
DELIMITERS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"." * 10 + b" ")
#: Hashes that a task holds before it sends their counters.
HELD = 1 << 22
#: Bytes of texts of one language that make a shard, words that it has at most, and bytes that a task holds of all languages.
SHARD_BYTES, SHARD_WORDS, ALL_BYTES = 2 << 20, 400_000, 8 << 20
#: Phrases whose counts a task adds up before it sends them.
ADDED = 400_000


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of all texts in order, with piece ends between pieces and texts."""
    return b"\n".join(texts).lower().translate(DELIMITERS).replace(PIECE_END, b" . ").split()  # white space but blanks is gone by now


class WordHashes(dict):
    """Numbers distinct words from 0 and keeps a 64-bit hash of each."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


class Shard:
    """Words of one language with the hashes of all runs of 1 to `longest` of them that stand within a piece."""

    def __init__(self, words: list[bytes], seed: int, longest: int):
        self.words = words
        seen = WordHashes()
        end = seen[PIECE_END]
        ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        table = np.array(seen.hashes, np.uint64)[ids]
        inside = ids != end
        self.n = int(inside.sum())
        total, fine = np.full(len(ids), np.uint64(seed)), np.ones(len(ids), bool)
        self.starts, self.hashes = [], []
        for k in range(longest):
            m = max(0, len(ids) - k)
            total, fine = total[:m] + table[k:] * MULTIPLIERS[0, k + 64], fine[:m] & inside[k:]
            at = np.flatnonzero(fine)
            self.starts.append(at)
            self.hashes.append(mixed(mixed(total[at]) * MULTIPLIERS[1, k + 64]))


def shards(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, Shard, list[bytes]]]:
    """The texts (lang, text) of a task as (language, shard, tail): what stands in the tail, up to longest - 1 words
    that the next shard begins with, counts there."""
    held: dict[str, tuple[list[bytes], list[int]]] = {}

    def cut_up(lang: str) -> Iterator[tuple[str, Shard, list[bytes]]]:
        words, seed = tokens(held.pop(lang)[0]), xxhash.xxh3_64_intdigest(lang.encode(), 1)
        for start in range(0, len(words), SHARD_WORDS):
            end = start + SHARD_WORDS
            yield lang, Shard(words[start : end + longest - 1], seed, longest), words[end : end + longest - 1]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            texts, size = held.setdefault(lang, ([], [0]))
            texts.append(text.as_py().encode())
            size[0] += len(texts[-1])
            if size[0] >= SHARD_BYTES:
                yield from cut_up(lang)
            elif sum(n for _, (n,) in held.values()) >= ALL_BYTES:
                yield from cut_up(max(held, key=lambda x: held[x][1][0]))
    for lang in [*held]:
        yield from cut_up(lang)


def heavy_counters(texts: DataFrame, longest: int, least: int, bits: int, shard_bits: int) -> DataFrame:
    """(shard, counters): the sketch's counters that reach the least count, as packed 32-bit offsets in their shard."""
    shift, mask = np.uint64(64 - bits), np.uint64((1 << (bits - shard_bits)) - 1)

    def send(hashes: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(hashes or [np.zeros(0, np.uint64)]) >> shift, return_counts=True)
        owner, first = np.unique(at >> np.uint64(bits - shard_bits), return_index=True)
        at, n = (at & mask).astype("<u4"), np.minimum(n, least).astype(np.uint8)
        ends = [*first[1:].tolist(), len(at)]
        spans = list(zip(first.tolist(), ends))
        return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], ["shard", "counters", "counts"])

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, shard, tail in shards(batches, longest):
            held += shard.hashes  # a tail's runs are counted twice, which a bound may be
            size += sum(map(len, shard.hashes))
            if size >= HELD:
                yield send(held)
                held, size = [], 0
        yield send(held)
        release()

    def add(key: tuple, table: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(table["counters"].to_pylist()), "<u4")
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        heavy = at[first][np.add.reduceat(n[order].astype(np.int64), first) >= least]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "counters": pa.array([heavy.tobytes()], pa.binary())})

    return texts.mapInArrow(touch, "shard int, counters binary, counts binary").groupBy("shard").applyInArrow(add, "shard int, counters binary")


def candidate_bitmap(heavy: DataFrame, bits: int, shard_bits: int, per_counter: int, most_bits: int) -> tuple[np.ndarray, int]:
    """A bitmap of hashes' leading bits under which a heavy counter stands, and how many bits it takes."""
    n = (heavy.agg(F.sum(F.octet_length("counters"))).first()[0] or 0) // 4
    size = min(bits, max(shard_bits + 3, min(most_bits, int(np.ceil(np.log2(max(1, per_counter * n)))))))
    down = np.uint32(bits - size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for counters in batch.column(1).to_pylist():
                block = np.zeros(1 << (size - shard_bits), bool)
                block[np.frombuffer(counters, "<u4") >> down] = True
                blocks.append(np.packbits(block).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], ["shard", "block"])

    bitmap = np.zeros((1 << size) // 8, np.uint8)
    width = len(bitmap) >> shard_bits
    for r in heavy.mapInArrow(pack, "shard int, block binary").toLocalIterator():
        bitmap[r["shard"] * width : (r["shard"] + 1) * width] = np.frombuffer(r["block"], np.uint8)
    return bitmap, size


def counted(shard: Shard, tail: list[bytes], bitmap: np.ndarray, size: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, words, count) of the shard's phrases that pass the bitmap, by an automaton over its text."""
    text, patterns, sizes = (b" %b " % b" ".join(shard.words)).decode(), [], []
    words = text.split(" ")[1:-1]
    for k, (at, hashes) in enumerate(zip(shard.starts, shard.hashes), 1):
        place = hashes >> np.uint64(64 - size)
        passes = (bitmap[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0
        _, first = np.unique(hashes[passes], return_index=True)
        patterns += [" ".join(words[i : i + k]) for i in at[passes][first].tolist()]
        sizes += [k] * len(first)
    if not patterns:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, pattern in enumerate(patterns):
        automaton.add_word(f" {pattern} ", i)
    automaton.make_automaton()

    def matches(where: str) -> np.ndarray:
        return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(where)), np.int64), minlength=len(patterns))

    counts = matches(text)
    if tail:
        counts -= matches(f" {b' '.join(tail).decode()} ")
    yield from ((p, k, n) for p, k, n in zip(patterns, sizes, counts.tolist()) if n)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, per_counter: int = 16, most_bits: int = 30) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of 1 to `longest` words with f >= least, and of each language's word count (words: 0)."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about a run of words for every two letters and length: twice as many counters; a shard has half a million of them or so
    bits = max(16, int(np.ceil(np.log2(max(1, letters * longest)))))
    shard_bits = max(3, bits - 22)
    heavy = cut(heavy_counters(texts, longest, least, bits, shard_bits))
    bitmap, size = candidate_bitmap(heavy, bits, shard_bits, per_counter, most_bits)
    shared = spark.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str, int], int] = {}

        def send() -> pa.RecordBatch:
            keys = list(zip(*totals)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()), pa.array(keys[2], pa.int32()), pa.array(list(totals.values()), pa.int64())], ["lang", "phrase", "words", "f"])

        for lang, shard, tail in shards(batches, longest):
            totals[lang, "", 0] = totals.get((lang, "", 0), 0) + shard.n - sum(w != PIECE_END for w in tail)
            for phrase, k, n in counted(shard, tail, shared.value, size):
                key = lang, phrase, k
                totals[key] = totals.get(key, 0) + n
            if len(totals) >= ADDED:
                yield send()
                totals.clear()
        yield send()
        totals.clear()
        release()

    each = texts.mapInArrow(scan, "lang string, phrase string, words int, f long")
    return each.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))


def first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def last_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, most: int = 2000, salts: int = 32) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    counts = cut(phrase_counts(docs, longest, least))
    of = lambda name: counts.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f"f_{name}"))
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = []
    for k in range(1, longest):
        longer = found.filter(F.col("words") > k)
        sides = longer.withColumn("left", first_words(F.col("phrase"), k)).withColumn("right", F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)"))
        both = sides.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"])
        whole = (F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")).alias("top")
        scored = both.select("lang", "phrase", "a", F.col("f_left").alias("l"), F.col("f_right").alias("r"), whole, (exact("f_left") * exact("f_right")).alias("bottom"))
        cuts.append(scored.withColumn("score", F.expr("top div bottom")).withColumn("k", F.lit(k)).drop("top", "bottom"))
    each = cuts[0]
    for other in cuts[1:]:
        each = each.union(other)
    low = each.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate that holds a phrase, over all shorter runs of its words
    inner = None
    for words in range(3, longest + 1):
        for k in range(2, words):
            for start in range(words - k + 1):
                run = found.filter(F.col("words") == words).select("lang", last_words(first_words(F.col("phrase"), start + k), k).alias("phrase"), "a")
                inner = run if inner is None else inner.union(run)
    if inner is not None:
        held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
        low = low.join(held, ["lang", "phrase"], "left").filter(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a"))).drop("held")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = low.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    best = flat.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    sizes = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of two and three words that hold together best in each language."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), g AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 10
), x AS (
  SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS before, array_to_string(words[cut + 1 :], ' ') AS after FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), many AS (
  SELECT lang, phrase, f FROM f WHERE f >= 10
), s AS (
  SELECT x.lang, x.phrase, a, cut, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM x JOIN many l ON l.lang = x.lang AND l.phrase = before JOIN many r ON r.lang = x.lang AND r.phrase = after
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), h AS (
  SELECT lang, array_to_string(words[i : i + 1], ' ') AS phrase, max(a) AS held FROM (SELECT lang, words, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY 1, 2
)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
FROM low JOIN n ON n.lang = low.lang LEFT JOIN h ON h.lang = low.lang AND h.phrase = low.phrase
WHERE held IS NULL OR 100 * held < 50 * a
QUALIFY rank <= 2000
"""
