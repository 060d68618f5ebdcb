"""Exact removal of repeated word windows behind a count-min prefilter.

A window is `width` consecutive words of one document; its anchor is the least hash among its runs of `GRAM`
words. Equal windows have equal anchors at different places, so a window can only repeat if its anchor does. The
first pass counts anchors (about a seventh as many as words) in count-min sketches, one a task, whose merged
counters overestimate each anchor's count; a window whose anchor some row of the sketch counts once is unique
and needs nothing more. The second pass groups the others exactly, by a 96-bit fingerprint of the window, and
keeps where each starts first. In the third pass each document removes the words covered by its
repeated-looking windows except where such a window has its first start: a window that only looked repeated is
its own first start, so the prefilter's errors cost work, never words.

The sketch's width follows the input (about `load` counters an anchor) up to 2**`most_bits`; beyond, it filters
less and the exact pass takes more rows. Only the merged sketch's one bit a counter goes through the driver.

Order: smaller doc_id, then earlier start. Rows without doc_id come before all others, by a hash of their texts.
Rows with the same doc_id and the same text are one document: neither loses words to the other. Null texts are
empty and have no words; an empty table has no rows. A long text is one document like any other: its windows are
all rows of their own. Columns to carry may have any names, those of the result included (positions tell them apart).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_texts, read, release, slices, text_or_empty

ROWS, GRAM = 2, 8
BLOCK_BITS = 16


class Words(dict):
    """Numbers distinct words from 0 and keeps two independent 64-bit hashes of each."""

    def __init__(self):
        self.hashes: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append((xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word, 1)))
        return n


#: Odd multipliers of the two window hashes; drawn from a fixed seed.
MULTIPLIERS = np.random.default_rng(20).integers(0, 2**62, size=(2, 4096), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (a minimum or maximum) over each n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def windows(texts: list[bytes], width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text; of all windows in order two hashes and the anchor; each text's first window; all anchors by place."""
    seen = Words()
    split = [t.split() for t in texts]
    ids = np.fromiter((i for words in split for i in map(seen.__getitem__, words)), np.int64)
    table = np.array(seen.hashes, np.uint64).reshape(-1, 2)
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(counts)
    own = np.maximum(counts - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(own)])
    keep = np.repeat(ends - counts - first[:-1], own) + np.arange(first[-1])
    if not len(keep):
        none = np.zeros(0, np.uint64)
        return split, none, none, none, first, none

    def hashed(k: int, n: int) -> np.ndarray:
        word, whole = table[:, k][ids], len(ids) - n + 1
        total = np.zeros(whole, np.uint64)
        for j in range(n):
            total += word[j : j + whole] * MULTIPLIERS[k, j]
        return mixed(total)

    gram = min(GRAM, width)
    grams, span = hashed(0, gram), width - gram + 1
    least = sliding(grams, span, np.minimum)
    valid = np.zeros(len(least) + 2 * (span - 1), np.uint64)
    valid[keep + span - 1] = least[keep]
    anchors = grams[grams == sliding(valid, span, np.maximum)]
    return split, hashed(0, width)[keep], hashed(1, width)[keep], least[keep], first, anchors


def places(anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The anchor's counter in each row of the sketch."""
    shift = np.uint64(64 - bits)
    return [mixed(anchors * MULTIPLIERS[row, -1]) >> shift for row in range(ROWS)]


def sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """ROWS x 2**bits: whether a counter of the merged count-min sketch is over 1 (packed bits).

    Tasks send their sketch in blocks of counters, cut off at 2: two sketches' sum exceeds 1 just if the true sum
    does. A block is sent as the places of its counters, two bytes each, or as bits if it is fuller than that, so
    what is sent follows the anchors, however many tasks there are.
    """
    block = 1 << min(bits, BLOCK_BITS)
    spark = docs.sparkSession

    def packed(bitmap: np.ndarray) -> bytes:
        at = np.flatnonzero(np.unpackbits(bitmap)).astype("<u2").tobytes()
        return b"p" + at if len(at) < len(bitmap) else b"b" + bitmap.tobytes()

    def unpacked(data: bytes) -> np.ndarray:
        if data[:1] == b"b":
            return np.frombuffer(data, np.uint8, offset=1)
        out = np.zeros(block, np.uint8)
        out[np.frombuffer(data, "<u2", offset=1)] = 1
        return np.packbits(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bit a counter for "at least 1" and one for "at least 2"
        once, twice = np.zeros((2, ROWS, (1 << bits) // 8), np.uint8)
        for batch in batches:
            for part in slices(batch, "text"):
                anchors = windows([t.encode() for t in part.column(0).to_pylist()], width)[-1]
                for one, two, at in zip(once, twice, places(anchors, bits)):
                    at, n = np.unique(at, return_counts=True)
                    byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)
                    again = (n > 1) | (one[byte] & bit > 0)
                    np.bitwise_or.at(two, byte[again], bit[again])
                    np.bitwise_or.at(one, byte, bit)
        for k, (one, two) in enumerate(zip(once.reshape(-1, block // 8), twice.reshape(-1, block // 8))):
            if one.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(one)], pa.binary()), pa.array([packed(two)], pa.binary())], ["block", "once", "twice"])
        del once, twice
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = unpacked(one), unpacked(two)
                if k in blocks:
                    a, b = blocks[k]
                    blocks[k] = (a | one, b | two | a & one)
                else:
                    blocks[k] = (one, two)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([*blocks], pa.int32()), pa.array([b.tobytes() for _, b in blocks.values()], pa.binary())], ["block", "repeated"])

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "block int, once binary, twice binary")
    merged = parts.repartition("block").mapInArrow(merge, "block int, repeated binary").collect()
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    for r in merged:
        out[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["repeated"], np.uint8)
    return out


def looks_repeated(bitmap: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for row, at in zip(bitmap.reshape(ROWS, -1), places(anchors, bits)):
        out &= (row[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return out


def kept_words(docs: DataFrame, width: int = 20, load: float = 2.0, most_bits: int = 26, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_words, n_removed and kept of each row.

    kept: the words left, joined by a space; with digest its SHA-256; with columns to carry, the text as it is
    if it loses no word.
    """
    spark = docs.sparkSession
    # what is carried gets names of its own, so that no column of docs can clash with those made here
    taken = {c: f"_c{k}" for k, c in enumerate(carry)}
    text = text_or_empty()
    unnamed = F.col("doc_id").isNull()
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.when(unnamed, F.xxhash64(text).bitwiseOR(1)).otherwise(0).alias("_sub"), text.alias("text"), *(F.col(f"`{c}`").alias(x) for c, x in taken.items())
    )
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(16, int(np.ceil(np.log2(max(1, load * letters / 42))))))
    shared = spark.sparkContext.broadcast(sketch(docs, width, bits))

    def suspects():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, h1, h2, anchor, first, _ = windows([t.encode() for t in batch.column(2).to_pylist()], width)
            hit = np.flatnonzero(looks_repeated(shared.value, anchor, bits))
            doc = np.searchsorted(first, hit, side="right") - 1
            owner = pa.array(doc)
            return pa.RecordBatch.from_arrays([pa.array(h1[hit].view(np.int64)), pa.array((h2[hit] >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(owner), batch.column(1).take(owner), pa.array((hit - first[doc]).astype(np.int32))], ["h1", "h2", "_id", "_sub", "start"])

        return run

    found = map_texts(docs.select("_id", "_sub", "text"), suspects, "h1 long, h2 int, _id long, _sub long, start int")
    low = found.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_sub", "start")).alias("at"))
    # dealt by document before the lists are made: rows are a third of the size of partial lists
    dealt = low.select("at._id", "at._sub", "at.start", "h1").repartition("_id", "_sub")
    firsts = dealt.groupBy("_id", "_sub").agg(F.collect_list(F.struct("start", "h1")).alias("firsts"))

    def remove():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            split, h1, _, anchor, first, _ = windows(texts, width)
            hit = looks_repeated(shared.value, anchor, bits)
            out: tuple[list, ...] = ([], [], [])
            lists = batch.column(2)
            for k, words in enumerate(split):
                own = hit[first[k] : first[k + 1]]
                gone = np.zeros(len(words) + 1, np.int64)
                if own.any():
                    own = own.copy()
                    if lists[k].is_valid:
                        flat = lists[k].values
                        start, h = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(np.uint64)
                        mine = start < len(own)  # rows may share a doc_id
                        start, h = start[mine], h[mine]
                        own[start[h1[first[k] + start] == h]] = False
                    at = np.flatnonzero(own)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                left = np.cumsum(gone)[:-1] == 0
                kept = texts[k] if carry and left.all() else b" ".join(words if left.all() else [w for w, x in zip(words, left.tolist()) if x])
                out[0].append(len(words))
                out[1].append(int(len(words) - left.sum()))
                out[2].append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["_id", *taken.values(), "_words", "_removed", "_kept"])

        return run

    joined = docs.join(firsts, ["_id", "_sub"], "left").select(F.when(F.col("_sub") == 0, F.col("_id")).alias("_id"), "text", "firsts", *taken.values())
    kinds = "".join(f"{x} {docs.schema[x].dataType.simpleString()}, " for x in taken.values())
    done = map_texts(joined, remove, f"_id long, {kinds}_words long, _removed long, _kept string")
    return done.select(F.col("_id").alias("doc_id"), *(F.col(x).alias(c) for c, x in taken.items()), F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept").alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its windows of 20 words that start earlier elsewhere."""
    return kept_words(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS k FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS s FROM w WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM later
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS p FROM w
), kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.p) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
