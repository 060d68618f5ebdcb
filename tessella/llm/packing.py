"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most `capacity` tokens. Only how many pieces each length has (at most `capacity`
numbers) goes to the driver, which packs counts instead of pieces: lengths from long to short, each into the
fullest sequences that still have room, whole runs of equal sequences at a time. The plan is a bounded table of
runs; a piece takes its slot by joining on its length and its rank among the pieces of that length.

Nulls are empty texts, which are one end-of-text token. Repeated rows are packed as often as they come; rows
that agree in doc_id and piece take slots in an arbitrary order. An empty table has no rows. A long text is encoded
whole and cut into pieces. Of documents only doc_id and text are read; other columns may have any names.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_texts, ranked, read, text_or_empty

#: Chunks that a task keeps with their ids, and the longest one kept.
CACHE_CHUNKS, LONGEST_KEPT = 400_000, 32
#: New chunks that the library encodes at a time: it takes much memory for each token.
TOGETHER = 8000
#: Bytes of text that are encoded at a time: each distinct chunk of them is looked up once.
SLICE = 2 << 20
#: A space that something else than one word's character may follow (more than the vocabulary's white space).
RUN = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"
#: A space before which the vocabulary's word pattern always ends a word.
EDGE = re.compile(r" (?=\S)")


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> tuple:
    """The library's tokenizer, the bytes of each token (one symbol a byte) and the special tokens."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ids = library.get_vocab()
    lengths = np.zeros(max(ids.values()) + 1, np.int64)
    lengths[list(ids.values())] = [len(t) for t in ids]
    return library, lengths, [t.content for t in library.get_added_tokens_decoder().values()]


class IdBytes:
    """Texts' ids as little-endian unsigned 32-bit integers.

    No word of the vocabulary's pattern reaches over a space that something other than white space follows, so a
    text is encoded as the chunks between such spaces. New chunks are encoded together by the library, as one
    text, and cut apart again by the lengths of their tokens; a bounded number of short ones is kept.
    """

    def __init__(self, path: str):
        self.library, self.lengths, self.special = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each chunk with the space before it."""
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum(pc.binary_length(pa.array(chunks, pa.string())).to_numpy() + 1, dtype=np.int64)
        at = np.searchsorted(ends, wanted)
        if len(ids) == 0 or at[-1] >= len(ends) or (ends[at] != wanted).any():
            raise ValueError("a token reaches over a word's edge: the vocabulary isn't byte-level")
        data, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return {c: data[x:y] for c, x, y in zip(chunks, cuts, cuts[1:])}

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks with the space before it."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if len(known) + len(new) > CACHE_CHUNKS:
            kept = {c: known[c] for c in chunks if c in known}  # what these texts use is likely to come again
            known.clear()
            known.update(kept)
        for k in range(0, len(new), TOGETHER):
            known.update(self.fresh(new[k : k + TOGETHER]))
        out = [*map(known.__getitem__, chunks)]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del known[c]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        special = np.zeros(len(texts), bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False) & ~special
        lists = pc.split_pattern(pc.if_else(pa.array(special | runs), "", texts), " ")
        distinct = lists.flatten().dictionary_encode()
        index, chunks = distinct.indices.to_numpy().astype(np.int64), distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        ends = lists.offsets.to_numpy()
        heads = ends[:-1]
        # the chunk before a text's first edge has no space before it
        own = [self.ids(chunks[k]) for k in index[heads].tolist()]
        index[heads] = len(chunks) + np.arange(len(own))
        used = np.zeros(len(chunks) + len(own), bool)
        used[index] = True
        spaced = iter(self.lookup([c for c, u in zip(chunks, used.tolist()) if u]))
        found = [*(next(spaced) if u else b"" for u in used[: len(chunks)].tolist()), *own]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        n = sizes[index]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[index] - before[:-1], n) + np.arange(before[-1])].tobytes()
        cuts = (4 * before[ends]).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(special).tolist():
            out[k] = self.ids(texts[k].as_py())
        for k in np.flatnonzero(runs).tolist():
            head, *rest = EDGE.split(texts[k].as_py())
            each = [*{*rest}]
            held = dict(zip(each, self.lookup(each)))
            out[k] = self.ids(head) + b"".join(map(held.__getitem__, rest))
        return out


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document of more than `capacity` tokens is cut so that all its pieces but the first are full.
    """

    def make():
        tok = IdBytes(path)
        end = np.array([end_id], "<u4").tobytes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, data in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1))):
                data += end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]))):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return run

    return map_texts(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), make, "doc_id long, piece int, start long, length long, ids_crc32 long", most=SLICE)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first sequence, pieces a sequence, offset).

    Runs of sequences with the same free room are filled together. A sequence takes as many pieces of a
    length as fit, as best fit does, since what it has left after one is the tightest room for the next.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left and room < capacity:
            if not free[room]:
                room += 1
                continue
            first, n = free[room].pop()
            each = min(room // length, left)
            take = min(n, left // each)
            if take < n:
                free[room].append((first + take, n - take))
            rows.append((length, rank, rank + take * each, first, each, capacity - room))
            free[room - each * length].append((first, take))
            left, rank = left - take * each, rank + take * each
        each = capacity // length
        for n, k in ((left // each, each), (1, left % each)):
            if left and n and k:
                rows.append((length, rank, rank + n * k, sequences, k, 0))
                free[capacity - k * length].append((sequences, n))
                sequences, rank = sequences + n, rank + n * k
    return rows


def pack(piece_rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    spark = piece_rows.sparkSession
    counts = {r["length"]: r["count"] for r in piece_rows.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length long, _lo long, _hi long, _sequence long, _each long, _offset long")
    at = ranked(piece_rows, "length", counts, ["doc_id", "piece"], "_rank")
    place = F.col("_rank") - F.col("_lo")
    return (
        at.join(F.broadcast(slots), (at["length"] == slots["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .drop(slots["length"])
        .withColumn("sequence_id", F.col("_sequence") + F.floor(place / F.col("_each")))
        .withColumn("offset", F.col("_offset") + place % F.col("_each") * F.col("length"))
        .drop("_rank", "_lo", "_hi", "_sequence", "_each", "_offset")
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    import public_tokenizers

    return pack(cut(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), capacity)), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2,048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))
