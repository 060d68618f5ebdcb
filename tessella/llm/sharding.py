"""Minimax contiguous sharding of ordered atomic groups.

Equal texts are one group. Groups are ordered by a 64-bit hash of the text; the first `bits` bits of it make
the atoms, at most 2**bits whatever the input, so that a group is never cut. The driver gets the size of each
atom, binary-searches the smallest capacity with which a greedy pass needs no more shards than allowed, and
cuts there. Rows find their shard from the cuts alone. A group is atomic: one that is larger than an even
share has a shard of its own, larger than the others, which share the rest evenly.

Nulls count as empty texts. A row with a null doc_id is placed like any other. Rows that agree in doc_id and
text take neighbouring slots in an arbitrary order. An empty table gives no row. A long text is a group like any
other. Of documents only doc_id and text are read; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, ranked, read, text_or_empty


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Where each shard ends (in atoms) if each takes as many atoms as it can; None if `shards` aren't enough."""
    cuts, done = [], 0
    for _ in range(shards):
        cuts.append(int(np.searchsorted(ends, done + capacity, side="right")))
        if cuts[-1] == len(ends):
            return cuts
        if cuts[-1] == (cuts[-2] if len(cuts) > 1 else 0):
            return None
        done = int(ends[cuts[-1] - 1])
    return None


def cut_apart(sizes: np.ndarray, alone: list[int], shards: int, most: int) -> tuple[int, list[int]] | None:
    """The smallest capacity, and the ends of the shards, if each atom of alone is a shard; None if `most` isn't enough."""
    edges = [-1, *alone, len(sizes)]
    stretches = [(a + 1, b) for a, b in zip(edges, edges[1:]) if a + 1 < b]

    def cuts(capacity: int) -> list[int] | None:
        out: list[int] = []
        for a, b in stretches:
            part = greedy(np.cumsum(sizes[a:b], dtype=np.int64), capacity, shards - len(alone) - len(out))
            if part is None:
                return None
            out += [a + c for c in part]
        return sorted([*out, *(k + 1 for k in alone)])

    if cuts(most) is None:
        return None
    low, high = 0, most
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if cuts(middle) else (middle + 1, high)
    return low, cuts(low)


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the ends of the shards, for ordered sizes.

    An atom above the even share of what is left gets a shard of its own, if that needs no larger capacity, and
    the stretches around it are cut anew over the other shards. All shards are used if there are atoms enough.
    """
    if not len(sizes):
        return 0, []
    capacity, cuts = cut_apart(sizes, [], shards, int(sizes.sum()))
    alone: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        rest = int(sizes.sum()) - int(sizes[alone].sum())
        found = cut_apart(sizes, sorted([*alone, k]), shards, capacity) if int(sizes[k]) * (shards - len(alone)) > rest else None
        if found is None:
            break
        alone, cuts = sorted([*alone, k]), found[1]
    while len(cuts) < min(shards, len(sizes)):
        ends = np.cumsum(sizes, dtype=np.int64)
        spans = [(a, b) for a, b in zip([0, *cuts], cuts) if b - a > 1]
        a, b = max(spans, key=lambda x: int(sizes[x[0] : x[1]].sum()))
        start = int(ends[a - 1]) if a else 0
        at = a + int(np.argmin(np.abs(2 * (ends[a : b - 1] - start) - (int(ends[b - 1]) - start)))) + 1
        cuts = sorted([*cuts, at])
    return capacity, cuts


def shard(rows: DataFrame, group_hash: str, size: str, order: list[str], shards: int = 24, bits: int = 18) -> DataFrame:
    """Add shard and slot to rows; group_hash is a long that equal groups share, size the row's size."""
    atom = F.shiftrightunsigned(group_hash, 64 - bits)
    atoms = rows.groupBy(atom.alias("atom")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).toPandas().sort_values("atom")
    _, cuts = minimax_cuts(atoms["bytes"].to_numpy(np.int64), shards)
    keys, ends = atoms["atom"].to_numpy(np.int64), np.cumsum(atoms["n"].to_numpy(np.int64))
    firsts = [int(keys[c]) for c in cuts[:-1]]
    starts = [0, *(int(ends[c - 1]) for c in cuts)]
    counts = {k: b - a for k, (a, b) in enumerate(zip(starts, starts[1:]))}
    at = sum((F.when(atom >= k, 1).otherwise(0) for k in firsts), F.lit(0)).cast("int")
    return ranked(rows.withColumn("shard", at), "shard", counts, order, "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    text = text_or_empty()
    rows = cut(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_hash")))
    return shard(rows, "_hash", "size", ["doc_id", "_hash"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
