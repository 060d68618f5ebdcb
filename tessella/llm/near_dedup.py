"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document is its set of word shingles. Documents of equal sets are one class, joined once. Each class has
`BANDS` x `ROWS` MinHash samples: bands of equal samples make candidate pairs, and all samples are folded into
a parity bitmap (odd sketch); the bits set in the XOR of two bitmaps estimate how many samples differ. A bucket
of at most `SMALL` classes makes all its pairs; a larger one first pairs each class with the bucket's pivot, its
least class by a hash. The first `EARLY` bands are paired before the others, which then pair only classes that aren't
connected yet. Pairs of near enough sizes whose sketches are likely enough to be similar connect candidate
clusters. A larger bucket that still holds more than one cluster then compares the sketches of all its pairs across
clusters, block against block, and what it joins is one cluster. Inside a cluster links are decided exactly on full
sets, block against block, with no pair written but those that join two parts of the cluster.

At similarity 0.8 a pair misses all 40 bands of 5 samples with probability 1.3e-7, and a sketch underestimates
0.8 as below `LOOSE` with less than 1e-7; nothing else is approximate.

Null and empty texts, and texts without words, have an empty set and link with nothing. A text with fewer words
than a shingle is one shingle. A null doc_id is left out of the table of links and returned as a component of
its own; rows that repeat a doc_id share its component if their sets are linked and get the smallest otherwise. A long text
is one set like any other. An empty table has no rows. Of docs only doc_id and text are read; other columns may have
any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, map_texts, read, text_or_empty
from tessella.llm.components import components

BANDS, ROWS, SKETCH_BITS = 40, 5, 1024
SAMPLES = BANDS * ROWS
SMALL = 4
#: Estimated similarity below which a pair isn't compared exactly.
LOOSE = 0.62
#: Odd bits of two sketches above which a pair isn't compared exactly. Of k samples k * (1 - J) differ and toggle
#: two bits each; n * (1 - exp(-2 d / n)) / 2 bits are then odd.
MOST_ODD = int(SKETCH_BITS * (1 - np.exp(-4 * SAMPLES * (1 - LOOSE) / SKETCH_BITS)) / 2)
#: Bands whose pairs are made first.
EARLY = 8
#: Classes of a cluster that are compared in one task with as many others.
BLOCK = 1024
#: Sketches of a bucket that are compared in one task with as many others.
SKETCH_BLOCK = 4096
#: Bits of the map of clustered ids.
MEMBER_BITS = 24

_draw = np.random.default_rng(6)
FACTORS = _draw.integers(0, 2**62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 2**63, SAMPLES, dtype=np.uint64)
MIX = _draw.integers(0, 2**62, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str], shingle: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    known, out = WordHashes(), []
    for text in texts:
        data = text.encode()
        words = (data.lower() if lower else data).split()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if 0 < len(h) < shingle:
            total = np.full(1, len(h), np.uint64)
            for x in h:
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(total)
            continue
        n = max(0, len(h) - shingle + 1)
        total = np.zeros(n, np.uint64)
        for j in range(shingle):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        out.append(np.unique(total))
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[at : at + 2048, None] * FACTORS + OFFSETS).min(axis=0), out=low)
    return low


def describe(sets: list[np.ndarray]) -> tuple[list, list, np.ndarray, np.ndarray]:
    """For each set: two hashes of the whole set, its band keys, and its odd sketch (packed)."""
    mins = np.stack([samples(s) for s in sets]) if sets else np.zeros((0, SAMPLES), np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[ROWS], (len(sets), BANDS)).copy()
    for r in range(ROWS):
        keys = mixed(keys * MIX[r] + mins[:, r::ROWS])
    bit = (mixed(mins + np.arange(SAMPLES, dtype=np.uint64) * MIX[0]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    np.add.at(counts, (np.arange(len(sets))[:, None], bit), 1)
    whole = [(xxhash.xxh3_64_intdigest(s.tobytes()), xxhash.xxh3_64_intdigest(s.tobytes(), 1)) for s in sets]
    return [a for a, _ in whole], [b for _, b in whole], keys, np.packbits(counts & 1, axis=1)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1).to_pylist(), shingle)
            a, b, keys, odd = describe(sets)
            long = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), long(keys.reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), long(a), long(b), bands, pa.array([x.tobytes() for x in odd], pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bands", "odd"])

        return run

    return map_texts(docs, make, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, odd binary")


def likely(a: str, b: str) -> F.Column:
    """Whether two odd sketches estimate a similarity of LOOSE or more."""
    parts = [F.bit_count(F.element_at(a, k + 1).bitwiseXOR(F.element_at(b, k + 1))) for k in range(SKETCH_BITS // 64)]
    return sum(parts[1:], parts[0]) <= F.lit(MOST_ODD)


def first_edges(shared: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Distinct likely pairs (a, b) of class ids across labels: all of small buckets, those with the pivot of larger ones.

    shared: (key, id, n, h, label), the buckets of n > 1 classes; h is the least hash of an id.
    """
    pivots = shared.filter((F.col("n") > SMALL) & (F.xxhash64("id") == F.col("h"))).select("key", F.col("id").alias("p"), F.col("label").alias("other"))
    large = shared.filter(F.col("n") > SMALL).join(pivots, "key").filter("label <> other").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
    few = shared.filter(F.col("n") <= SMALL)
    small = few.select("key", F.col("id").alias("a"), F.col("label").alias("l")).join(few.select("key", F.col("id").alias("b"), F.col("label").alias("m")), "key").filter("l <> m")
    pairs = large.union(small.select("a", "b")).filter("a < b").distinct()
    one = classes.select(F.col("id").alias("a"), F.col("odd").alias("x"), F.col("n_shingles").alias("n"))
    other = classes.select(F.col("id").alias("b"), F.col("odd").alias("y"), F.col("n_shingles").alias("m"))
    near = 100 * F.least("n", "m") >= per_cent * F.greatest("n", "m")  # the smaller set over the larger bounds the similarity
    return pairs.join(one, "a").join(other, "b").filter(near & likely("x", "y")).select("a", "b")


def likely_parts(labels: np.ndarray, sizes: np.ndarray, odd: np.ndarray, half: np.ndarray | None, per_cent: int) -> list[tuple[int, int]]:
    """(least label, label) for each further label of each part that likely pairs across labels connect.

    half: pairs count only between its two values (None: all pairs).
    """
    order = np.argsort(sizes, kind="stable")
    labels, sizes, odd = labels[order], sizes[order], odd[order]
    half = half[order] if half is not None else None
    ends = np.searchsorted(sizes, sizes * 100 // per_cent, "right")
    _, root = np.unique(labels, return_inverse=True)
    for i, end in enumerate(ends.tolist()):
        others = root[i + 1 : end] != root[i]
        if half is not None:
            others &= half[i + 1 : end] != half[i]
        at = np.flatnonzero(others) + i + 1
        hit = at[np.bitwise_count(odd[at] ^ odd[i]).sum(axis=1, dtype=np.int64) <= MOST_ODD]
        for j in hit.tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    low = np.full(len(labels), np.iinfo(np.int64).max)
    np.minimum.at(low, root, labels)
    return sorted({(a, b) for a, b in zip(low[root].tolist(), labels.tolist()) if a != b})


def rest_edges(shared: DataFrame, classes: DataFrame, clusters: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of clusters (a lone class is its own) that some likely pair in a larger bucket joins."""
    large = shared.filter(F.col("n") > SMALL).select("key", "id").join(clusters, "id", "left")
    large = large.select("key", "id", F.coalesce("component", "id").alias("label"))
    mixed_up = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = large.join(mixed_up.select("key", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("blocks")), "key")
    rows = rows.join(classes.select("id", "n_shingles", "odd"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(key, table):
        table = table.combine_chunks()
        odd = table["odd"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64)
        half = table["own"].to_numpy() if key[1].as_py() != key[2].as_py() else None
        pairs = likely_parts(table["label"].to_numpy(), table["n_shingles"].to_numpy(), odd, half, per_cent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return dealt.select("key", "i", "j", "own", "label", "n_shingles", "odd").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def candidate_clusters(classes: DataFrame, per_cent: int) -> DataFrame:
    """(id, component) of the classes that likely pairs within buckets connect with others."""
    bands = classes.select("id", F.posexplode("bands").alias("band", "key"))
    stats = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("id")).alias("h")).filter("n > 1")
    shared = cut(bands.join(stats, "key"))
    # the first bands connect most of a group of near copies; the others then pair only what isn't connected yet
    early = components(first_edges(shared.filter(F.col("band") < EARLY).withColumn("label", F.col("id")), classes, per_cent))
    labelled = shared.join(early, "id", "left").select("key", "id", "n", "h", F.coalesce("component", "id").alias("label"))
    later = first_edges(labelled, classes, per_cent)
    first = components(early.select(F.col("component").alias("a"), F.col("id").alias("b")).union(later))
    rest = cut(rest_edges(shared, classes, first, per_cent))
    if rest.isEmpty():
        return first
    joined = components(rest)
    lone = joined.join(first.select("id"), "id", "left_anti")
    merged = first.join(joined.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
    return cut(merged.select("id", F.coalesce("whole", "component").alias("component")).union(lone.select("id", "component")))


def joined_parts(ids: np.ndarray, sets: list[np.ndarray], half: np.ndarray | None, per_cent: int) -> list[tuple[int, int]]:
    """Links that join parts: enough of all pairs with 100 * inter >= per_cent * union to connect what they connect.

    half: pairs count only between its two values (None: all pairs).
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    root = np.arange(n)
    out = []
    for i in np.argsort(-sizes, kind="stable"):
        others = root != root[i]
        if half is not None:
            others &= half != half[i]
        if not others.any():
            continue
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        runs = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        inter = np.bincount(owner[at], minlength=n)
        hit = np.flatnonzero(others & (100 * inter >= per_cent * (sizes + sizes[i] - inter)))
        for j in hit.tolist():
            if root[j] != root[i]:
                out.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return out


def place(doc_id: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << MEMBER_BITS)).cast("int")


def membership(clusters: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit set for each id of clusters, by hash."""
    size = 1 << 16

    def pack(key, table):
        bits = np.zeros(size, np.uint8)
        bits[table["at"].to_numpy() % size] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = clusters.select(place(F.col("id")).alias("at")).distinct()
    out = bytearray((1 << MEMBER_BITS) // 8)
    for r in slots.withColumn("block", F.shiftright("at", 16)).groupBy("block").applyInArrow(pack, "block int, bits binary").collect():
        out[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = r["bits"]
    return bytes(out)


def exact_edges(clusters: DataFrame, docs: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """Confirmed links (a, b) that connect each cluster's linked classes. clusters: (id, component)."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = clusters.join(sizes, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))

    shared = docs.sparkSession.sparkContext.broadcast(membership(clusters))

    def make():
        bitmap = np.frombuffer(shared.value, np.uint8)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[at >> 3] >> (7 - at % 8)) & 1 == 1))
            sets = shingle_sets(batch.column(1).to_pylist(), shingle)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values))], ["id", "shingles"])

        return run

    # most documents are in no cluster: the bitmap keeps their sets out of the join
    held = map_texts(docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text", place(F.col("doc_id")).alias("at")), make, "id long, shingles array<long>")
    rows = held.join(sized, "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def confirm(key, table):
        ids, own = table["id"].to_numpy(), table["own"].to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in table["shingles"]]
        order = np.argsort(ids, kind="stable")
        pairs = joined_parts(ids[order], [sets[k] for k in order], own[order] if key[1].as_py() != key[2].as_py() else None, per_cent)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return dealt.select("component", "i", "j", "id", "own", "shingles").groupBy("component", "i", "j").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id linked with it, itself included) and kept for each row."""
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    base = cut(signatures(docs, shingle))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    least = cut(base.filter(own.isNotNull()).groupBy("s1", "s2").agg(F.min("doc_id").alias("id")))
    longs = [F.conv(F.hex(F.substring("odd", 1 + 8 * k, 8)), 16, -10).cast("long") for k in range(SKETCH_BITS // 64)]
    # one row a class, with its bitmap as 64-bit words
    classes = cut(base.join(least, ["s1", "s2"]).filter("doc_id = id").dropDuplicates(["id", "s1", "s2"]).select("id", "n_shingles", "bands", F.array(*longs).alias("odd")))
    clusters = candidate_clusters(classes, per_cent)
    links = cut(exact_edges(clusters, docs, shingle, per_cent))
    found = components(links).withColumnRenamed("id", "class_id")
    members = base.drop("bands", "odd").join(least, ["s1", "s2"], "left")
    out = members.join(found, members["id"] == found["class_id"], "left")
    component = F.when(own.isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at a Jaccard similarity of 0.8 on two-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] END) AS sh FROM w
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY 1
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT i.a, i.b FROM inter i JOIN sizes x ON x.doc_id = i.a JOIN sizes y ON y.doc_id = i.b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)
), pairs AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM pairs UNION SELECT r.doc_id, l.b FROM reach r JOIN pairs l ON l.a = r.other
), low AS (
  SELECT doc_id, min(other) AS c FROM reach GROUP BY 1
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(low.c, w.doc_id) AS component_id, coalesce(low.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN low ON low.doc_id = w.doc_id
"""
