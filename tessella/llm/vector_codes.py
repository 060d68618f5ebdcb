"""Product codes of integer vectors: codebooks by part position, nearest entries by vantage-point trees.

A vector's components become integers, floor(scale * x), and the vector is cut into `parts` consecutive parts, equal if
its length divides by their number (else the first ones are one component longer). A part position's codebook starts as
that part of the `entries` smallest vec_ids. Each of `rounds` assigns every part to the nearest entry (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of its parts' mean; unused entries stay.

The nearest entry is found in a vantage-point tree over the position's entries: a node has one entry as its vantage point,
and the least and largest distance from it to the entries of its inner and its outer half. A part at distance d from the
vantage point, with its best entry so far at distance t, visits a half unless d + t < least or d - t > largest (so it does
where they are equal: an entry as near but of a lower index may be there). These distances are roots of integers, rounded
against pruning by more than a float's error; which entry is nearer is decided by integers alone. Many parts walk
a tree together, those nearer to the inner half one way round, the others the other.

Codebooks are all that passes through the driver: parts x entries short vectors, and sums of as many groups, which tasks
add up before they are shuffled.

Vectors that are null or hold null or non-finite components take no part and have no row. Those whose length differs
from that of the smallest vec_id's vector, or whose distances could pass 64 bits, are rows without code and error. With fewer
vectors than entries each is an entry. Repeated vec_ids are rows and entries of their own, in the order of their
components; null vec_ids come last. An empty table has no rows. Only vec_id, label and embedding are read; other columns may
have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, read

#: Entries that a leaf of the tree has at most.
LEAF = 8
#: How much a root of an integer is taken to be off at most, relatively.
SLACK = 2.0**-48
#: Vectors that a task walks through the trees together.
TOGETHER = 4096


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


class Tree:
    """A vantage-point tree over the entries (integers) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self.node(np.arange(len(entries)))
        self.visits = 0

    def node(self, own: np.ndarray):
        """A leaf's entries, or (vantage point, (half, least, largest), (half, least, largest))."""
        if len(own) <= LEAF:
            return own
        # the vantage point is the entry farthest from the first, so that distances to it differ
        far = own[np.argmax(squared(self.entries[own], self.entries[own[0]]))]
        rest = own[own != far]
        d = squared(self.entries[rest], self.entries[far])
        order = np.argsort(d, kind="stable")
        rest, root = rest[order], np.sqrt(d[order].astype(np.float64))
        half = len(rest) // 2
        return far, *((self.node(x), r[0] * (1 - SLACK), r[-1] * (1 + SLACK)) for x, r in ((rest[:half], root[:half]), (rest[half:], root[half:])))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index and the squared distance of each point's nearest entry."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries))
        self.visit(self.root, np.arange(len(points)), points, best, index)
        return index, best

    def compare(self, entry: int, rows: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> np.ndarray:
        d = squared(points[rows], self.entries[entry])
        self.visits += len(rows)
        nearer = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        hit = rows[nearer]
        best[hit], index[hit] = d[nearer], entry
        return d

    def visit(self, node, rows: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self.compare(entry, rows, points, best, index)
            return
        far, inner, outer = node
        d = np.sqrt(self.compare(far, rows, points, best, index).astype(np.float64))
        first = d <= (inner[2] + outer[1]) / 2
        for own, halves in ((first, (inner, outer)), (~first, (outer, inner))):
            at, low, high = rows[own], d[own] * (1 - SLACK), d[own] * (1 + SLACK)
            for half, least, largest in halves:
                reach = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
                near = (high + reach >= least) & (low - reach <= largest)
                self.visit(half, at[near], points, best, index)


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector of that size starts and ends."""
    ends = np.cumsum([size // parts + (k < size % parts) for k in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def assigned(table: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, codes, distances) of runs of the batch's vectors; codes and distances by row and part."""
    column = table.column(table.schema.get_field_index("x"))
    spans = bounds(sum(b.shape[1] for b in books), len(books))
    trees = [Tree(b) for b in books]
    for start in range(0, len(column), TOGETHER):
        some = column.slice(start, TOGETHER)
        x = some.flatten().to_numpy().reshape(len(some), -1)
        found = [tree.nearest(x[:, a:b]) for tree, (a, b) in zip(trees, spans)]
        yield start, x, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def move(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over the rows (x)."""
    spans = bounds(sum(b.shape[1] for b in books), len(books))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each entry in use and component: how many of the task's parts it has, and their sum."""
        totals: dict[tuple[int, int, int], list[int]] = {}
        for batch in batches:
            for _, x, codes, _ in assigned(batch, books):
                for p, (a, b) in enumerate(spans):
                    n = np.bincount(codes[:, p], minlength=len(books[p]))
                    sums = np.zeros((len(books[p]), b - a), np.int64)
                    np.add.at(sums, codes[:, p], x[:, a:b])
                    for e in np.flatnonzero(n).tolist():
                        for c, s in enumerate(sums[e].tolist()):
                            t = totals.setdefault((p, e, c), [0, 0])
                            t[0] += int(n[e])
                            t[1] += s
        keys = list(zip(*totals)) or [(), (), ()]
        # sums are sent in two halves: each fits 64 bits, however many rows are added
        values = [(n, s >> 32, s & 0xFFFFFFFF) for n, s in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()) for k in keys] + [pa.array(v, pa.int64()) for v in (list(zip(*values)) or [(), (), ()])], ["part", "entry", "component", "n", "high", "low"])

    sums = rows.select("x").mapInArrow(add, "part int, entry int, component int, n long, high long, low long").groupBy("part", "entry", "component")
    out = [b.copy() for b in books]
    for r in sums.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():  # as many rows as the codebooks have components
        out[r.part][r.entry, r.component] = ((r.high << 32) + r.low) // r.n
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, carry: tuple[str, ...] = (), scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, columns to carry, code, error) of vectors (vec_id, embedding), and the codebooks.

    code: the entries' indexes in part order, two hex digits each (entries: 256 at most); error: the sum of squared distances.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    taken = {c: f"_c{k}" for k, c in enumerate(carry)}  # no column that is carried can clash with those made here
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) < 2.0 ** 30 / F.sqrt(F.size("embedding").cast("double") + 1))
    rows = cut(vectors.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(small, whole).alias("x"), *(F.col(f"`{c}`").alias(name) for c, name in taken.items())))
    # the codebooks' start: bounded by their size
    start = [r.x for r in rows.filter("x is not null").select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    size = len(start[0]) if start else 0
    start = [x for x in start if len(x) == size]
    table = np.array(start, np.int64).reshape(len(start), size)
    books = [table[:, a:b].copy() for a, b in bounds(size, parts)]
    fits = rows.filter(F.size("x") == size)
    for _ in range(rounds if start else 0):
        books = move(fits, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, codes, distances in assigned(batch, books):
                n = len(codes)
                text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
                rest = [c for name, c in zip(batch.schema.names, batch.columns) if name != "x"]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in rest), pa.array(text, pa.string()), pa.array(distances.sum(axis=1), pa.int64())], [*(x for x in batch.schema.names if x != "x"), "code", "error"])

    kinds = "".join(f"{x} {rows.schema[x].dataType.simpleString()}, " for x in taken.values())
    done = fits.mapInArrow(code, f"vec_id long, {kinds}code string, error long")
    other = rows.filter(~F.coalesce(F.size("x") == size, F.lit(False))).select("vec_id", *taken.values(), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return done.union(other).select("vec_id", *(F.col(x).alias(c) for c, x in taken.items()), "code", "error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and the error of every vector, and the errors of its label together."""
    found, books = encode(read(spark, sf_dir, "embeddings"), carry=("label",))
    found = cut(found)
    labels = found.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return found.join(labels, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT row, part, p, arg_min(entry, struct_pack(d := d, entry := entry)) AS entry, min(d) AS d FROM (
    SELECT v.row, v.part, v.p, b.entry, CAST(list_sum([(v.p[i] - b.e[i]) * (v.p[i] - b.e[i]) FOR i IN range(1, len(v.p) + 1)]) AS BIGINT) AS d FROM v JOIN b{k} b ON v.part = b.part)
  GROUP BY row, part, p
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT part, entry, list(CAST(m AS BIGINT) ORDER BY i) AS e FROM (
    SELECT part, entry, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT part, entry, unnest(p) AS x, unnest(range(0, len(p))) AS i FROM a{k}) GROUP BY part, entry, i)
  GROUP BY part, entry
), b{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry
)""")
    return f"""
WITH r AS (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS e, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), v AS (
  SELECT row, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS p FROM (SELECT row, e, unnest(range(0, {parts})) AS part FROM r)
), b0 AS (
  SELECT part, row - 1 AS entry, p AS e FROM v WHERE row <= {entries}
), {', '.join(steps)}, c AS (
  SELECT row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN r USING (row)
"""


ORACLE = _oracle()
