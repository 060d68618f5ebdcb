"""Exact top-k inner products with multi-resolution segment statistics.

Vectors are integers, floor(scale * x). At each level a vector is cut into equal segments, and a segment keeps
its mean and its deviation. For two vectors the squared distance is at least the sum over segments of
length * ((mean difference)**2 + (deviation difference)**2); with the vectors' own norms, which the statistics
hold too, that lower bound is an upper bound on the inner product. Levels run from coarse to fine; what a
level's bound leaves above the k-th best score found so far goes on, and only survivors get their exact score.

Queries and vectors are dealt by hash into blocks of about `block` rows, and each pair of blocks is one group:
no task holds more than two blocks. A group returns each query's k best; the best of these are the result.

Vectors that are null, or hold null or non-finite components, take no part; so do vectors whose length
differs from the query's, or whose scaled components pass 2**62. A repeated vec_id is a candidate once a row;
a query repeated with other components asks with the smallest of them. A query never meets its own vec_id.
Scores are 64-bit integers; one that doesn't fit is an error. Ties go to the smaller vec_id. A query without
candidates has no row, and neither has an empty table. Of vectors only vec_id and embedding are read, and the columns
that say which are queries; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, read

#: Segments at each level, coarse to fine.
LEVELS = (1, 4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the weighted means, then the weighted deviations, of its segments."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    roots = np.sqrt([p.shape[1] for p in parts])
    return np.hstack([np.stack([p.mean(axis=1) for p in parts], 1) * roots, np.stack([p.std(axis=1) for p in parts], 1) * roots])


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vector_ids: np.ndarray, k: int, survivors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's k best vectors (ties to smaller ids), but for its own id.

    Levels run from coarse to fine. At each the vectors of the largest bounds get their scores, which raise the
    threshold, and the next level's bounds are computed for those alone whose bound reaches it. survivors: gets how
    many vectors came to each level and, last, to their exact scores.
    """
    order = np.argsort(vector_ids, kind="stable")
    vectors, vector_ids = vectors[order], vector_ids[order]
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    top = max(float(np.abs(q).max(initial=0)), 1) * max(float(np.abs(v).max(initial=0)), 1) * q.shape[1]
    levels = [(statistics(q, s), statistics(v, s)) for s in LEVELS]
    out: tuple[list, list, list] = ([], [], [])
    for i in range(len(q)):

        def score(rows, i=i):
            if top < 2**52:
                return (v[rows] @ q[i]).astype(np.int64)
            if top < 2**62:
                return (vectors[rows] * queries[i]).sum(axis=1)
            return (vectors[rows].astype(object) * queries[i].astype(object)).sum(axis=1).astype(np.int64)  # raises if a score has no place

        alive, least = np.flatnonzero(vector_ids != query_ids[i]), None
        for level, (a, b) in enumerate(levels):
            if survivors is not None:
                survivors[level] += len(alive)
            limit = b[alive] @ a[i]
            likely = alive[np.argpartition(-limit, 4 * k)[: 4 * k]] if len(alive) > 4 * k else alive
            found = np.sort(score(likely))
            if len(found) >= k and (least is None or found[-k] > least):
                least = found[-k]
            if least is not None:
                alive = alive[limit * (1 + 1e-9) + 1e-9 * top + 1 >= least]
        if survivors is not None:
            survivors[-1] += len(alive)
        scores = score(alive)
        if least is not None:
            alive, scores = alive[scores >= least], scores[scores >= least]
        take = np.lexsort((vector_ids[alive], -scores))[:k]
        out[0].append(np.full(len(take), query_ids[i]))
        out[1].append(vector_ids[alive][take])
        out[2].append(scores[take])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: x.cast("double") * scale)
    fine = F.forall(whole, lambda x: x.isNotNull() & (F.abs(x) < 2.0**62))  # NaN is larger than any number
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(whole, lambda x: F.floor(x)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score over vectors (vec_id, embedding)."""
    rows = cut(vectors.select(F.col("vec_id").cast("long"), is_query.alias("q"), scaled(F.col("embedding"), scale).alias("x")).filter("vec_id is not null and x is not null"))
    asked = rows.filter("q").groupBy("vec_id").agg(F.min("x").alias("x"))
    n, m = rows.count(), asked.count()
    v_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    hashed = F.xxhash64("vec_id")
    one = rows.select("vec_id", "x", F.lit(False).alias("q"), F.pmod(hashed, F.lit(v_blocks)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    two = asked.select("vec_id", "x", F.lit(True).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"), F.pmod(hashed, F.lit(q_blocks)).cast("int").alias("qb"))
    dealt = one.unionByName(two).withColumn("size", F.size("x"))

    def search(key, table):
        x = table["x"].combine_chunks()
        if not table.num_rows or not key[2].as_py():
            out = (np.zeros(0, np.int64),) * 3
        else:
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, -1)
            ids, q = table["vec_id"].to_numpy(), table["q"].to_numpy(zero_copy_only=False).astype(bool)
            out = best(flat[q], ids[q], flat[~q], ids[~q], k)
        return pa.table({"query_id": pa.array(out[0].astype(np.int64)), "vec_id": pa.array(out[1].astype(np.int64)), "score": pa.array(out[2].astype(np.int64))})

    found = dealt.groupBy("vb", "qb", "size").applyInArrow(search, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    return top_k(read(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum([q.e[i] * v.e[i] FOR i IN range(1, len(v.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
