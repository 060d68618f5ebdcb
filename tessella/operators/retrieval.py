"""Sparse, dense and fused retrieval over chunk tables.

Scopes, queries and hit lists are small by their limits; postings and vectors are only scanned, filtered by
scope, and reduced before any row moves. Statistics of BM25 hold for the scoped chunks, never for the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.text import cosine, search_tokens
from tessella.sources.library import keep

#: Distinct query terms, and terms of all queries, up to which chunks are filtered and scored by them in one expression; counts held at once there.
FEW, MANY, CELLS = 10_000, 100_000, 2_000_000


def counted(rows: DataFrame, terms: str) -> DataFrame:
    """rows with an array of tokens `terms`, one row for each different one: term and tf in its place. Tokens are counted where their row is."""
    others = [c for c in rows.columns if c != terms]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # counts of a few hundred rows at a time, so that memory doesn't follow a batch's texts
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                arrays = batch.column(batch.schema.get_field_index(terms))
                words = arrays.flatten().dictionary_encode()
                if not len(words):
                    continue
                row = pc.list_parent_indices(arrays).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                own, word = pa.array(pairs // len(words.dictionary)), pa.array(pairs % len(words.dictionary))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(own) for c in others), words.dictionary.take(word), pa.array(tf.astype(np.int32))], [*others, "term", "tf"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", term string, tf int"
    return rows.select(*others, terms).mapInArrow(count, schema)


def postings(chunks: DataFrame) -> DataFrame:
    """(id, run_id, term, tf, document_length) of chunks (id, run_id, text)."""
    terms = chunks.withColumn("terms", search_tokens(F.col("text")))
    each = counted(terms.select("id", "run_id", F.size("terms").alias("document_length"), "terms"), "terms")
    return each.groupBy("id", "run_id", "term").agg(F.sum("tf").cast("int").alias("tf"), F.first("document_length").alias("document_length"))


def scoped_stats(chunks: DataFrame) -> DataFrame:
    """One row: how many scoped chunks there are and their mean length."""
    n = F.size(search_tokens(F.col("text")))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("avgdl"))


def conflicting_ids(chunks: DataFrame) -> DataFrame:
    """Ids that come with different texts: an index must not be built from them."""
    return chunks.groupBy("id").agg(F.count_distinct(F.sha2("text", 256)).alias("texts")).filter("texts > 1")


def bm25(chunks: DataFrame, queries: DataFrame, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) of the best scoped chunks (id, text) for each query (query_id, query).

    One scan makes a row a chunk: its length, and those of its tokens that queries ask for. That small table is written
    once, and all statistics and scores come from it. Up to FEW distinct terms and MANY of all queries, counted, each chunk's scores are
    summed where its row is, and only a batch's best ones move; of more, tokens meet the terms in a join.
    """
    spark = chunks.sparkSession
    if limit < 1:
        return spark.createDataFrame([], "query_id long, id string, score double, rank int")
    asked = queries.select("query_id", F.posexplode(F.array_distinct(search_tokens(F.col("query")))).alias("place", "term"))
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW + 1).collect()]
    tokens = chunks.select("id", search_tokens(F.col("text")).alias("terms"))
    many = asked.limit(MANY + 1).collect() if len(few) <= FEW else []
    if len(few) > FEW or len(many) > MANY:
        return ranked(_joined(tokens, asked, k1, b), limit)
    own = keep(tokens.select("id", F.size("terms").alias("dl"), F.filter("terms", lambda t: t.isin(few)).alias("terms")))
    n, avgdl = own.agg(F.count(F.lit(1)), F.avg("dl")).first()
    if not own.groupBy("id").count().filter("count > 1").isEmpty():  # a chunk in several rows is scored over all of them
        return ranked(_joined(tokens, asked, k1, b), limit)
    df = {r["term"]: r["df"] for r in own.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    number = {t: k for k, t in enumerate(few)}
    idf = np.array([math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in few])
    wanted: dict[object, list[int]] = {}
    for r in sorted(many, key=lambda r: r["place"]):
        wanted.setdefault(r["query_id"], []).append(number[r["term"]])
    kinds = pa.schema([pa.field("query_id", to_arrow_type(asked.schema["query_id"].dataType)), pa.field("id", to_arrow_type(own.schema["id"].dataType)), pa.field("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = pa.array(few, pa.string()), max(1, CELLS // max(1, len(few)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, dl, terms = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "dl", "terms"))
                cell = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64) * len(few)
                cell += pc.index_in(terms.flatten(), known).to_numpy(zero_copy_only=False)
                tf = np.bincount(cell, minlength=batch.num_rows * len(few)).reshape(batch.num_rows, len(few))
                share = k1 * (1 - b + b * dl.to_numpy(zero_copy_only=False) / avgdl) if avgdl else np.zeros(batch.num_rows)
                with np.errstate(invalid="ignore"):
                    part = np.ascontiguousarray(np.where(tf > 0, idf * tf * (k1 + 1) / (tf + share[:, None]), 0.0).T)
                for query, places in wanted.items():
                    total = np.zeros(batch.num_rows)
                    for k in places:
                        total += part[k]
                    least = np.partition(total, -limit)[-limit] if limit < len(total) else 0.0
                    found = np.flatnonzero((total > 0) & (total >= least))
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([query] * len(found), kinds.field(0).type), ids.take(pa.array(found)).cast(kinds.field(1).type), pa.array(total[found])], schema=kinds)

    return ranked(own.mapInArrow(score, f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, score double"), limit)


def _joined(tokens: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of chunks (id, terms) for queries' terms (query_id, place, term) of any number."""
    own = keep(tokens.withColumn("dl", F.size("terms")))
    found = own.select("id", "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    whole = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = found.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").join(asked, "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    in_order = F.array_sort(F.collect_list(F.struct("place", part.alias("s"))))
    return scored.groupBy("query_id", "id").agg(F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["s"]).alias("score")).filter("score > 0")


def dense(vectors: DataFrame, query: Column, limit: int = 20, dimension: int | None = None) -> DataFrame:
    """(id, score, rank) of the nearest vectors (id, vector) by cosine, exactly; ties to the smaller id.

    dimension: what the index's vectors have; a query of another one is an error, and not a list of wrong scores.
    """
    if dimension is not None:
        query = F.when(F.size(query) == dimension, query).otherwise(F.raise_error(F.lit(f"the query's vector doesn't have {dimension} components")))
    scored = vectors.select("id", cosine(F.col("vector"), query).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return scored.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def of_version(vectors: DataFrame, version: str, query_version: str) -> DataFrame:
    """The vectors (version) that a query embedded under query_version may be compared with; ValueError if the index has moved on."""
    if version != query_version:
        raise ValueError(f"the query is of version {query_version}, the index of {version}")
    return vectors.filter(F.col("version") == version)


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= limit)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, chunks: DataFrame, parent_limit: int = 3, evidence_limit: int = 2, k: int = 60, by_rank: bool = False) -> DataFrame:
    """Reciprocal-rank fusion folded to parents: (rank, parent_chunk_id, score, evidence).

    hits: (id, rank); chunks in scope: (id, parent_chunk_id). Hits on other chunks are dropped; a parent scores as its
    best child. Ties go to smaller ids; with by_rank first to the better rank in either channel. Both hit lists are bounded
    by their limits.
    """
    if min(parent_limit, evidence_limit, k) < 1:
        raise ValueError("fusion limits start at 1")

    def best(hits: DataFrame, name: str) -> DataFrame:
        return hits.groupBy("id").agg(F.min("rank").alias(name))

    both = best(dense_hits, "dense_rank").join(best(sparse_hits, "sparse_rank"), "id", "full_outer")
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", share("dense_rank") + share("sparse_rank"))
    known = chunks.select("id", "parent_chunk_id").join(F.broadcast(scored), "id")
    known = known.withColumn("best_rank", F.least("dense_rank", "sparse_rank") if by_rank else F.lit(0))
    place = F.row_number().over(Window.partitionBy("parent_chunk_id").orderBy(F.desc("rrf"), "best_rank", "id"))
    kept = known.withColumn("place", place).filter(F.col("place") <= evidence_limit)
    evidence = F.array_sort(F.collect_list(F.struct("place", "id", "rrf", "dense_rank", "sparse_rank"))).alias("evidence")
    order = [F.desc("score"), F.asc("best_rank"), F.asc("parent_chunk_id")]
    top = kept.groupBy("parent_chunk_id").agg(F.max("rrf").alias("score"), F.min_by("best_rank", "place").alias("best_rank"), evidence).orderBy(*order).limit(parent_limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("best_rank")


def hydrate(top: DataFrame, parents: DataFrame, scope: DataFrame, dense_version: str, sparse_version: str) -> DataFrame:
    """Fused parents (rank, parent_chunk_id, score) with their text, if their run is still in scope under both index versions.

    parents: (id, run_id, text); scope: (run_id, dense_version, sparse_version). The fused list is bounded by its limit.
    """
    valid = scope.filter((F.col("dense_version") == dense_version) & (F.col("sparse_version") == sparse_version)).select("run_id")
    found = parents.join(F.broadcast(top), parents["id"] == top["parent_chunk_id"]).drop("id")
    return found.join(valid, "run_id", "left_semi")


def quality(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """One row of retrieval quality over queries (query_id): how many have a relevant hit among the k best, the mean
    reciprocal rank, and how many have no hit. hits: (query_id, id, rank); relevant: (query_id, id)."""
    best = hits.join(relevant.distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    some = hits.select("query_id").distinct().withColumn("some", F.lit(1))
    each = queries.select("query_id").distinct().join(best, "query_id", "left").join(some, "query_id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(F.col("some").isNull(), 1.0).otherwise(0.0)).alias("no_result_rate"),
    )
