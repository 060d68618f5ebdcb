"""Prepares a training corpus: toxic documents go, near copies go, repeated passages go, personal data is
masked, and what is left is packed into sequences. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, read
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.packing import pack_documents
from tessella.llm.pii import redact
from tessella.llm.substring_dedup import kept_words
from tessella.llm.toxicity import clean


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, if there is such a column, as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(columns) if "n_chars" in columns else docs.select(columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; null and empty texts score as such. An empty table gives no rows; texts are scored whole."""
    return clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies.

    A document is a doc_id with a text: rows that repeat both stay once, and rows that share a doc_id alone are judged one by
    one (of those that are near copies of each other the one of the least text hash stays). All rows without doc_id stay.
    An empty table gives no rows; texts of any length are compared whole.
    """
    named = docs.filter("doc_id is not null")
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        dropped = cut(near_duplicates(named).filter("not kept").select("doc_id"))
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    # documents are numbered in the order of doc_id; the names of what is added can't be those of columns
    rows = named.dropDuplicates(["doc_id", "text"]).withColumn("\0hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = rows.select("doc_id", "\0hash").distinct().repartitionByRange("doc_id", "\0hash").sortWithinPartitions("doc_id", "\0hash")
    keys = cut(keys.withColumn("\0number", F.monotonically_increasing_id()))
    numbered = rows.join(keys, ["doc_id", "\0hash"])
    dropped = cut(near_duplicates(numbered.select(F.col("\0number").alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias("\0number")))
    return numbered.join(dropped, "\0number", "left_anti").select(docs.columns).union(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of 20-word windows that start earlier; a text that loses none is as it was.

    Null texts come out empty. An empty table gives no rows; all windows of a long text are judged.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = kept_words(docs, carry=tuple(rest))
    return counted(found.toDF("doc_id", *rest, "\0words", "\0removed", "text"), docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked by kind. Null texts come out empty; an empty table gives no rows; texts are read whole."""
    return counted(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens: an empty or null text is one token, a long one many pieces, and an
    empty table has none."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]
#: SQL can't express learning, tokenizing and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
