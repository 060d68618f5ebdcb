"""Partitioned tables for chunks, postings and vectors: a run's partition is replaced or dropped as a whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import RUN_ID_RE


def write_runs(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Replace the partitions of the runs in df; other runs stay. Tasks are dealt by size: a big run has several files."""
    bad = df.filter(~F.coalesce(F.col(run).rlike(RUN_ID_RE), F.lit(False))).select(run).limit(1).collect()
    if bad:
        raise ValueError(f"unsafe run id: {bad[0][0]!r}")
    df.hint("rebalance", run).sortWithinPartitions(run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None, run: str = "run_id") -> DataFrame:
    """The table, or only some runs' partitions."""
    table = spark.read.parquet(path)
    return table if runs is None else table.filter(F.col(run).isin(sorted(runs)))


def append_new(df: DataFrame, path: str, key: str, spark: SparkSession) -> None:
    """Append rows whose key the table doesn't have (content-addressed writes)."""
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = df.select(key).limit(0)
    df.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)


def drop_run(spark: SparkSession, path: str, run_id: str, run: str = "run_id") -> None:
    """Remove a run's partition; the id must be a safe one."""
    if not re.fullmatch(RUN_ID_RE, run_id):
        raise ValueError(f"unsafe run id: {run_id!r}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{run}={run_id}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose parent is missing: a table that has any must not be published."""
    return children.join(parents.select(F.col("id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti")
