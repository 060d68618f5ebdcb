"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at a time.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    In local mode, where driver and executors are one process, it is set here if it isn't.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in column take about `most` bytes (one row at least)."""
    values = batch.column(batch.schema.get_field_index(column))
    start = size = 0
    for i, n in enumerate(pc.binary_length(values).fill_null(0).to_pylist()):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded text size; make() runs once a task and may hold caches.

    Python workers outlive their tasks: what make() holds goes when the task ends, and its memory to the system.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield f(part)
        del f
        release()

    return df.mapInArrow(run, schema)


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches have at most so many rows: rows of texts are long, and a task holds a batch on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def release() -> None:
    """Give freed memory of this Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ranked(df: DataFrame, key: str, counts: dict, order: list[str], name: str = "rank", cells: int = 100_000, least: int = 200) -> DataFrame:
    """Add a gapless rank from 0 among the rows of one key, without sorting a key in one task.

    counts has the rows of each key (a bounded number of keys). A key is dealt into cells by a hash of the
    order columns; a row's rank is the rows in earlier cells plus its place in its own cell. All keys
    together have about `cells` cells at most, of `least` rows or more.
    """
    total = sum(counts.values())
    size = max(least, total // cells)
    spark = df.sparkSession
    plan = spark.createDataFrame([(k, max(1, -(-n // size))) for k, n in counts.items()] or [(None, 1)], f"`{key}` {df.schema[key].dataType.simpleString()}, _cells int")
    dealt = df.join(F.broadcast(plan), key).withColumn("_cell", F.pmod(F.xxhash64(*order), F.col("_cells")).cast("int")).drop("_cells")
    in_key = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "_cell").count().select(key, "_cell", F.coalesce(F.sum("count").over(in_key), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order)) - 1
    return dealt.join(starts, [key, "_cell"]).withColumn(name, F.col("_start") + place).drop("_start", "_cell")
