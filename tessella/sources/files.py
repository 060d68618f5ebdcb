"""Files of any kind: a binary scan, dispatched by kind to the parsers."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import unix_lines, utf8_sig
from tessella.sources.parsers import blocks_by_kind

#: Kinds by the ends of names.
KINDS = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf"}


def mime_type(path: Column) -> Column:
    """The kind of a file by the end of its name; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*(F.when(suffix == s, kind) for s, kind in KINDS.items()))


def scan(spark: SparkSession, folder: str, since: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, modified_at, size, mime_type, content) of the files under a folder.

    since: only files modified after that time ('2024-01-01T00:00:00'), which the listing itself leaves out; contents are read
    only where they are asked for. Files without content have no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if since:
        reader = reader.option("modifiedAfter", since)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), mime_type(F.col("path")).alias("mime_type"), "content")


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that tasks reach as a local or mounted one; null in another file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_each(files: DataFrame, folder: str) -> tuple[int, int]:
    """Texts (name, text) written under a folder, a file each; how many they are, and their bytes.

    Names must be distinct, and the same if a task runs again. In a mounted folder tasks write the files by themselves, into sub-folders
    by a hash of the name: Hadoop's local file system starts two processes a file. Elsewhere Spark's writer makes a folder
    a file: a path has `name=` before the name and a part's name after it, and a text a line feed more.
    """
    files = files.select("name", F.coalesce("text", F.lit("")).alias("text"))
    root = mounted(files.sparkSession, folder)
    if root is None:
        files.repartition("name").write.partitionBy("name").text(folder)
        done = files.select(F.lit(1).alias("files"), F.octet_length("text").alias("bytes"))
    else:
        os.makedirs(root, exist_ok=True)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: set[str] = set()
            for batch in batches:
                size = 0
                for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                    own = f"{root}/{zlib.crc32(name.encode()) % 1000:03d}"
                    if own not in made:
                        os.makedirs(own, exist_ok=True)
                        made.add(own)
                    unfinished = f"{own}/_{uuid.uuid4().hex}"
                    with open(unfinished, "wb") as f:
                        size += f.write(text)
                    os.replace(unfinished, f"{own}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([size], pa.int64())], ["files", "bytes"])

        done = files.withColumn("text", F.encode("text", "UTF-8")).mapInArrow(write, "files long, bytes long")
    (sums,) = done.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).collect()
    return tuple(sums)


def decoded(content: Column, charset: str | None = None) -> Column:
    """Bytes as text with line feeds alone: UTF-8 without a byte-order mark, or of another charset; what isn't valid is replaced."""
    if charset:
        return unix_lines(F.regexp_replace(F.decode(content, charset), "^\ufeff", ""))
    return unix_lines(F.coalesce(utf8_sig(content), F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")))


def parsed(files: DataFrame, run: Column, closed: bool = False) -> DataFrame:
    """Blocks (run_id, title, block_no, page_number, kind, text, title_path) of files (see scan), each by its kind's parser, in one pass over the files.

    Files of kinds without a parser have no blocks; `unparsed` lists them. closed: see html_blocks.
    """
    known = files.filter(F.col("mime_type").isin("text/plain", "text/markdown", "text/html"))
    return blocks_by_kind(known.select(run.alias("run_id"), "mime_type", decoded(F.col("content")).alias("text")), closed)


def unparsed(files: DataFrame) -> DataFrame:
    """Files that no parser here reads."""
    return files.filter(~F.coalesce(F.col("mime_type").isin("text/plain", "text/markdown", "text/html"), F.lit(False)))
