"""Parent and child chunks of parsed blocks.

blocks: run_id, block_no, page_number, kind, text, title_path. Token windows come from arrays over the code points of
many blocks at once, the separators and offsets from one window a run, and the greedy grouping into parents from a pass over
the run's sorted units that keeps a count and a path. No run is collected: what meets in a row is a block or a parent.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import stable_id


#: Bytes of text that are read together, one text at least.
GROUP = 1 << 18
#: What a code point may be in a chunk token: of a word of [A-Za-z0-9_], of a word of letters, the beginning of such a word, a token by itself.
WORD, LETTER, FOREIGN, ALONE = 1, 2, 4, 8


@cache
def token_classes() -> np.ndarray:
    """The bits of each code point by CHUNK_RE, 0 between tokens; all from the last on are tokens by themselves."""
    names = [unicodedata.category(chr(c)) for c in range(0x40000)]
    kinds = {k: (LETTER | FOREIGN) if k[0] == "L" or k in ("Nl", "No") else 0 if k == "Nd" else ALONE for k in set(names)}
    found = np.array([kinds[k] for k in names], np.uint8)
    found[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    found[0x3400:0xA000] = found[0x3400:0xA000] & LETTER | ALONE
    found[[ord(c) for c in string.ascii_letters]] = WORD | LETTER
    found[[ord(c) for c in string.digits + "_"]] = WORD
    return found


def window_finder(maximum: int, step: int) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to their token windows. It carries what it needs, so that workers can do without this module."""
    classes = token_classes()

    def bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the tokens of an array of code points."""
        bits = classes.take(points, mode="clip")
        kind = (bits & WORD) + (bits & ALONE)
        foreign = (bits & FOREIGN) > 0
        if foreign.any():  # from its first foreign letter on a run of letters is one token
            at = np.arange(len(bits), dtype=np.int32)
            kind[np.maximum.accumulate(np.where(foreign, at, -1)) > np.maximum.accumulate(np.where(bits & LETTER, -1, at))] = LETTER
        change = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        alone, some = kind == ALONE, kind > 0
        return np.flatnonzero(some & (change[:-1] | alone)), np.flatnonzero(some & (change[1:] | alone)) + 1

    def found(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """How many windows each text has, and the starts, ends and tokens of all, in order."""
        whole = [(t or b"").decode("utf-8", "replace") for t in texts]
        begins = np.cumsum([0, *(len(t) + 1 for t in whole)])  # what joins them is no token
        starts, ends = bounds(np.frombuffer("\n".join(whole).encode("utf-32-le"), np.uint32))
        first = np.searchsorted(starts, begins)
        n = np.diff(first)
        count = np.where(n == 0, 0, 1 + np.maximum(0, -((maximum - n) // step)))
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        head, tail = first[row] + k * step, first[row] + np.minimum(k * step + maximum, n[row])
        return count, starts[head] - begins[row], ends[tail - 1] - begins[row], tail - head

    def windows(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        groups = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy()) // GROUP
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(column)]
        parts = [found(column.slice(a, b - a).to_pylist()) for a, b in zip(cuts, cuts[1:])]
        count, *fields = (np.concatenate(x).astype(np.int32) for x in zip(*parts))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.StructArray.from_arrays([pa.array(f) for f in fields], ["start", "end", "tokens"]))

    return windows


def with_windows(df: DataFrame, text: str, maximum: int, overlap: int = 0) -> DataFrame:
    """Add windows: array of (start, end, tokens) of token windows over a text column.

    Texts are read as code points, many at once; no token becomes an object of its own.
    """
    if maximum < 1 or not 0 <= overlap < maximum:
        raise ValueError("windows need a maximum of 1 or more and an overlap below it")
    # not deterministic: else a filter on the windows would read the texts a second time
    windows = F.arrow_udf(window_finder(maximum, maximum - overlap), "array<struct<start:int,end:int,tokens:int>>").asNondeterministic()
    return df.withColumn("windows", windows(F.col(text)))


def source_units(blocks: DataFrame, maximum: int, whole: bool = False) -> DataFrame:
    """One row a unit: run_id, unit (ordinal), page, title_path, separator, text, tokens, document_start, document_end.

    whole: a block is one unit from its first letter to its last, however many tokens it has; else it is cut into units of the maximum.
    """
    if whole:
        found = with_windows(blocks, "text", 2**31 - 1)
        one = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.coalesce(F.get("windows", F.lit(0))["tokens"], F.lit(0)).alias("tokens"))
        found = found.withColumn("windows", F.array(one))
    else:
        found = with_windows(blocks, "text", maximum)
    found = found.withColumn("parts", F.size("windows"))
    before = Window.partitionBy("run_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    lead = found.withColumn("earlier", F.coalesce(F.sum("parts").over(before), F.lit(0))).withColumn("separator", F.when(F.col("earlier") > 0, "\n\n").otherwise(""))
    cursor = F.coalesce(F.sum(F.length("separator") + F.length("text")).over(before), F.lit(0)) + F.length("separator")
    each = lead.withColumn("cursor", cursor).select("*", F.posexplode("windows").alias("part", "w"))
    return each.select(
        "run_id", (F.col("earlier") + F.col("part")).cast("int").alias("unit"), F.coalesce("page_number", F.lit(1)).alias("page"), "title_path",
        F.when(F.col("part") == 0, F.col("separator")).otherwise("").alias("separator"), F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"),
        F.col("w.tokens").alias("tokens"), (F.col("cursor") + F.col("w.start")).cast("int").alias("document_start"), (F.col("cursor") + F.col("w.end")).cast("int").alias("document_end"),
    )


def grouped_units(units: DataFrame, maximum: int) -> DataFrame:
    """Add parent (ordinal): a new one where the heading path changes or the tokens would pass the maximum.

    Greedy packing needs its own past, so units come sorted to one task a run and pass it once; a row gets a number, and
    nothing is held but the open parent's count and path.
    """

    def number(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        run = path = None
        parent = held = 0
        for batch in columns:
            out = []
            for own, own_path, tokens in zip(*(column.to_pylist() for column in batch)):
                if own != run:
                    run, parent, held = own, 0, tokens
                elif own_path != path or held + tokens > maximum:
                    parent, held = parent + 1, tokens
                else:
                    held += tokens
                path = own_path
                out.append(parent)
            yield pa.array(out, pa.int32())

    # not deterministic: it depends on the order, which Catalyst then keeps
    numbers = F.arrow_udf(number, "int").asNondeterministic()
    return units.repartition("run_id").sortWithinPartitions("run_id", "unit").withColumn("parent", numbers("run_id", "title_path", "tokens"))


def parents(blocks: DataFrame, chunking_version: str = "parent-child-v1", maximum: int = 2500, whole: bool = False) -> DataFrame:
    """Parent chunks, with the ranges of their units for page spans of children.

    whole: no block is cut (see source_units), so that one of more tokens than the maximum is a parent by itself.
    """
    units = grouped_units(source_units(blocks, maximum, whole), maximum)
    by = Window.partitionBy("run_id", "parent").orderBy("unit")
    sep = F.when(F.row_number().over(by) == 1, "").otherwise(F.col("separator"))
    units = units.withColumn("sep", sep)
    end = F.sum(F.length("sep") + F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    units = units.withColumn("to", end).withColumn("from", F.col("to") - F.length("text"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct("unit", *c)))
    whole = units.groupBy("run_id", "parent").agg(
        ordered("sep", "text").alias("p"), ordered("from", "to", "page").alias("ranges"), F.min("page").alias("page_start"), F.max("page").alias("page_end"),
        F.min("document_start").alias("document_char_start"), F.max("document_end").alias("document_char_end"), F.first("title_path").alias("heading_path"), F.sum("tokens").cast("int").alias("token_count"),
    )
    text = F.array_join(F.transform("p", lambda x: F.concat(x["sep"], x["text"])), "")
    return whole.select(
        stable_id(F.col("run_id"), F.col("parent"), F.lit(chunking_version)).alias("id"), F.col("run_id").alias("ingestion_run_id"), F.col("parent").alias("ordinal"), "heading_path", "page_start", "page_end",
        "document_char_start", "document_char_end", "token_count", text.alias("text"), "ranges",
    )


def children(parent_rows: DataFrame, chunking_version: str = "parent-child-v1", maximum: int = 600, overlap: int = 80) -> DataFrame:
    """Child chunks: overlapping token windows of parents, with the pages that each touches."""
    found = with_windows(parent_rows, "text", maximum, overlap).select("*", F.posexplode("windows").alias("child", "w"))
    start, end = F.col("w.start"), F.col("w.end")
    pages = F.transform(F.filter("ranges", lambda r: (r["from"] < end) & (r["to"] > start)), lambda r: r["page"])
    return found.select(
        stable_id(F.col("id"), F.col("child"), F.lit(chunking_version)).alias("id"), F.col("id").alias("parent_chunk_id"), "ingestion_run_id", F.col("child").alias("ordinal"), start.alias("parent_char_start"), end.alias("parent_char_end"),
        "heading_path", F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.col("w.tokens").alias("token_count"), F.substring(F.col("text"), start + 1, end - start).alias("text"),
    )


def over_budget(child_rows: DataFrame, most: int = 1500) -> DataFrame:
    """Runs with more children than a run may have."""
    return child_rows.groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("n_children")).filter(F.col("n_children") > most)
