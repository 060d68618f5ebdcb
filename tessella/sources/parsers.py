"""Sources to located blocks: (run_id, block_no, page_number, kind, text, title_path) and the document title."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "run_id string, title string, block_no int, page_number int, kind string, text string, title_path array<string>"
#: Elements without readable text, and what kind of block an element makes.
HIDDEN = "script|style|noscript|template|svg"
KINDS = {"p": "paragraph", "li": "list_item", "blockquote": "paragraph", "pre": "code"} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading")
#: A comment or declaration, a hidden element with all it holds, or a tag with its closing slash and name. What isn't closed
#: goes up to the end, and no part is tried twice, so that time follows the page.
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<({HIDDEN})\b[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z)|\Z)|<(/?)([a-z][a-z0-9]*+)(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)", re.S | re.I,
)
#: A character reference with its semicolon.
CLOSED = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")
HEADING = re.compile(r"(#{1,6}) +(\S.*)")


def line_blocks(text: str) -> Iterator[tuple[str, str, list[str]]]:
    """Blocks (kind, text, heading path) of a text: headings, and paragraphs of consecutive lines that aren't blank."""
    path: list[str] = []
    lines: list[str] = []
    for line in [x.strip() for x in text.splitlines()] + [""]:
        heading = HEADING.fullmatch(line)
        if lines and (heading or not line):
            yield "paragraph", "\n".join(lines), path
            lines = []
        if heading:
            path = [*path[: len(heading[1]) - 1], heading[2].strip()]
            yield "heading", heading[2].strip(), path
        elif line:
            lines.append(line)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Heading and paragraph blocks of texts (run_id, text), a text at a time and in time that follows it."""
    names = ["run_id", "block_no", "page_number", "kind", "text", "title_path"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(run_id, k, 1, *b) for run_id, text in zip(*(c.to_pylist() for c in batch.columns)) for k, b in enumerate(line_blocks(text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)

    return docs.select("run_id", "text").mapInArrow(parse, "run_id string, block_no int, page_number int, kind string, text string, title_path array<string>")


def closed_references(text: str) -> str:
    """text with the character references decoded that end in a semicolon; browsers decode some without it, too (html.unescape)."""
    return CLOSED.sub(lambda m: html.unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def pieces(page: str, unescape: Callable[[str], str] = html.unescape) -> Iterator[tuple[str, str, bool]]:
    """The page as (text before a tag, tag name, whether it closes); the last piece has no tag."""
    at = 0
    for m in MARKUP.finditer(page):
        yield unescape(page[at : m.start()]), (m[3] or "").lower(), bool(m[2])
        at = m.end()
    yield unescape(page[at:]), "", False


def page_blocks(page: str, unescape: Callable[[str], str] = html.unescape) -> tuple[str | None, list[tuple[str, str, list[str]]]]:
    """The title and the blocks (kind, text, heading path) of a page.

    A block is what stands between the outermost opening tag of a kind of block and its closing tag, white space
    squeezed, with a space between pieces that tags part. What follows the last such tag unclosed makes no block.
    """
    title: list[str] = []
    held: dict[str, list[str]] = {}  # the one open block's tag and its texts
    in_title, path, found = False, [], []
    for text, tag, closing in pieces(page, unescape):
        if in_title:
            title.append(text)
        for texts in held.values():
            texts.append(text)
        if tag == "title":
            in_title = not closing
        elif closing and tag in held:
            if whole := " ".join(" ".join(held.pop(tag)).split()):
                if KINDS[tag] == "heading":
                    path = [*path[: int(tag[1]) - 1], whole]
                found.append((KINDS[tag], whole, path))
        elif not closing and tag in KINDS and not held:
            held[tag] = []
    return " ".join(" ".join(title).split()) or None, found


def html_blocks(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Readable blocks of pages (run_id, html); a page without blocks has one row with a null block.

    closed: only character references with a semicolon are decoded; else those that browsers decode.
    """
    unescape = closed_references if closed else html.unescape
    names = ["run_id", "title", "block_no", "page_number", "kind", "text", "title_path"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run_id, page in zip(*(c.to_pylist() for c in batch.columns)):
                title, blocks = page_blocks(page or "", unescape)
                rows += [(run_id, title, k, 1, *b) for k, b in enumerate(blocks)] or [(run_id, title, None, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    return pages.select("run_id", "html").mapInArrow(parse, BLOCKS)


def blocks_by_kind(files: DataFrame, closed: bool = False) -> DataFrame:
    """Blocks of pages and other texts (run_id, mime_type, text), each as html_blocks or text_blocks reads it; a page without blocks has no row."""
    unescape = closed_references if closed else html.unescape
    names = ["run_id", "title", "block_no", "page_number", "kind", "text", "title_path"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run_id, kind, text in zip(*(c.to_pylist() for c in batch.columns)):
                title, blocks = page_blocks(text or "", unescape) if kind == "text/html" else (None, line_blocks(text or ""))
                rows += [(run_id, title, k, 1, *b) for k, b in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names)

    return files.select("run_id", "mime_type", "text").mapInArrow(parse, BLOCKS)


def markdown(blocks: DataFrame) -> DataFrame:
    """(run_id, markdown) of blocks."""
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.size("title_path")))
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text"))).when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text"))).when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    lines = blocks.filter("block_no is not null").select("run_id", "block_no", line.alias("line"))
    return lines.groupBy("run_id").agg(F.concat(F.btrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line"))), lambda x: x["line"]), "\n\n")), F.lit("\n")).alias("markdown"))


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Page text blocks of PDFs (run_id, content), top to bottom; needs the optional PyMuPDF on the executors."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for frame in frames:
            rows = []
            for run_id, content in zip(frame["run_id"], frame["content"]):
                k = 0
                for number, page in enumerate(pymupdf.open(stream=content, filetype="pdf"), 1):
                    for block in sorted(page.get_text("blocks"), key=lambda b: (b[1], b[0])):
                        text = "\n".join(x.strip() for x in block[4].splitlines() if x.strip())
                        if text:
                            rows.append((run_id, None, k, number, "paragraph", text, []))
                            k += 1
            yield pd.DataFrame(rows, columns=["run_id", "title", "block_no", "page_number", "kind", "text", "title_path"])

    return files.select("run_id", "content").mapInPandas(parse, BLOCKS)


def content_error(text: Column, most_bytes: int = 1_000_000) -> Column:
    """Why a pasted text can't be imported, or null."""
    return F.when(F.btrim(text) == "", "empty").when(F.octet_length(text) > most_bytes, "too_large")


def title_or_default(title: Column, most: int = 512) -> Column:
    """A title without white space around it, cut off at the most characters; a default if nothing is left."""
    bare = F.substring(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""), 1, most)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Untitled source"))


def safe_name(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)
