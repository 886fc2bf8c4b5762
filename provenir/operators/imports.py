"""Import of files: bytes to format to source blocks, with what is refused and why.

Files come as rows (name, mime, content), from ``read_files`` or any other source. A file's document is named by its content, so equal files are one
document. HTML and text go through column expressions; only CSV and DOCX, whose formats SQL functions can't read, are parsed in Arrow batches, a file at a time.
PDF pages come as extracted items (``blocks.page_texts``, ``blocks.block_bounds``); no PDF reader is shipped.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detect_format, normalize_lines, strip_html
from ..storage import materialize
from . import blocks as B

MAX_BYTES, MAX_ROWS, MAX_COLUMNS = 25 << 20, 100_000, 500
BLOCKS = ["doc_id", "block_id", "path", "text", "start", "end", "row", "section"]


class Imported(NamedTuple):
    documents: DataFrame  # doc_id, name, format, size
    blocks: DataFrame  # BLOCKS
    refused: DataFrame  # name, reason


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), "content")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, wrong ones replaced, without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def csv_blocks_of(text: str) -> Iterator[tuple[int, str]]:
    """(row, text) of a CSV text; the header is row 1. Raises ValueError beyond the limits."""
    rows = B.parse_csv(text)
    if len(rows) > MAX_ROWS + 1:
        raise ValueError(f"more than {MAX_ROWS} rows")
    if any(len(r) > MAX_COLUMNS for r in rows):
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    names = [h.strip() or f"column_{i}" for i, h in enumerate(rows[0] if rows else [], 1)]
    for number, row in enumerate(rows[1:], 2):
        if any(cell.strip() for cell in row):
            yield number, "\n".join(f"{n}: {row[i] if i < len(row) else ''}" for i, n in enumerate(names))


def docx_html(content: bytes) -> str:
    """Headings, paragraphs and table cells of a Word document as HTML. Raises ValueError if it can't be read."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > 8 * MAX_BYTES:
                raise ValueError("the document is too large")
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("not a Word document") from e

    def text(p: ElementTree.Element) -> str:
        return escape("".join(t.text or "" if t.tag == f"{ns}t" else "\t" if t.tag == f"{ns}tab" else "\n" if t.tag == f"{ns}br" else "" for t in p.iter()))

    out = []
    for child in body if body is not None else []:
        if child.tag == f"{ns}p":
            style = child.find(f"{ns}pPr/{ns}pStyle")
            name = (style.get(f"{ns}val") or "").lower() if style is not None else ""
            tag = f"h{name[-1]}" if name.startswith("heading") and name[-1:] in "123456" else "p"
            out.append(f"<{tag}>{text(child)}</{tag}>")
        elif child.tag == f"{ns}tbl":
            out += [f"<td>{' '.join(text(p) for p in cell.iter(f'{ns}p'))}</td>" for cell in child.iter(f"{ns}tc")]
    return "".join(out)


def _parsed(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, row, text, reason of CSV rows or of a Word document's HTML; one row with a reason for a file that can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for doc_id, content in zip(df["doc_id"], df["content"], strict=True):
                try:
                    rows = list(csv_blocks_of(content.decode("utf-8-sig", "replace"))) if kind == "csv" else [(0, docx_html(content))]
                    yield pd.DataFrame([(doc_id, *r, None) for r in rows], columns=["doc_id", "row", "text", "reason"])
                except ValueError as e:
                    yield pd.DataFrame([(doc_id, 0, None, str(e))], columns=["doc_id", "row", "text", "reason"])

    return files.where(F.col("format") == kind).select("doc_id", "content").mapInPandas(run, "doc_id string, row long, text string, reason string")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the block's id, from its document, suffix and text."""
    return rows.withColumn("block_id", F.concat_ws("::", "doc_id", "suffix", B.content_id(F.col("text"), "", 12))).select(BLOCKS)


def _plain(docs: DataFrame, path: Column, section: Column, suffix: Column) -> DataFrame:
    """Blocks of docs(key, text, ...) whose key holds doc_id, path and section."""
    cut = B.plain_blocks(docs, "key", F.col("text"))
    return cut.select(F.col("key.doc_id").alias("doc_id"), path.alias("path"), "text", "start", "end", F.lit(None).cast("long").alias("row"), section.alias("section"), suffix.alias("suffix"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages(doc_id, html): sections under their headings, cells as tables'; the stripped text of a page without sections."""
    found = materialize(B.html_sections(pages, "doc_id", F.col("html")), "sections")
    under = B.heading_paths(found, "doc_id")
    label = F.when(F.col("tag").isin("td", "th"), F.concat(F.lit("table-"), "section")).otherwise(F.col("section"))
    sections = _plain(under.select(F.struct("doc_id", "path", label.alias("section")).alias("key"), "text"), F.col("key.path"), F.col("key.section"), F.concat_ws("-", "key.section", "n"))
    bare = pages.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    rest = _plain(bare.select(F.struct("doc_id").alias("key"), strip_html(F.col("html")).alias("text")), F.lit(""), F.lit(None).cast("string"), F.col("n").cast("string"))
    return _named(sections.unionByName(rest))


def import_files(files: DataFrame) -> Imported:
    """Documents, blocks and refused files of files(name, mime, content). A refused file leaves no block."""
    sized = files.select("name", "content", F.coalesce("mime", F.lit("")).alias("mime"), F.octet_length("content").alias("size"), B.content_id(F.col("content"), "doc-", 24).alias("doc_id"))
    sized = sized.withColumn("format", detect_format(F.col("name"), F.col("mime")))
    reason = F.when(F.col("size") > MAX_BYTES, f"more than {MAX_BYTES} bytes").when(F.col("format").isNull(), "unknown format").when(F.col("format") == "pdf", "pages of a PDF come as extracted items")
    judged = sized.withColumn("reason", reason)
    documents = judged.where("reason is null").groupBy("doc_id").agg(F.min_by(F.struct("name", "format", "size"), "name").alias("_d")).select("doc_id", "_d.*")
    documents = materialize(documents, "documents")
    taken = judged.where("reason is null").join(documents.select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    taken = materialize(taken.select("doc_id", "format", "content").dropDuplicates(["doc_id"]), "taken")

    plain = _plain(taken.where("format in ('text', 'markdown')").select(F.struct("doc_id").alias("key"), decoded(F.col("content")).alias("text")), F.lit(""), F.lit(None).cast("string"), F.col("n").cast("string"))
    csv, docx = (materialize(_parsed(taken, kind), kind) for kind in ("csv", "docx"))
    rows = csv.where("reason is null").select("doc_id", F.lit("CSV row").alias("path"), "text", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "row", F.lit(None).cast("string").alias("section"), F.concat(F.lit("row-"), "row").alias("suffix"))
    pages = taken.where("format = 'html'").select("doc_id", decoded(F.col("content")).alias("html")).unionByName(docx.where("reason is null").select("doc_id", F.col("text").alias("html")))
    made = materialize(_named(plain).unionByName(_named(rows)).unionByName(html_blocks(pages)), "blocks")
    kept, odd = B.quarantine(made, "doc_id")
    failed = csv.unionByName(docx).where("reason is not null").select("doc_id", "reason").unionByName(odd.select("doc_id", "reason"))
    refused = judged.where("reason is not null").select("name", "reason").unionByName(failed.join(documents, "doc_id").select("name", "reason"))
    return Imported(documents.join(failed, "doc_id", "left_anti"), kept, refused)


def text_notes(files: DataFrame) -> DataFrame:
    """id, title, markdown of Markdown and text files(name, content): the first heading of level 1 is the title, else the name without its ending."""
    text = normalize_lines(decoded(F.col("content")))
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))
    return files.select(B.content_id(F.col("content"), "note-", 24).alias("id"), F.coalesce(heading, F.regexp_replace("name", r"\.[^.]*$", "")).alias("title"), text.alias("markdown"))
