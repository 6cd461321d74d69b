"""Sources of documents: files, plain text and HTML. PDF parsing is a parser that the caller hands in."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import block_type

BLOCK_SCHEMA = "document_id string, page_number int, block_index int, block_type string, text string, bbox array<double>, table_data struct<headers:array<string>,rows:array<array<string>>>"


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, in hex."""
    return F.sha2(content, 256)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, filename, content, file_hash, file_size of the files below a folder; names match whatever their case."""
    suffix = pattern.lstrip("*").lower()
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(suffix))
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content", file_hash(F.col("content")).alias("file_hash"), F.col("length").alias("file_size"))


def parsed(found: DataFrame, parser, most_table_pages: int = 10) -> DataFrame:
    """Blocks of files by ``parser(content, with_tables) -> list of dicts`` with the fields of BLOCK_SCHEMA but document_id, and page_count.

    Tables are looked for in documents of up to ``most_table_pages`` pages, which the parser is told to decide.
    """

    def run(frames):
        for f in frames:
            out = []
            for key, content in zip(f["file_hash"], f["content"], strict=True):
                out += [{"document_id": key, **b} for b in parser(bytes(content), most_table_pages)]
            yield pd.DataFrame(out, columns=["document_id", "page_number", "block_index", "block_type", "text", "bbox", "table_data"])

    return found.select("file_hash", "content").mapInPandas(run, BLOCK_SCHEMA)


def table_text(headers: list[str], rows: list[list[str]]) -> str:
    """A table as lines of text."""
    return "\n".join(["TABLE:", " | ".join(headers), *(" | ".join(r) for r in rows)])


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables of a page, in order."""

    LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre"}
    SKIP = {"script", "style", "nav", "footer", "head", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.skip, self.parts, self.kind, self.table, self.row, self.cell = 0, [], None, None, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append({"kind": self.kind, "text": text, "table": None})
        self.kind = None

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag == "table":
            self.flush()
            self.table = []
        elif self.table is not None and tag == "tr":
            self.row = []
            self.table.append(self.row)
        elif self.table is not None and tag in ("td", "th"):
            self.cell = []
        elif tag in self.LEAVES or tag in ("div", "article", "section"):
            self.flush()
            self.kind = tag
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in ("td", "th") and self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.table is not None:
            rows = [r for r in self.table if r]
            if rows:
                self.blocks.append({"kind": "table", "text": table_text(rows[0], rows[1:]), "table": {"headers": rows[0], "rows": rows[1:]}})
            self.table = self.row = self.cell = None
        elif tag in self.LEAVES or tag in ("div", "article", "section"):
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif self.table is None:
            self.parts.append(data)


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Blocks of HTML pages, each a document of one page; tables keep headers and rows."""

    def run(frames):
        for f in frames:
            out = []
            for k, text in zip(f["k"], f["h"], strict=True):
                p = _Blocks()
                p.feed(text or "")
                p.close()
                p.flush()
                out += [(k, i, b["kind"], b["text"], b["table"]) for i, b in enumerate(p.blocks)]
            yield pd.DataFrame(out, columns=["document_id", "block_index", "kind", "text", "table_data"])

    made = pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h")).mapInPandas(run, "document_id string, block_index int, kind string, text string, table_data struct<headers:array<string>,rows:array<array<string>>>")
    kind = F.when(F.col("kind").rlike("^h[1-6]$"), "heading").when(F.col("kind") == "li", "list").otherwise(block_type(F.col("text"), F.col("kind") == "table"))
    return made.select("document_id", F.lit(1).alias("page_number"), "block_index", kind.alias("block_type"), "text", "table_data")
