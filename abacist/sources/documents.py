"""Text of uploaded files and of web pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Formats whose decoder is not part of this package.
UNDECODED = ("pdf", "png", "jpg", "jpeg")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploaded files as (path, name, content, modified)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content",
                        F.col("modificationTime").alias("modified"))


def extract_text(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds ``ext`` (after the last dot of the lowered name) and ``text``; a file that fails gives "".

    Bytes that are not UTF-8 are dropped. One file is one unit of work and never leaves its partition.
    """
    named = files.withColumn("ext", F.element_at(F.split(F.lower(name), r"\."), -1))
    schema = named.drop(content).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [decode(e, b) for e, b in zip(pdf["ext"], pdf[content])]
            yield pdf.drop(columns=content).assign(text=texts)

    return named.mapInPandas(run, schema)


def indexable(extracted: DataFrame) -> DataFrame:
    """Files with text; the others are not indexed."""
    return extracted.filter(F.col("text") != "")


def decode(ext: str, data: bytes | None) -> str:
    try:
        if ext in UNDECODED:
            return ""
        if ext in ("docx", "doc"):
            return _docx(data)
        if ext in ("xlsx", "xls"):
            return _xlsx(data)
        return data.decode("utf-8", errors="ignore")
    except Exception:  # a broken file is an empty file
        return ""


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    lines = []
    for paragraph in body.findall(f"{_WORD}p"):
        parts = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda e: "\t", f"{_WORD}br": lambda e: "\n"}
        lines.append("".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts))
    return "".join(line + "\n" for line in lines)


def _xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t"))
                      for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        lines = []
        for sheet in sheets:
            for row in ElementTree.fromstring(archive.read(sheet)).iter(f"{_SHEET}row"):
                cells = (_cell(c, shared) for c in row.findall(f"{_SHEET}c"))
                lines.append(" ".join(c for c in cells if c) + "\n")
    return "".join(lines)


def _cell(cell, shared: list[str]) -> str:
    """Text of a cell; empty for cells that count as false (no value, 0, FALSE)."""
    kind, value = cell.get("t"), cell.find(f"{_SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else ""
    if kind in ("str", "e"):
        return value.text
    return "" if float(value.text) == 0 else value.text


class _Page(HTMLParser):
    """Title and paragraph texts; an element stays open until its end tag, as in a forgiving parser."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    HIDDEN = frozenset(("script", "style", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None]] = []
        self.paragraphs: list[list[str]] = []
        self.title: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        text = None
        if tag == "p":
            text = []
            self.paragraphs.append(text)
        elif tag == "title" and self.title is None:
            text = self.title = []
        self.open.append((tag, text))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] in self.HIDDEN:
            return
        for _, text in self.open:
            if text is not None:
                text.append(data)


def page_text(html: str) -> tuple[str, str]:
    """(title, all paragraph texts joined by a space)"""
    page = _Page()
    page.feed(html)
    page.close()
    return "".join(page.title or []), " ".join("".join(p) for p in page.paragraphs)


def extract_pages(pages: DataFrame, crawled_at: datetime, url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, content, crawled_at) of each page, with the time of the crawl as ISO text; unreadable pages give no row."""
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).filter(F.col("html").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [page_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"url": pdf["url"], "title": [t for t, _ in found], "content": [c for _, c in found]})

    return rows.mapInPandas(run, "url STRING, title STRING, content STRING").withColumn("crawled_at", F.lit(crawled_at.isoformat()))
