"""PDF scans: text lines and outlines, by a pluggable backend.

A backend turns bytes into pages of text and outline entries.  The usual
libraries are imported only when asked for; `register` adds others.  A file that
can't be read gives a row with an error, not a failed job.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.keys import document_id_parts, file_name, file_stem, page_number
from legajo.functions.text import clean_outline
from legajo.operators.sections import first_containing_line, number_lines
from legajo.session import find_package


class Entry(NamedTuple):
    title: str
    page: int | None  # from 0
    depth: int  # the root list is 0


class Backend(Protocol):
    def pages(self, content: bytes) -> list[str]: ...

    def outline(self, content: bytes) -> list[Entry]: ...


class LibraryBackend:
    """Text by pdfplumber, outlines by PyPDF2; both are optional."""

    def pages(self, content: bytes) -> list[str]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [p.extract_text() or "" for p in pdf.pages]

    def outline(self, content: bytes) -> list[Entry]:
        from PyPDF2 import PdfReader

        reader = PdfReader(io.BytesIO(content))
        found: list[Entry] = []

        def walk(items: list, depth: int) -> None:
            for item in items:
                if isinstance(item, list):
                    walk(item, depth + 1)
                    continue
                try:
                    page = reader.get_destination_page_number(item)
                except Exception:
                    page = None  # a dangling destination
                found.append(Entry(str(item.title), page, depth))

        walk(list(reader.outline), 0)
        return found


class TextBackend:
    """Plain text in place of a PDF: form feeds part pages, `#` lines are outline entries by level."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    def outline(self, content: bytes) -> list[Entry]:
        out = []
        for n, page in enumerate(self.pages(content)):
            for line in page.split("\n"):
                if line.startswith("#"):
                    out.append(Entry(line.lstrip("#").strip(), n, len(line) - len(line.lstrip("#"))))
        return out


_BACKENDS: dict[str, Callable[[], Backend]] = {"library": LibraryBackend, "text": TextBackend}


def register(name: str, make: Callable[[], Backend]) -> None:
    _BACKENDS[name] = make


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    find_package(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def scan_raw_lines(spark: SparkSession, path: str, backend: str = "library", pattern: str = "*.pdf") -> DataFrame:
    """document_id, page_number (from 1), idx (from 0), line_text, error: a page's lines as they are."""
    make = _BACKENDS[backend]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(where, p + 1, i, line, None) for p, text in enumerate(reader.pages(content)) for i, line in enumerate(text.split("\n"))]
                except Exception as e:
                    rows = [(where, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=["path", "page_number", "idx", "line_text", "error"])
                yield out.astype({"page_number": "Int32", "idx": "Int32"})

    rows = _files(spark, path, pattern).mapInPandas(run, "path string, page_number int, idx int, line_text string, error string")
    return rows.select(file_stem("path").alias("document_id"), "page_number", "idx", "line_text", "error")


def scan_lines(spark: SparkSession, path: str, backend: str = "library", normalizer: str = "canonical", pattern: str = "*.pdf") -> DataFrame:
    """document_id, page_number, line_number, line_text, processed_date of all readable files."""
    raw = scan_raw_lines(spark, path, backend, pattern).where("error is null")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return number_lines(raw, normalizer).withColumn("processed_date", now)


def scan_outline(spark: SparkSession, path: str, backend: str = "library", depth: int | None = 2, page_offset: int = 1, pattern: str = "*.pdf") -> DataFrame:
    """Outline entries of one depth (None: all) as document_id, year, category_id, nro_licitacion, title, page, depth, position."""
    make = _BACKENDS[backend]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(where, e.title, e.page, e.depth, i) for i, e in enumerate(reader.outline(content))]
                except Exception:
                    rows = []  # the line scan tells which files can't be read
                out = pd.DataFrame(rows, columns=["path", "title", "page", "depth", "position"])
                yield out.astype({"page": "Int32", "depth": "Int32", "position": "Int32"})

    rows = _files(spark, path, pattern).mapInPandas(run, "path string, title string, page int, depth int, position int")
    rows = rows if depth is None else rows.where(F.col("depth") == depth)
    rows = rows.withColumn("document_id", file_stem("path")).withColumn("_parts", document_id_parts("document_id"))
    return rows.select("document_id", "_parts.*", clean_outline("title").alias("title"), page_number("page", page_offset).alias("page"), "depth", "position")


def outline_positions(spark: SparkSession, path: str, backend: str = "library", pattern: str = "*.pdf") -> DataFrame:
    """titulo, pagina, linea, pagina_linea and archivo of each outline entry of any depth with a title.

    linea: the first raw line of the entry's page that contains the title, in
    lower case and without doubled marks; null where none does.
    """
    titles = scan_outline(spark, path, backend, depth=None, pattern=pattern).where("title <> ''")
    titles = titles.select("document_id", "position", "page", "title")
    lines = scan_raw_lines(spark, path, backend, pattern).where("error is null")
    lines = lines.select("document_id", "page_number", (F.col("idx") + 1).alias("line_number"), "line_text")
    found = first_containing_line(titles, lines, ["document_id", "position"])
    names = _files(spark, path, pattern).select(file_stem("path").alias("document_id"), file_name("path").alias("archivo")).distinct()
    out = found.join(names, "document_id")
    return out.select(F.col("title").alias("titulo"), F.col("page").alias("pagina"), F.col("linea").cast("int").alias("linea"), "pagina_linea", "archivo")


class HtmlConverter(Protocol):
    """Hook for an ML converter from PDF to HTML; none is built in."""

    def convert(self, content: bytes) -> str: ...


def scan_as_html(spark: SparkSession, path: str, make: Callable[[], HtmlConverter], pattern: str = "*.pdf") -> DataFrame:
    """document_id, html, error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = make()
        for frame in frames:
            rows = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((where, converter.convert(content), None))
                except Exception as e:
                    rows.append((where, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "html", "error"])

    rows = _files(spark, path, pattern).mapInPandas(run, "path string, html string, error string")
    return rows.select(file_stem("path").alias("document_id"), "html", "error")
