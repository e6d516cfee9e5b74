"""Lines, outlines and the sections between outline titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.keys import page_line
from legajo.functions.text import NORMALIZERS, SPLIT_HEADINGS, clean_blanking, clean_canonical

Normalizer = Callable[[Column | str], Column]


def number_lines(raw: DataFrame, normalizer: str | Normalizer = "canonical", pairs: tuple[tuple[str, str], ...] = SPLIT_HEADINGS) -> DataFrame:
    """document_id, page_number, line_number, line_text from (document_id, page_number, idx, line_text).

    idx counts a page's raw lines from 0.  Lines are normalized; the halves of a
    known heading are joined and take one number; blank lines take a number but
    are left out.
    """
    clean = NORMALIZERS[normalizer] if isinstance(normalizer, str) else normalizer
    page = Window.partitionBy("document_id", "page_number").orderBy("idx")
    lines = raw.withColumn("line_text", clean("line_text"))
    before, after = F.lag("line_text").over(page), F.lead("line_text").over(page)
    lines = lines.withColumn("_before", before).withColumn("_after", after)
    second, joined = F.lit(False), F.col("line_text")
    for a, b in pairs:
        second = second | (F.col("_before").eqNullSafe(a) & F.col("line_text").eqNullSafe(b))
        joined = F.when((F.col("line_text") == a) & (F.col("_after") == b), F.lit(f"{a} {b}")).otherwise(joined)
    lines = lines.withColumn("_second", second.cast("int")).withColumn("line_text", joined)
    lines = lines.withColumn("line_number", (F.col("idx") + 1 - F.sum("_second").over(page)).cast("int"))
    lines = lines.where((F.col("_second") == 0) & (F.col("line_text") != ""))
    return lines.select("document_id", "page_number", "line_number", "line_text")


def with_position(raw: DataFrame) -> DataFrame:
    """raw lines (document_id, page_number, idx) with `position`: their number through the whole document from 1, blank ones counted.

    Only counts of lines per page meet in the window over a document.
    """
    pages = raw.groupBy("document_id", "page_number").agg(F.count("*").alias("_lines"), F.min("idx").alias("_first"))
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    same = raw["document_id"].eqNullSafe(pages["document_id"]) & raw["page_number"].eqNullSafe(pages["page_number"])
    out = raw.join(pages, same).drop(pages["document_id"]).drop(pages["page_number"])
    return out.withColumn("position", (F.col("_before") + F.col("idx") - F.col("_first") + 1).cast("int")).drop("_lines", "_first", "_before")


def match_titles(outlines: DataFrame, lines: DataFrame, clean: Normalizer = clean_canonical) -> DataFrame:
    """outlines with the line_number of the line of the same page that equals the title, null if there is none."""
    left = outlines.withColumn("_title", clean("title"))
    right = lines.select(
        F.col("document_id").alias("_document"), F.col("page_number").alias("_page"), clean("line_text").alias("_line"), F.col("line_number").cast("int").alias("line_number")
    )
    same = F.col("document_id").eqNullSafe(F.col("_document")) & F.col("page").eqNullSafe(F.col("_page")) & F.col("_title").eqNullSafe(F.col("_line"))
    return left.join(right, same, "left").drop("_title", "_document", "_page", "_line")


def first_equal_line(titles: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """titles (key, document_id, title) with the first line of the whole document that equals the title.

    Lines are numbered through the document; `position` of lines is that number (see with_position).
    """
    found = titles.join(lines.select("document_id", F.col("line_text").alias("title"), "page_number", "line_number", "position"), ["document_id", "title"], "left")
    rest = [c for c in titles.columns if c not in key]
    best = F.min_by(F.struct("page_number", "line_number", "position"), "position").alias("_at")
    out = found.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], best)
    return out.select(*key, *rest, F.col("_at.page_number").alias("matched_page"), F.col("_at.position").alias("matched_line"))


def first_containing_line(titles: DataFrame, lines: DataFrame, key: list[str], clean: Normalizer = clean_blanking) -> DataFrame:
    """titles (key, document_id, page, title) with the first raw line of the page that contains the title, and page-line."""
    left = titles.withColumn("_title", clean(F.lower("title")))
    right = lines.select("document_id", F.col("page_number").alias("page"), clean(F.lower("line_text")).alias("_line"), "line_number")
    hit = F.when(F.instr("_line", F.col("_title")) > 0, F.col("line_number"))
    rest = [c for c in titles.columns if c not in key]
    out = left.join(right, ["document_id", "page"], "left").groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], F.min(hit).alias("linea"))
    return out.withColumn("pagina_linea", page_line("page", "linea"))


def section_bounds(outlines: DataFrame) -> DataFrame:
    """outlines (with `ord`, the input order) with end_page and line_end: where the next title begins.

    The last section of a document ends on the page after its own, open-ended.
    Titles without a line come last on their page.
    """
    order = Window.partitionBy("document_id").orderBy("page", F.col("line_number").asc_nulls_last(), "ord")
    known = outlines.where(F.col("document_id").isNotNull())
    end = F.coalesce(F.lead("page").over(order), F.col("page") + 1)
    return known.withColumn("end_page", end).withColumn("line_end", F.lead("line_number").over(order))


def assemble_sections(outlines: DataFrame, lines: DataFrame, by_page: bool = True) -> DataFrame:
    """One row per title with the lines up to the next: content, content_length (lines), line_start, line_end.

    `ord` must identify the rows of outlines.  Sections may overlap, so this is a
    range join.  A section is spread over its pages first, which makes (document,
    page) the join key; without by_page documents are joined whole and pages
    compared after that, which pays only where sections span very many empty pages.
    """
    bounds = section_bounds(outlines)
    text = lines.select("document_id", "page_number", F.col("line_number").alias("_number"), "line_text")
    if by_page:
        spread = bounds.withColumn("page_number", F.explode(F.sequence("page", F.greatest("page", "end_page"))))
        met = spread.join(text, ["document_id", "page_number"], "left")
    else:
        met = bounds.join(text.withColumnRenamed("document_id", "_document"), (F.col("document_id") == F.col("_document")) & F.col("page_number").between(F.col("page"), F.col("end_page")), "left")
    early = (F.col("page_number") == F.col("page")) & F.coalesce(F.col("_number") < F.col("line_number"), F.lit(False))
    late = (F.col("page_number") == F.col("end_page")) & F.coalesce(F.col("_number") >= F.col("line_end"), F.lit(False))
    inside = ~F.coalesce(early | late, F.lit(False)) & F.col("line_text").isNotNull()
    line = F.when(inside, F.struct("page_number", "_number", "line_text"))
    rest = [c for c in outlines.columns if c not in ("ord", "line_number")]
    out = met.groupBy("ord").agg(
        *[F.first(c).alias(c) for c in rest], F.first("line_number").alias("line_start"), F.first("line_end").alias("line_end"), F.array_sort(F.collect_list(line)).alias("_lines")
    )
    content = F.array_join(F.transform("_lines", lambda x: x["line_text"]), "\n")
    return out.select("ord", *rest, "line_start", "line_end", content.alias("content"), F.size("_lines").alias("content_length"))


def clean_sections(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned sections, report of those with consecutive duplicate lines).

    The report is taken before sections without lines are left out.  Both are
    lazy and share one plan: who writes both should write or persist sections first.
    """
    from legajo.functions.text import drop_consecutive_duplicates, halve_marks, has_consecutive_duplicates

    known = sections.where(F.col("document_id").isNotNull()).withColumn("_marks", halve_marks("content"))
    flagged = known.withColumn("has_duplicates", has_consecutive_duplicates("_marks"))
    report = flagged.where("has_duplicates").drop("_marks")
    cleaned = flagged.withColumn("cleaned_content", drop_consecutive_duplicates("_marks")).drop("_marks")
    return cleaned.where("content_length > 0"), report
