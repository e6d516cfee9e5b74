"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per value, nulls left out, by value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(key)


def match_rate(matched: DataFrame, column: str = "line_number") -> DataFrame:
    """total, matched and the rate in percent (of the rows after fan-out)."""
    rate = F.when(F.count("*") > 0, 100.0 * F.count(column) / F.count("*"))
    return matched.agg(F.count("*").alias("total"), F.count(column).alias("matched"), F.round(rate, 2).alias("match_rate"))


def section_summary(sections: DataFrame) -> DataFrame:
    return sections.agg(
        F.count("*").alias("n_sections"),
        F.countDistinct("document_id").alias("n_documents"),
        F.countDistinct("nro_licitacion").alias("n_tenders"),
        F.round(F.avg("content_length"), 2).alias("mean_length"),
    )


def duplicate_report(sections: DataFrame) -> DataFrame:
    """Sections with duplicates among all, and the number of those with any line."""
    return sections.agg(F.sum(F.col("has_duplicates").cast("long")).alias("n_duplicates"), F.count(F.when(F.col("content_length") > 0, 1)).alias("n_sections"))


def distinct_titles(titles: DataFrame, file: str = "nombre_archivo", title: str = "titulo") -> DataFrame:
    """Distinct (title, file), null titles left out."""
    return titles.where(F.col(title).isNotNull()).select(title, file).distinct()


def nested_lines(lines: DataFrame) -> DataFrame:
    """Per document and page the ordered lines as an array."""
    line = F.struct("line_number", "line_text")
    return lines.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def counted(df: DataFrame, name: str = "rows", **counts: Column) -> tuple[DataFrame, Observation]:
    """df and an observation of its rows, and of those that meet each condition, filled by the action that runs it."""
    seen = Observation(name)
    sums = [F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]
    return df.observe(seen, F.count("*").alias("total"), *sums), seen
