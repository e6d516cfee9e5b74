"""The reference pipelines end to end, each one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions import keys
from legajo.functions.text import is_uppercase
from legajo.operators.relational import first_per_key, latest_per_key, left_join_nullsafe, split_by, union_all, where_equal
from legajo.operators.sections import assemble_sections, clean_sections, match_titles


def tender_metadata(
    documents: DataFrame, records: DataFrame, categories: DataFrame, kinds: Mapping[str, object], date: str = "tender_documents_date_published", ties: tuple[str | Column, ...] = ("tender_documents_url",)
) -> DataFrame:
    """One year's tenders: documents of a kind, the latest of each tender, with its record and category.

    Dates are compared as moments, whatever their offsets and formats; one that can't be read comes last.

    A category whose name is null matches tenders whose category is null, as often as it occurs.
    """
    dated = where_equal(documents, kinds).withColumn(date, keys.timestamp(date))
    latest = latest_per_key(dated, ["tender_id"], date, ties)
    out = left_join_nullsafe(latest, records, "tender_id")
    out = out.withColumns(
        {
            "nro_licitacion": keys.nro_licitacion("open_contracting_id"),
            "version_pliego": keys.version_pliego("tender_documents_url"),
            "categoria": keys.categoria("tender_main_procurement_category_details"),
            "year": keys.year("date"),
        }
    )
    return left_join_nullsafe(out, categories, "categoria")


def merge_years(years: list[DataFrame | None], key: str = "nro_licitacion") -> DataFrame:
    """All years, earliest first; of each tender number the first row stays."""
    marked = [y.withColumn("_year", F.lit(i)) for i, y in enumerate(years) if y is not None]
    order = ["_year", F.col("date").asc_nulls_last(), F.col("tender_id").asc_nulls_last()]
    return first_per_key(union_all(marked), [key], order).drop("_year")


def sections(outlines: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned sections, report of duplicates) from outlines (with ord) and lines."""
    matched = match_titles(outlines, lines)
    # a title that occurs twice on its page gives two sections, in the order of their lines
    matched = matched.withColumn("ord", F.struct("ord", "line_number"))
    return clean_sections(assemble_sections(matched, lines))


def clause_table(documents: DataFrame, json: str = "json") -> DataFrame:
    """The clauses of JSON documents, flat, with the name of the document's output; broken JSON gives no rows."""
    rows = documents.withColumn("output_name", keys.output_name(json)).withColumn("_c", F.explode(keys.clauses(json)))
    return rows.select(*[c for c in documents.columns if c != json], "output_name", "_c.*")


def unique_titles(titles: DataFrame, order: list[str | Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first row of each title, those in upper case, the others) from (titulo, nombre_archivo)."""
    first = first_per_key(titles.where(F.col("titulo").isNotNull()), ["titulo"], order)
    upper, other = split_by(first, is_uppercase("titulo"))
    return first, upper, other
