"""Relational operators: renames, projections, filters, joins, unions, first-per-key."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOG = logging.getLogger(__name__)

Filter = str | Callable[[DataFrame], DataFrame]


# --- columns -----------------------------------------------------------------


#: Steps of a path that its column's name leaves out (the last step always stays).
ROOT_STEP, LIST_STEP = "compiledRelease", "0"
_WORD_ENDS = re.compile(r"(?<=[a-z])(?=[A-Z])|[\W_]+")


def column_rule(name: str) -> str:
    """`compiledRelease/tender/documents/0/documentTypeDetails` -> `tender_documents_document_type_details`: the words of a path's steps."""
    *steps, last = name.split("/")
    inner = [s for i, s in enumerate(steps) if s != ROOT_STEP and (i == 0 or s != LIST_STEP)]
    return "_".join(word.lower() for step in [*inner, last] for word in _WORD_ENDS.split(step) if word)


def rename_by(df: DataFrame, rule: Callable[[str], str] = column_rule) -> DataFrame:
    return df.toDF(*map(rule, df.columns))


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Unknown names are ignored; a map of which no name is known is reported."""
    if not set(names) & set(df.columns):
        _LOG.warning("no column is called %s", ", ".join(names))
    return df.withColumnsRenamed(dict(names))


def rename_from_json(df: DataFrame, text: str) -> DataFrame:
    return rename_map(df, json.loads(text))


def required(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """Of columns that share a name the first stays."""
    numbered = df.toDF(*[f"{i}" for i in range(len(df.columns))])
    first: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c, f"{i}")
    return numbered.select(*[F.col(i).alias(c) for c, i in first.items()])


def with_missing(df: DataFrame, columns: Iterable[str], kind: str = "string") -> DataFrame:
    """Columns that are missing are added as null."""
    return df.select("*", *[F.lit(None).cast(kind).alias(c) for c in columns if c not in df.columns])


def replace_content(df: DataFrame, cleaned: str = "cleaned_content", content: str = "content") -> DataFrame:
    """The cleaned column takes the place of the original."""
    return df.withColumn(content, F.col(cleaned)).drop(cleaned) if cleaned in df.columns else df


def all_strings(df: DataFrame, fill: str | None = "") -> DataFrame:
    out = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return out if fill is None else out.na.fill(fill)


# --- filters -----------------------------------------------------------------


def where_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """All columns equal their value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()], F.lit(True)))


def where_literal(df: DataFrame, column: str, value: object, limit: int | None = None, order: Iterable[str | Column] = ()) -> DataFrame:
    """Equality with a literal cast to the column's type; optionally the first rows in an order."""
    out = df.where(F.col(column) == F.lit(value).cast(df.schema[column].dataType))
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def where_given(df: DataFrame, limit: int | None = None, order: Iterable[str | Column] = (), must: bool = False, **values: object) -> DataFrame:
    """Only values that are given filter; with `must` an empty result raises."""
    out = where_equal(df, {c: v for c, v in values.items() if v is not None})
    out = out.orderBy(*order) if order else out
    out = out if limit is None else out.limit(limit)
    if must and out.isEmpty():
        raise ValueError("no row meets the filters")
    return out


def where_method(df: DataFrame, column: str, method: Filter, order: Iterable[str | Column] = ()) -> DataFrame:
    """`unique` (first per value in an order, which must be given: rows have none of their own), `non_null`, `positive`, or a callable."""
    if callable(method):
        return df.transform(method)
    if method == "unique":
        if not list(order):
            raise ValueError("unique needs an order that tells which row is first")
        return first_per_key(df, [column], order)
    if method == "non_null":
        return df.where(F.col(column).isNotNull())
    if method == "positive":
        return df.where(F.col(column) > 0)
    raise ValueError(f"unknown filter {method!r}")


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others (null counts as no)."""
    yes = F.coalesce(condition, F.lit(False))
    return df.where(yes), df.where(~yes)


# --- keys --------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: list[str], order: Iterable[str | Column]) -> DataFrame:
    """First row of each key (nulls are one key) in an order that should break all ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], date: str, ties: Iterable[str | Column] = ()) -> DataFrame:
    return first_per_key(df, keys, [F.col(date).desc_nulls_last(), *ties])


# --- joins -------------------------------------------------------------------


def left_join_nullsafe(left: DataFrame, right: DataFrame, on: str | Mapping[str, str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join in which null equals null.  Other columns that both have get a suffix.

    The small side, if there is one, is found by its size: no hint is given.
    """
    on = {on: on} if isinstance(on, str) else dict(on)
    shared = (set(left.columns) & set(right.columns)) - set(on) - set(on.values())
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    mine = right.withColumnsRenamed({r: f"_right_{r}" for r in on.values()})
    condition = reduce(lambda a, b: a & b, [left[a].eqNullSafe(mine[f"_right_{b}"]) for a, b in on.items()])
    out = left.join(mine, condition, "left")
    drop = [f"_right_{r}" for a, r in on.items() if a == r]
    keep = {f"_right_{r}": r for a, r in on.items() if a != r}
    return out.drop(*drop).withColumnsRenamed(keep)


def missing_keys(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Rows of wanted whose key (compared as text) present lacks; null keys are left out."""
    have = present.where(F.col(on).isNotNull()).select(F.col(on).cast("string").alias("_have")).distinct()
    rows = wanted.where(F.col(on).isNotNull())
    return rows.join(have, F.col(on).cast("string") == F.col("_have"), "left_anti")


def present_keys(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    have = present.where(F.col(on).isNotNull()).select(F.col(on).cast("string").alias("_have")).distinct()
    return wanted.join(have, F.col(on).cast("string") == F.col("_have"), "left_semi")


# --- sets and order ----------------------------------------------------------


def union_all(frames: Iterable[DataFrame | None]) -> DataFrame:
    """By name; missing columns become null, missing frames are skipped."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Iterable[DataFrame | None]) -> DataFrame:
    return union_all(frames).distinct()


def distinct_sorted(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    rest = [c for c in columns if c != by]
    return required(df, columns).distinct().orderBy(F.col(by).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])


def page_of_rows(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows whose ordinal column lies in [start, end)."""
    return df.where((F.col(order) >= start) & (F.col(order) < end))
