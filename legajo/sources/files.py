"""Scans of CSV, Parquet, JSON, HTML and directory listings."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.functions.keys import file_name, nulled
from legajo.functions.text import element_texts

_LOG = logging.getLogger(__name__)

Paths = str | list[str]
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) leads to anything, in whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return bool(found)


def present(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def read_csv(spark: SparkSession, path: Paths, schema: T.StructType | None = None, sep: str = ",", null_tokens: bool = True) -> DataFrame:
    """Typed with a schema; else all strings, in which null tokens become null."""
    reader = spark.read.options(**_CSV, sep=sep)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    return df.select(*[nulled(F.col(f"`{c}`")).alias(c) for c in df.columns]) if null_tokens else df


def read_csv_inferred(spark: SparkSession, path: Paths, sep: str = ",") -> DataFrame:
    """Types inferred: one more pass over the data, for exploration only."""
    return spark.read.options(**_CSV, sep=sep, inferSchema="true").csv(path)


def readable(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], dict[str, str]]:
    """(paths whose first rows can be read as CSV, the errors of the others), which are logged."""
    good, bad = [], {}
    for path in paths:
        try:
            if not spark.read.options(**_CSV).csv(path).columns:
                raise ValueError("no columns")
            good.append(path)
        except Exception as e:
            bad[path] = f"{type(e).__name__}: {e}"
            _LOG.error("%s can't be read: %s", path, bad[path])
    return good, bad


def read_csv_years(spark: SparkSession, template: str, years: Iterable[int], schema: T.StructType) -> DataFrame:
    """One table of the yearly files that exist and can be read; template has {year}.  Those left out are logged."""
    wanted = [template.format(year=y) for y in years]
    here = present(spark, wanted)
    for path in set(wanted) - set(here):
        _LOG.warning("%s is missing", path)
    paths, _ = readable(spark, here)
    if not paths:
        return spark.createDataFrame([], schema)
    return read_csv(spark, paths, schema)


def read_csv_suffix(spark: SparkSession, folder: str, suffix: str) -> DataFrame | None:
    """All CSV files of a folder whose names end with suffix (`_{category}.csv`), as strings; None if there is none."""
    path = f"{folder.rstrip('/')}/*{suffix}"
    return read_csv(spark, path) if exists(spark, path) else None


def read_column_with_file(spark: SparkSession, path: Paths, column: str = "titulo", file: str = "nombre_archivo") -> DataFrame:
    """One column of many CSV files with the name of its file."""
    df = spark.read.options(**_CSV).csv(path)
    return df.select(nulled(F.col(column)).alias(column), F.col("_metadata.file_name").alias(file))


def read_parquet(spark: SparkSession, path: Paths, schema: T.StructType | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)


def read_parquet_checked(spark: SparkSession, path: Paths, columns: Iterable[str]) -> DataFrame:
    """Raises unless the columns are those expected, in any order."""
    df = read_parquet(spark, path)
    if set(df.columns) != set(columns):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(columns)}")
    return df


def read_json_documents(spark: SparkSession, path: Paths) -> DataFrame:
    """path, json and is_valid: whole JSON files; broken ones are marked instead of lost."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return df.withColumn("is_valid", F.try_parse_json("json").isNotNull())


def read_html(spark: SparkSession, path: Paths, tag: str = "h3") -> DataFrame:
    """path, position, text of each element of the tag."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.select("path", F.posexplode(element_texts("value", tag)).alias("position", "text"))


def list_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """path, name and size of the files; their content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    try:
        return reader.load(path).select("path", file_name("path").alias("name"), F.col("length").alias("size"))
    except (AnalysisException, Py4JJavaError) as e:
        if not exists(spark, path):
            return spark.createDataFrame([], "path string, name string, size long")
        raise e
