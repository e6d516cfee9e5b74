"""CSV, Parquet and text outputs."""

from __future__ import annotations

import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": ""}


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_CSV, quoteAll=str(quote_all).lower()).csv(path)


def write_csv_per_document(df: DataFrame, path: str, name: str = "output_name", quote_all: bool = True) -> None:
    """One folder per output name with one file; documents of one name land in the same file."""
    df.repartition(name).write.mode("overwrite").partitionBy(name).options(**_CSV, quoteAll=str(quote_all).lower()).csv(path)


def name_csv_files(spark: SparkSession, path: str) -> list[str]:
    """Moves the file of each folder that write_csv_per_document made to `<output name>.csv`; returns these names.

    The driver renames one file after the other: for as many documents as it may list.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for folder in store.globStatus(jvm.org.apache.hadoop.fs.Path(top, "*=*")):
        files = store.globStatus(jvm.org.apache.hadoop.fs.Path(folder.getPath(), "part-*.csv"))
        if len(files) != 1:
            raise ValueError(f"{folder.getPath()} has {len(files)} files")
        value = urllib.parse.unquote(folder.getPath().getName().split("=", 1)[1])
        names.append(f"{value}.csv")
        store.rename(files[0].getPath(), jvm.org.apache.hadoop.fs.Path(top, names[-1]))
        store.delete(folder.getPath(), True)
    return sorted(names)


def write_parquet(df: DataFrame, path: str, partition: list[str] | None = None, block_bytes: int | None = None, mode: str = "overwrite", block_rows: int | None = None) -> None:
    """Snappy; row groups of at most block_bytes or block_rows, folders by partition columns."""
    writer = df.write.mode(mode).option("compression", "snappy")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    if block_rows:
        writer = writer.option("parquet.block.row.count.limit", block_rows)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def compact(spark: SparkSession, source: str, target: str, files: int, remove: bool = False) -> DataFrame:
    """The table in source written again as `files` files in another folder; a table of one file or none is left alone.

    With `remove` the source is deleted once the target is written and has as many rows.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compaction must not write to the folder it reads")
    parts = spark.read.parquet(source)
    if len(parts.inputFiles()) <= 1:
        return parts
    parts.repartition(files).write.mode("overwrite").parquet(target)
    out = spark.read.parquet(target)
    if remove:
        if out.count() != parts.count():
            raise RuntimeError(f"{target} lacks rows of {source}, which stays")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return out


def write_lines(df: DataFrame, path: str, numbered: bool = True) -> None:
    """A text file of lines in document order, with their page in front or as they are."""
    order = ["document_id", "page_number", "line_number"]
    line = F.concat(F.lit("Página "), F.col("page_number").cast("string"), F.lit(": "), "line_text") if numbered else F.col("line_text")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").text(path)
