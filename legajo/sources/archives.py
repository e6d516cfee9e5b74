"""Members of zip archives.  rar needs a tool that can't be assumed: such files are reported, not read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.keys import file_key
from legajo.session import find_package

#: Fixed value: how the member that holds a tender's terms ends.
TERMS_SUFFIX = "01-pliego-de-bases-y-condiciones-pbc.pdf"
_SCHEMA = "path string, member string, content binary, error string"


def _extract(suffix: str, exact: bool):
    def one(path: str, content: bytes) -> tuple:
        if path.lower().endswith(".rar") or content[:4] == b"Rar!":
            return path, None, None, "unsupported: rar"
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in z.namelist():
                    if name == suffix or not exact and name.endswith(suffix):
                        return path, name, z.read(name), None
            return path, None, None, f"no member {suffix}"
        except Exception as e:
            return path, None, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([one(path, content)], columns=["path", "member", "content", "error"])

    return run


def extract_members(archives: DataFrame, suffix: str = TERMS_SUFFIX, exact: bool = False, must: bool = False) -> DataFrame:
    """path, member, content, error: of each archive (path, content) the first member that ends with (or is) suffix.

    With `must` an archive without it fails the job.
    """
    find_package(archives.sparkSession)
    out = archives.select("path", "content").mapInPandas(_extract(suffix, exact), _SCHEMA)
    wrong = F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")
    return out.withColumn("error", F.when(F.col("error").isNotNull(), wrong)) if must else out


def read_archives(spark: SparkSession, path: str, pattern: str = "*.{zip,rar}") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def named(members: DataFrame, date: Column | str, category: Column | str, nro: Column | str, extension: str = ".pdf") -> DataFrame:
    """members with file_name, the key of their tender and the extension."""
    return members.withColumn("file_name", F.concat(file_key(date, category, nro), F.lit(extension)))
