"""Fetches from executors: files, CSV look-ups and API answers.

The number of partitions bounds how many requests run at once.  A request is
tried a bounded number of times; what fails is a row with its error.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.keys import api_tender, extension
from legajo.operators.relational import with_missing
from legajo.session import find_package

TRIES, WAIT, TIMEOUT = 6, 6.0, 30.0
_SCHEMA = "url string, status int, content binary, disposition string, content_type string, error string"


def download(url: str, path: str, timeout: float = TIMEOUT, chunk: int = 1 << 10) -> None:
    """One file to the driver, in chunks; raises on failure."""
    with urllib.request.urlopen(url, timeout=timeout) as answer, open(path, "wb") as out:
        while block := answer.read(chunk):
            out.write(block)


def _get(url: str, tries: int, wait: float, timeout: float, headers: Mapping[str, str]) -> tuple:
    error = None
    for attempt in range(tries):
        if attempt:
            time.sleep(wait)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as answer:
                return url, answer.status, answer.read(), answer.headers.get("Content-Disposition"), answer.headers.get("Content-Type"), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
    return url, None, None, None, None, error


def fetch(urls: DataFrame, column: str = "url", concurrency: int = 8, tries: int = TRIES, wait: float = WAIT, timeout: float = TIMEOUT, headers: Mapping[str, str] | None = None) -> DataFrame:
    """url, status, content, disposition, content_type, error of each distinct url that isn't null."""
    find_package(urls.sparkSession)
    headers = dict(headers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for url in frame["url"]:
                out = pd.DataFrame([_get(url, tries, wait, timeout, headers)], columns=[x.split()[0] for x in _SCHEMA.split(", ")])
                yield out.astype({"status": "Int32"})

    wanted = urls.select(F.col(column).alias("url")).where("url is not null").distinct()
    return wanted.repartition(concurrency).mapInPandas(run, _SCHEMA)


def with_extension(fetched: DataFrame) -> DataFrame:
    return fetched.withColumn("extension", extension("disposition", "content_type"))


def lookup_csv(rows: DataFrame, key: str, url: str, columns: list[str], sep: str = ",", **options) -> DataFrame:
    """rows with the named columns of the first line of the CSV behind url (with {key}); null where there is none."""
    prefix, suffix = url.split("{key}")
    asked = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key")).distinct()
    asked = asked.withColumn("url", F.concat(F.lit(prefix), "_key", F.lit(suffix)))
    answers = fetch(asked, "url", **options)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for frame in frames:
            out = []
            for where, content in zip(frame["url"], frame["content"], strict=True):
                first = next(csv.DictReader(io.StringIO((content or b"").decode("utf-8", "replace")), delimiter=sep), {})
                out.append([where, *[first.get(c) or None for c in columns]])
            yield pd.DataFrame(out, columns=["url", *columns])

    parsed = answers.select("url", "content").mapInPandas(run, "url string, " + ", ".join(f"`{c}` string" for c in columns))
    rest = [c for c in columns if c != key]
    found = asked.join(parsed, "url").select("_key", *rest)
    have = rows.drop(*rest)
    out = have.join(found, have[key].cast("string") == found["_key"], "left").drop("_key")
    return with_missing(out, columns)


def lookup_api(rows: DataFrame, key: str, url: str, token: str | None = None, **options) -> DataFrame:
    """rows with `tender`, the eight fields of the API's answer for the key; null fields where it failed."""
    prefix, suffix = url.split("{key}")
    asked = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key")).distinct()
    asked = asked.withColumn("url", F.concat(F.lit(prefix), "_key", F.lit(suffix)))
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    answers = fetch(asked, "url", headers=headers, **options).select("url", api_tender(F.col("content").cast("string")).alias("tender"))
    found = asked.join(answers, "url", "left").select("_key", "tender")
    return rows.join(found, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def read_url_csv(spark: SparkSession, url: str, sep: str = ",", timeout: float = TIMEOUT) -> DataFrame:
    """A small CSV behind a URL, all strings."""
    import csv
    import io

    with urllib.request.urlopen(url, timeout=timeout) as answer:
        lines = list(csv.reader(io.StringIO(answer.read().decode("utf-8")), delimiter=sep))
    names = ", ".join(f"`{c}` string" for c in lines[0])
    return spark.createDataFrame([tuple(x or None for x in r) for r in lines[1:]], names)
