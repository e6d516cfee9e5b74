"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.

1. language_id: documents without letters, or far from every language, go.
2. near_duplicates: of documents linked by Jaccard >= 0.8 on five-word shingles
   one stays, that of the least doc_id.
3. decontaminate: documents of which a twentieth lies in benchmark windows go.
4. mix: sources are brought to their target weights; a document's row is
   repeated as often as it is taken, or left out.
5. shard: rows are ordered along a Hilbert curve and cut into 16 shards.

Every stage keeps all columns of its docs, whatever they are called (the last
one replaces those that have the name of one it adds), and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm import decontaminate, hilbert, jaccard_join, language_id, mixture
from legajo.llm.common import columns, delete, documents, scratch
from legajo.session import fresh_folder

LEAST_SCORE = 0.3  # of language identification: held-out documents have 0.47 and more, their first words 0.31, junk of 20 words at most 0.29
SHARDS = 16


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near to one of the languages learned from all of docs.

    Null and blank texts, and texts without letters, go; rows without a lang teach
    nothing and are judged like others; repeated rows stay, each judged alike.
    Where nothing can be learned all rows go.
    """
    names = ("_legajo_lang", "_legajo_score")
    judged = language_id.identify(docs, language_id.learn(docs), names=names)
    return judged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard >= 0.8 on five-word shingles connect: that of the least doc_id.

    Null ids come last; of rows that share an id the least text hash stays, of
    rows repeated in full one.  Null and blank texts are linked with nothing and stay,
    once for each doc_id.  Texts under five words are one shingle.
    """
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items.

    Null and blank texts stay, repeated rows are judged alike; null items count for nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: up to twice, or not at all.

    A null source is one of its own; texts without words aren't taken; equal rows
    and null ids are drawn one by one.
    """
    return mixture.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it; null texts have size 1, equal rows different slots."""
    return hilbert.shard_rows(docs, SHARDS).withColumn("law", F.lit("rows"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage read or put aside is deleted once its own rows are written."""
    docs = documents(spark, sf_dir)
    folder, before = fresh_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no parity sketches, and the later stages depend on that one: the tests compare run() with plain Python.
ORACLE_SQL = None
