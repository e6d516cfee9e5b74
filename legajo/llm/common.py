"""Shared plumbing of the llm operators: lineage cuts, document keys, global ranks."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.session import find_package, fresh_folder, spread

_SHORT = 2.0  # seconds
_folders: list[list[str]] = []  # what `scratch` will delete, one list for each that is open
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 20_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def tune(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch may hold, so that very long texts don't fill a worker; a session's own lower bounds stay.

    Plans read these settings when they run, so they can't be put back here.
    """
    find_package(spark)
    for name, most in _BATCH.items():
        own = spark.conf.get(name)
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(name, str(most))
    return spark


def quoted(name: str) -> Column:
    """The column of exactly this name, which may hold dots and backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lost executors recompute nothing before it.

    The shuffle files behind it are released.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "cut")
    if _folders:
        _folders[-1].append(path)
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    if time.monotonic() - began > _SHORT:  # shorter jobs leave little behind
        release(spark)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever file system it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end what `cut` wrote inside: for work whose result is written by then."""
    _folders.append([])
    try:
        yield
    finally:
        for path in _folders.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    It does so when the driver's JVM collects the plans that own them; a plan
    is held until the listeners have seen its last event, so this waits a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def ranked(df: DataFrame, order: list[str | Column], name: str = "_rank", sums: dict[str, str] | None = None) -> DataFrame:
    """Global 0-based rank of each row in `order`, without sending all rows through one task.

    Rows are range-partitioned and sorted, and written once with their place in
    the partition; only one row per partition meets in a single task, to turn
    partition sizes into offsets.  `order` should be a total order up to equal
    rows, so that reruns agree and no partition gets all rows of a hot value.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(_up_to_previous())
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, inside + F.col("_offset")).drop("_part", "_place", "_offset")


def _up_to_previous():
    from pyspark.sql import Window

    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _bloom(keys: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter of 2^bits bits over `key`: at most 2^(bits - 6) rows, however many keys there are."""
    word, bit = _spot(bits)
    return cut(keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _spot(bits: int) -> tuple[Column, Column]:
    spot = F.xxhash64("key").bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(spot, 6), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))")


def _tested(df: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    word, bit = _spot(bits)
    out = df.withColumn("_word", word).join(F.broadcast(words), "_word", "left")
    return out.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))


def narrowed(df: DataFrame, keys: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of df whose `key` may be among keys, by a Bloom filter of fixed size: less to shuffle.

    With more keys than bits it lets more rows through.
    """
    return _tested(df, _bloom(keys, bits), bits).where("_maybe").select(*columns(df))


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, text) with one row per document, and where needed (key, doc_id, copies).

    Usually doc_id is unique and not null, is the key itself, and the second
    value is None.  Else each distinct (doc_id, text) is a document of its own;
    keys follow (doc_id nulls last, text hash), and rows repeated in full share
    a key and so a result.  Columns beside doc_id and text are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    odd = own.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 or doc_id is null")
    if odd.isEmpty():
        return own.select(F.col("doc_id").alias("key"), "text"), None
    mark = own.withColumn("_t", F.coalesce(F.xxhash64("text"), F.lit(0))).withColumn("_s", F.coalesce(F.length("text"), F.lit(-1)))
    many = mark.groupBy("doc_id", "_t", "_s").agg(F.count("*").alias("copies"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_t"), F.col("_s")]
    keys = cut(ranked(many, order, "key"))
    hot = mark.dropDuplicates(["doc_id", "_t", "_s"])
    same = [hot.doc_id.eqNullSafe(keys.doc_id), hot["_t"] == keys["_t"], hot["_s"] == keys["_s"]]
    texts = hot.join(keys, same).select("key", "text")
    return texts, keys.select("key", "doc_id", "copies", "_t", "_s")


def with_key(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """(key, row): the key that keyed() gave to each row, and the whole row, whatever its columns are called."""
    row = F.struct(*columns(docs)).alias("row")
    ident = F.col("doc_id").cast("long")
    if keys is None:
        return docs.select(ident.alias("key"), row)
    marks = docs.select(ident.alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t"), F.coalesce(F.length("text"), F.lit(-1)).alias("_s"), row)
    own = keys.select("key", F.col("doc_id").alias("_id2"), F.col("_t").alias("_t2"), F.col("_s").alias("_s2"))
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_t") == F.col("_t2")) & (F.col("_s") == F.col("_s2"))
    return marks.join(own, same).select("key", "row")


def without(docs: DataFrame, keys: DataFrame, bits: int = 23) -> DataFrame:
    """Rows of docs (with `key`) whose key is not among keys; only rows that a Bloom filter suspects are shuffled."""
    table = cut(keys.select("key").distinct())
    words = _bloom(table, bits)
    clear = _tested(docs, words, bits).where("not _maybe").select(*columns(docs))
    maybe = _tested(docs, words, bits).where("_maybe").select(*columns(docs))
    return clear.unionByName(maybe.join(table, "key", "left_anti").select(*columns(docs)))


def restored(result: DataFrame, keys: DataFrame | None, also: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `result` (with `key`) under doc_id, once per row of the input.

    `also` names columns that hold keys too and become doc_ids.
    """
    if keys is None:
        return result.withColumnRenamed("key", "doc_id")
    out = result.join(keys, "key")
    for name in also:
        names = keys.select(F.col("key").alias(name), F.col("doc_id").alias("_id"))
        out = out.join(names, name, "left").drop(name).withColumnRenamed("_id", name)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rest = [quoted(c) for c in result.columns if c != "key"]
    return out.select("doc_id", *rest)
