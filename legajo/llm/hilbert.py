"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to a few bits each and read as a point
on a grid; rows are sorted by the point's place on the Hilbert curve through
that grid and the order is cut into runs.  Points near each other on the curve
are near in every dimension, so the minimum and maximum of each column in a
shard span little, and a filter on any of the columns prunes shards.

Numbers are cut at approximate quantiles (so hot ranges get more cells), strings
at the quantiles of their sorted order: a cell is a range of values, as wide as
its share of the rows allows, and a value with very many rows has a cell of its
own.  Distinct strings are counted and added up over range partitions, so neither
a hot value nor very many of them meet in one task.

Law `rows`: shard k of S holds the ranks from ceil(k N / S) on, so counts
differ by one at most, whatever the skew; ties on the curve are ordered by
doc_id and text CRC, so reruns agree and no cell goes to one task whole.

Defined results: null text has size 1 and CRC 0; nulls have grid coordinate 0;
rows repeated in full get different slots, in either order; an empty table
gives no rows.  Columns that aren't named are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import columns, cut, quoted, ranked, tune

DIMENSIONS = {"doc_id": "number", "size": "number", "lang": "string", "source": "string"}
BITS = 4


def _tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """Inverse Gray code, entry point and direction of each cell of an n-cube, by their rules."""
    gray = [i ^ (i >> 1) for i in range(2**n)]
    inverse = [gray.index(i) for i in range(2**n)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(2**n)]

    def ones(w: int) -> int:
        return ((w ^ (w + 1)).bit_length()) - 1

    turn = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(2**n)]
    return inverse, entry, turn


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with `bits` bits in each coordinate."""
    n = len(coordinates)
    full = 2**n - 1
    inverse, entry, turn = (F.array(*map(F.lit, t)) for t in _tables(n))
    point = F.array(*[c.cast("int") for c in coordinates])

    def rotated_left(x: Column, by: Column) -> Column:
        # by: 1 to n
        wide = x * F.pow(F.lit(2), by).cast("int")
        return wide.bitwiseAND(F.lit(full)).bitwiseOR((wide / F.lit(2**n)).cast("int"))

    def step(acc: Column, i: Column) -> Column:
        bit = F.transform(point, lambda x, j: (F.floor(x / F.pow(F.lit(2), i)).cast("int") % 2) * F.pow(F.lit(2), j).cast("int"))
        label = F.aggregate(bit, F.lit(0), lambda a, b: a + b)
        # rotation to the right by d + 1 is one to the left by n - d - 1, or by n
        turned = rotated_left(label.bitwiseXOR(acc["e"]), F.lit(n) - F.pmod(acc["d"] + 1, F.lit(n)))
        w = F.get(inverse, turned)
        return F.struct(
            acc["e"].bitwiseXOR(rotated_left(F.get(entry, w), acc["d"] + 1)).alias("e"),
            F.pmod(acc["d"] + F.get(turn, w) + 1, F.lit(n)).alias("d"),
            (acc["h"] * 2**n + w).alias("h"),
        )

    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def quantised(df: DataFrame, dimensions: dict[str, str], bits: int) -> DataFrame:
    """df with a column _q_<name> of 0 to 2^bits - 1 for each dimension."""
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [c for c, kind in dimensions.items() if kind == "number"]
    if numbers:
        cuts = df.agg(*[F.percentile_approx(quoted(c), shares, 10_000).alias(f"_cut_{c}") for c in numbers])
        df = df.join(F.broadcast(cuts))  # one row
    for c in set(dimensions) - set(numbers):
        df = df.join(F.broadcast(_string_cuts(df.select(quoted(c).alias("value")), 2**bits).withColumnRenamed("cuts", f"_cut_{c}")))  # one row
    for c in dimensions:
        # a cut is the greatest value of its cell
        above = F.size(F.filter(F.col(f"`_cut_{c}`"), _below(quoted(c))))
        cell = F.when(quoted(c).isNull() | F.col(f"`_cut_{c}`").isNull(), 0).otherwise(above)
        df = df.withColumn(f"_q_{c}", cell).drop(f"_cut_{c}")
    return df


def _below(value: Column):
    return lambda x: x < value


def _string_cuts(df: DataFrame, cells: int) -> DataFrame:
    """One row, `cuts`: the values of column `value` that the first i / cells of its sorted rows reach, for i = 1 to cells - 1."""
    counts = df.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    parts = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    total = parts.agg(F.sum("rows").alias("total"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("own", F.sum("n").over(inside)).join(F.broadcast(parts.select("part", "before")), "part").join(F.broadcast(total))
    upto = F.col("own") + F.col("before")
    reached = [F.min(F.when(upto * cells >= F.col("total") * i, F.col("value"))) for i in range(1, cells)]
    return summed.agg(F.array_compact(F.array(*reached)).alias("cuts"))


def hilbert_shards(df: DataFrame, shards: int, dimensions: dict[str, str], ties: list[str], bits: int = BITS) -> DataFrame:
    """df with `curve`, `shard` (0 to shards - 1) and `slot` (0, 1, ... in each shard)."""
    df = quantised(df, dimensions, bits)
    df = df.withColumn("curve", hilbert_index([F.col(f"_q_{c}") for c in dimensions], bits))
    df = df.drop(*[f"_q_{c}" for c in dimensions])
    order = [F.col("curve"), *[quoted(c).asc_nulls_last() for c in ties]]
    out = ranked(df, order)
    total = out.agg(F.count("*").alias("_total"))
    out = out.join(F.broadcast(total))  # one row
    shard = F.expr(f"_rank * {shards} div _total")
    first = F.expr(f"(shard * _total + {shards} - 1) div {shards}")
    out = out.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first)
    return out.withColumn("shard", F.col("shard").cast("int")).drop("_rank", "_total")


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Row count, minimum and maximum of each column by shard: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 16, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard, slot of each row of documents.

    With carry all other columns of docs (the text) go along through the sort.
    """
    tune(docs.sparkSession)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32")
    facts = docs.select("doc_id", size, crc, "lang", "source", *([F.struct(*columns(docs)).alias("document")] if carry else []))
    return hilbert_shards(facts if carry else cut(facts), shards, DIMENSIONS, ["doc_id", "text_crc32", "size"])


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All columns of docs and size, text_crc32, curve, shard, slot of each row; a column of docs that has such a name gives way."""
    new = ["size", "text_crc32", "curve", "shard", "slot"]
    out = shard_documents(docs, shards, carry=True)
    return out.select(*[F.col("document")[c].alias(c) for c in docs.columns if c not in new], *new)


def op3_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    out = shard_documents(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
