"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words (water-filling by weight under a cap of
`most` copies).  A source whose target is r times its size takes floor(r) whole
copies of each document for certain; the rest of its target is a sample without
replacement, of unequal probabilities.  A document is included with a
probability in proportion to its weight, by default the square root of its
size (longer documents are likelier, but not by as much as they are longer), such
that the words expected add up to the rest; where a probability reaches 1 the
document is certain, and the others share what is left, until none is above 1.

Documents are ranked by the ratio of random odds u / (1 - u) to inclusion odds
p / (1 - p), certain ones first, and taken from the smallest ratio on while the
words stay within the rest (a sample of fixed size in words).  What is then
missing is filled by the one document left that fits it best; smaller ones that
would still fit are passed over.  A source with documents left ends off its
target by at most half the size of the first one past the cut, which in a small
source with one long document is much.

Rows alike in doc_id, source and text are numbered, and each has its own u, from a
digest of doc_id, text and number: reruns agree.  They are counted before
that, and only those that differ in what they get are told apart, so the
texts of a source aren't shuffled.  Running sums over a source are taken over range
partitions and their offsets, so a source with a third of all rows is spread
over tasks, and what makes documents certain is summed by weight and size.

Defined results: a null or blank text has size 0 and takes 0 words; a null
source is a source of its own and comes last; null and repeated doc_ids are
rows like others, and which of several equal rows are taken can't be told; an
empty table gives no rows; weights that are null or not positive count as 1.
Weights count to six decimals.  Texts are told apart by MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import columns, cut, narrowed, quoted, tune, without

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
SEED = "mix-2"
_MANY = 4096  # equal rows that are told apart in one go


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) from (source, size); one row per source.

    The windows without a partition see one row per source, not documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    name = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("sid", F.row_number().over(name).cast("long") - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * most)
    # sources stop at their cap in the order of cap / weight; the level is the first that the next ones don't exceed
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    by = by.withColumn("level", left / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(every)
    by = by.withColumn("level", level["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return by.select("source", "sid", "source_size", target.alias("target"))


def sized(docs: DataFrame, weight_col: str | None = None, carry: bool = False) -> DataFrame:
    """doc_id, source, _size (words), _text (digest) and _weight of each row; with carry also the whole `row`."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("_size"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"),
        *([quoted(weight_col).cast("double").alias("_weight")] if weight_col else []), *([F.struct(*columns(docs)).alias("row")] if carry else []),
    )
    weight = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(1.0) * 1_000_000 if weight_col else F.sqrt(F.col("_size").cast("double")) * 1024
    # a whole number, so that sums don't depend on their order
    return out.withColumn("_weight", F.greatest(F.lit(1), F.floor(weight)).cast("long"))


_UNIT = ("source", "doc_id", "_text", "_size", "_weight")


def _numbered(units: DataFrame) -> DataFrame:
    """A row for each of the n rows of a unit, with its number _k; many of one unit are spread over tasks."""
    one = units.where("n = 1").withColumn("_k", F.lit(0).cast("long"))
    many = units.where("n > 1").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_MANY}"))))
    many = many.repartition("doc_id", "_text", "_part")
    last = F.least(F.col("n"), (F.col("_part") + 1) * _MANY) - 1
    return one.unionByName(many.withColumn("_k", F.explode(F.sequence(F.col("_part") * _MANY, last))).drop("_part"))


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """rows with _id (null last) and _u, evenly spread over (0, 1)."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), ident, "_text", F.col("_k").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    return rows.withColumn("_id", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("_u", u)


def _pareto() -> Column:
    p = F.least(F.lit(1.0), F.col("_weight") * F.col("level"))
    odds = F.col("_u") / (1 - F.col("_u"))
    return F.when(p >= 1, 0.0).when(p > 0, odds * ((1 - p) / p)).otherwise(odds)


def _levels(by: DataFrame, sizes: DataFrame) -> DataFrame:
    """by (source, rest) with `level`: a document of weight w is included with probability min(1, level * w).

    sizes: (source, _weight, _size, n).  A round makes those certain whose
    probability reaches 1; it ends when no more do.
    """
    level, before = by.withColumn("level", F.lit(0.0)), None
    while True:
        own = level.select(F.col("source").alias("_source"), F.col("level").alias("_level"))
        met = sizes.where("_size > 0").join(own, F.col("source").eqNullSafe(F.col("_source")))
        sure = F.col("_weight") * F.col("_level") >= 1
        words = (F.col("_size") * F.col("n")).cast("decimal(38,0)")
        sums = met.groupBy("_source").agg(
            F.sum(F.when(sure, words).otherwise(0)).cast("double").alias("sure"), F.sum(F.when(sure, 0).otherwise(words * F.col("_weight"))).cast("double").alias("mass"), F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("certain")
        )
        out = by.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        some = F.greatest(F.lit(0.0), F.try_divide(F.col("rest") - F.col("sure"), F.col("mass")))
        # where all are certain the level no longer matters
        level = cut(out.withColumn("level", F.coalesce(F.when(F.col("mass") > 0, some), F.lit(1.0))).drop("sure", "mass"))
        certain = level.agg(F.sum("certain")).first()[0]
        if certain == before:
            return level.drop("certain")
        before = certain


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row per source: its target, whole copies, level, the last document of the sample, and the one that fills it up.

    rows: source, _size, _weight, _id, _text, _k, _u; one for each document.
    """
    sizes = cut(rows.groupBy("source", "_weight", "_size").agg(F.count("*").alias("n")))
    by = targets(sizes.select("source", (F.col("_size") * F.col("n")).alias("size")), weights, total, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = by.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.floor(ratio) * F.col("source_size"))
    by = _levels(cut(by), sizes)
    own = by.select(F.col("source").alias("_source"), "sid", "level", "rest")
    ranked = rows.where("_size > 0").join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.select("sid", "rest", _pareto().alias("pareto"), "_id", "_text", "_k", "_size")
    # running sum of sizes in the order of (source, ratio)
    order = ["sid", "pareto", "_id", "_text", "_k"]
    placed = ranked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    inside = Window.partitionBy("part", "sid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("sid", "part").agg(F.sum("_size").alias("part_size"))
    earlier = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))
    summed = placed.withColumn("run", F.sum("_size").over(inside)).join(parts, ["sid", "part"])
    summed = cut(summed.withColumn("run", F.col("run") + F.col("offset")).drop("offset", "part"))
    mark = F.struct("pareto", "_id", "_text", "_k")
    last = cut(summed.where("run <= rest").groupBy("sid").agg(F.max(mark).alias("last"), F.max("run").alias("had")))
    # the one document more that comes nearest to what is missing
    left = summed.where("run > rest").join(last, "sid", "left").withColumn("gap", F.col("rest") - F.coalesce("had", F.lit(0)))
    left = left.withColumn("off", F.abs(F.col("gap") - F.col("_size"))).where("off < gap")
    more = left.groupBy("sid").agg(F.min(F.struct("off", mark.alias("mark"))).alias("m")).select("sid", F.col("m.mark").alias("more"))
    out = by.join(last.select("sid", "last"), "sid", "left").join(more, "sid", "left")
    return cut(out.select(F.col("source").alias("_source"), "source_size", "target", "whole", "level", "last", "more"))


def _copies(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows (drawn, one for each document) with the columns of their source's plan and `copies`."""
    out = rows.join(by, F.col("source").eqNullSafe(F.col("_source")))
    mark = F.struct(_pareto().alias("pareto"), "_id", "_text", "_k")
    picked = F.coalesce(mark <= F.col("last"), F.lit(False)) | F.coalesce(mark == F.col("more"), F.lit(False))
    return out.withColumn("copies", F.when(F.col("_size") > 0, F.col("whole") + F.when(picked, 1).otherwise(0)).otherwise(0).cast("int"))


def _units(docs: DataFrame, weight_col: str | None) -> DataFrame:
    return cut(sized(docs, weight_col).groupBy(*_UNIT).agg(F.count("*").alias("n")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED, weight_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) and copies of each row of docs."""
    tune(docs.sparkSession)
    rows = _drawn(_numbered(_units(docs, weight_col)), seed)
    out = _copies(rows, plan(rows, weights, total, most))
    taken = (F.col("copies") * F.col("_size")).cast("long").alias("taken")
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", taken, "copies")


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its column `copies` says."""
    return rows.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = SEED, weight_col: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    The plan of the sources decides on each row where it lies.  Only rows that
    have an equal one in doc_id, source and text are shuffled: of these as many
    are taken as the mix takes, in the order of a hash of the whole row.
    """
    tune(docs.sparkSession)
    units = _units(docs, weight_col)
    by = plan(_drawn(_numbered(units), seed), weights, total, most)
    key = F.xxhash64("source", "doc_id", "_text").alias("key")
    rows = sized(docs, weight_col, carry=True)
    names = ["key", "row", *_UNIT]
    rows = rows.select(key, "row", *_UNIT)
    alone = rows.withColumn("_k", F.lit(0).cast("long"))
    odd = units.where("n > 1")
    if odd.isEmpty():
        return _repeated(_copies(_drawn(alone, seed), by))
    # how many copies the rows of a unit get in all, beyond the whole ones
    taken = _copies(_drawn(_numbered(odd), seed), by).groupBy(*_UNIT).agg(F.sum(F.col("copies") - F.when(F.col("_size") > 0, F.col("whole")).otherwise(0)).alias("extra"), F.first(F.when(F.col("_size") > 0, F.col("whole")).otherwise(0)).alias("whole"))
    taken = cut(taken.select(key, "extra", "whole"))
    out = _repeated(_copies(_drawn(without(alone, taken.select("key")), seed), by))
    same = narrowed(rows.select(*names), taken.select("key")).join(taken, "key")
    same = same.groupBy("key", F.xxhash64(F.to_json("row")).alias("_row")).agg(F.first("row").alias("row"), F.count("*").alias("n"), F.first("extra").alias("extra"), F.first("whole").alias("whole"))
    before = Window.partitionBy("key").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    extra = F.least(F.col("n"), F.greatest(F.lit(0), F.col("extra") - F.col("_before")))
    same = same.withColumn("copies", F.col("n") * F.col("whole") + extra).where("copies > 0")
    # a row that is repeated very often is spread over tasks
    same = same.select("row", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_MANY}"))).alias("_part"))
    same = same.withColumn("copies", F.least(F.lit(_MANY), F.col("copies") - F.col("_part") * _MANY)).repartition("_part", F.xxhash64(F.to_json("row")))
    return out.unionByName(_repeated(same))


def op10_pareto_mix(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
