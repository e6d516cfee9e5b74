"""Connected components of a link table, by alternating large-star and small-star steps.

Links are first contracted inside tasks of `links_per_task` links each (a
union-find in bounded memory), which ends it where one task holds all.  Else
every step groups links by node with partial aggregation and joins the result
back, so no node's links meet in one task whole; nothing goes to the driver
but a count and a checksum.  The number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import cut

LINKS = 1 << 17


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component among the links of this task)."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                top[max(p, q)] = min(p, q)
    nodes = list(top)
    if nodes:
        yield pa.record_batch([pa.array(np.array(nodes)), pa.array(np.array([find(x) for x in nodes]))], names=["a", "b"])


def components(links: DataFrame, links_per_task: int = LINKS) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component."""
    links = cut(links.select("a", "b").distinct())
    tasks = -(-links.count() // links_per_task)
    if tasks <= 1:
        return links.repartition(1).mapInArrow(_contract, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, seen = cut(links.repartition(tasks).mapInArrow(_contract, "a long, b long").where("a <> b").distinct()), None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign.n == 0 or sign == seen:
            break
        seen = sign
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
