"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles.  The sketch of a set has P
64-bit words: each shingle is hashed to one word and XORed into it.  An element
of the symmetric difference of two sets can change one word only, so the number
of differing words bounds the size of the symmetric difference from below.

For Jaccard >= num/den and |A| <= |B| the symmetric difference is at most
(den - num) / num * |A|.  Sets are put in size bands [lo, hi) such that a set's
partners lie in its own band or the next.  In band k that bound is d_k, so of
P_k = d_k + 1 + blank + spare words at least 1 + blank + spare are equal in any
linked pair: pairs meet on (band, word index, word value).  Words that no
shingle fell into say nothing; a set with at most `blank` such words sends its
other words only.

No group of equal words is expanded into pairs.  Each group links its members
to its least member; pairs that denser parity sketches don't rule out are
verified on the texts, and links make components.  What is left are pairs of one
group that lie in different components.  They meet on the rarer groups only: with all groups in one order,
by size, each set leaves out its last `spare` ones, and a linked pair still
shares one of the others (prefix filtering), so what a passage common to very
many documents makes equal falls away.

Groups of few members compare them by denser parity sketches, whose Hamming distance
bounds the difference more tightly; only pairs whose distance, sizes and
number of shared words allow a link become rows.  The members of larger groups,
a template of which thousands of documents differ in a few words, meet on their
rarest shingles instead: with all shingles in one order, by the number of these
members that have them, linked sets share one among the first of both, and of
the smaller set even fewer come into question (positional prefix filtering).
What all members share is last in that order, so such documents make no pairs
unless they share something rare as well; dense sketches then sift the pairs.
At last the texts of what is left are compared, in rounds of a few pairs for each text.  No
link between different texts that could join two components is lost.  Equal
sets are one node from the start.

Defined results: a null, blank or empty text has an empty set and is its own
component; texts of fewer words than a shingle have one shingle, the whole
sequence.  Null or repeated doc_ids as in common.keyed; the component id is the
least doc_id (null sorts last).  Set elements and whole sets are told apart by
64-bit hashes.  An empty table gives no rows; further columns are ignored, or
carried along by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import cut, keyed, narrowed, restored, tune, with_key
from legajo.llm.components import components
from legajo.llm.text import SPACE, Words, mix64, signed, slices, spans, window_hash

_META, _WORD, _STAR = 0, 1, 2
_SPARE = 63  # words left out at most (six bits)
_FEW = 128  # members of a group that are compared with each other
_CROWD = 128  # pairs of one centre that are verified in one group
_LOAD = 4  # pairs for each text that are verified in one round


@dataclass(frozen=True)
class Bands:
    """Size bands and the sketches of each: lower ends, words, and how many words may be blank or left out."""

    low: tuple[int, ...]
    words: tuple[int, ...]
    blank: tuple[int, ...]
    spare: tuple[int, ...]


@cache
def bands(num: int, den: int, most: int) -> Bands:
    """The bands of sizes up to `most`."""
    low = [1]
    while low[-1] <= most or len(low) < 3:
        low.append(max(low[-1] + 1, (low[-1] - 1) * den // num + 1))
    words, blank, spare = [], [], []
    for hi in low[1:] + [low[-1] * den // num + 2]:
        d = (hi - 1) * (den - num) // num
        blank.append(1 + d // 40 if d else 0)
        spare.append(min(_SPARE, -(-d // 5)))
        words.append(d + 1 + blank[-1] + spare[-1])
    return Bands(tuple(low), tuple(words), tuple(blank), tuple(spare))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    value = words.windows(n)
    out = []
    for i in range(len(words.count)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= n:
            out.append(np.unique(value[a : b - n + 1]))
        elif b > a:
            out.append(window_hash(words.hash[a:b], int(b - a))[:1])
        else:
            out.append(value[:0])
    return out


def _sketch(values: np.ndarray, sizes: np.ndarray, band: np.ndarray, by: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch words of each set in its `band`, and the index of the set.

    A key's low bits tell what its members have in common: bit 6 whether the band is odd, bits 0 to 5 its spare.
    """
    per, may_blank, spare = (np.asarray(x, dtype=np.int64)[band] for x in (by.words, by.blank, by.spare))
    base = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    part = (mix64(values) >> np.uint64(33)).astype(np.int64) % per[owner]
    place = base[owner] + part
    order = np.argsort(place)
    place, values = place[order], values[order]
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    word = np.zeros(base[-1], dtype=np.uint64)
    if len(place):
        word[place[new]] = np.bitwise_xor.reduceat(values, new)
    filled = np.zeros(base[-1], dtype=bool)
    filled[place[new] if len(place) else []] = True
    owner = np.repeat(np.arange(len(sizes)), per)
    blank = np.bincount(owner[~filled], minlength=len(sizes))
    send = filled | (blank > may_blank)[owner]
    index = np.arange(base[-1]) - base[:-1][owner]
    salt = mix64((band[owner].astype(np.uint64) << np.uint64(40)) + index.astype(np.uint64) + np.uint64(1))
    key = (mix64(word ^ salt) >> np.uint64(7) << np.uint64(7)) | ((band & 1) << 6 | spare).astype(np.uint64)[owner]
    return key[send], owner[send]


def _first_pass(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(batch.schema.get_field_index("text")), SPACE, lower=True)
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            sets = shingle_sets(words, n)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            node = mix64(np.array([int(mix64(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64) + sizes.astype(np.uint64))
            node = signed(node)
            yield _rows(_META, key, node, sizes)
            # one set of each kind is enough
            some = np.flatnonzero(sizes)
            some = some[np.unique(node[some], return_index=True)[1]]
            if not len(some):
                continue
            by = bands(num, den, int(sizes.max()))
            values = np.concatenate([sets[i] for i in some])
            band = np.searchsorted(by.low, sizes[some], side="right") - 1
            keys, owners = [], []
            for down in (0, 1):
                ok = band >= down
                own = np.repeat(ok, sizes[some])
                k, o = _sketch(values[own], sizes[some][ok], band[ok] - down, by)
                keys.append(k)
                owners.append(node[some[ok]][o])
            bucket, member = signed(np.concatenate(keys)), np.concatenate(owners)
            order = np.lexsort((member, bucket))
            bucket, member = bucket[order], member[order]
            new = np.append(True, bucket[1:] != bucket[:-1])
            yield _rows(_WORD, bucket[new], member[new], np.zeros(int(new.sum()), dtype=np.int64))
            if not new.all():
                centre = member[np.flatnonzero(new)[np.cumsum(new) - 1]]
                yield _rows(_STAR, bucket[~new], centre[~new], member[~new])

    return run


def _rows(kind: int, b: np.ndarray, a: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(b), kind, dtype=np.int8)), pa.array(b), pa.array(a), pa.array(c)], names=["kind", "b", "a", "c"])


_SCHEMA = "kind byte, b long, a long, c long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, a): groups of equal words become stars around their least member."""
    bucket = centre = None
    for batch in batches:
        kind, b, a, c = (batch.column(i).to_numpy() for i in range(4))
        word = kind == _WORD
        if not word.all():
            yield _pick(batch, ~word)
        b, a = b[word], a[word]
        if not len(b):
            continue
        new = np.append(b[0] != bucket, b[1:] != b[:-1])
        first = np.flatnonzero(new)
        run = np.cumsum(new)
        centres = np.concatenate([[centre if centre is not None else 0], a[first]])[run]
        other = ~new & (centres != a)
        bucket, centre = b[-1], centres[-1]
        if other.any():
            yield _rows(_STAR, b[other], centres[other], a[other])


def _pick(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(mask))


def _verify(n: int, num: int, den: int):
    """Rows sorted by (centre, part, role): a centre's text, then those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in slices(batches, "text"):
            words = Words(batch.column(batch.schema.get_field_index("text")), SPACE, lower=True)
            centre, part, node = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("centre", "part", "node"))
            sets = shingle_sets(words, n)
            a, b = [], []
            for i, s in enumerate(sets):
                if centre[i] == node[i]:
                    at, own = (centre[i], part[i]), s
                    continue
                if at != (centre[i], part[i]):
                    raise RuntimeError("the text of a centre is missing")
                if min(len(s), len(own)) * den < num * max(len(s), len(own)):
                    continue
                same = len(np.intersect1d(s, own, assume_unique=True))
                if den * same >= num * (len(s) + len(own) - same):
                    a.append(centre[i])
                    b.append(node[i])
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that are linked; texts: (node, text).

    A centre with many partners is dealt out to as many groups as it needs.
    """
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / _CROWD).cast("int").alias("parts"))
    centres = crowd.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(crowd, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    sides = centres.select("a", "part", F.col("a").alias("node")).union(dealt)
    rows = sides.join(texts, "node").select(F.col("a").alias("centre"), "part", "node", "text")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("centre") != F.col("node"))
    return rows.mapInArrow(_verify(n, num, den), "a long, b long")


def _links_in_rounds(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """_links in as many rounds as keep the texts that move at once to a few times all texts, however many the pairs are."""
    rounds = max(1, ceil(pairs.count() / max(1, _LOAD * texts.count())))
    out = None
    for r in range(rounds):
        found = cut(_links(pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == r), texts, n, num, den))
        out = found if out is None else out.union(found)
    return out


def _joined(member: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    """member with the root of its column `name` (itself where it has no link)."""
    known = roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    return member.join(known, name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))


def _likely(pairs: DataFrame, sketches: DataFrame, num: int, den: int, by: Bands) -> DataFrame:
    """Of pairs (a, b) those whose sizes and dense sketches allow a link."""
    sizes = sketches.select("node", "n").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
    pairs = pairs.where((F.least("na", "nb") * den) >= (F.greatest("na", "nb") * num))
    pairs = pairs.withColumn("odd", (_band(F.least("na", "nb"), by) % 2).cast("int"))
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), "odd", F.col("sketch").alias(f"s{side}")), [side, "odd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("na", "nb"))
            (sa, off), (sb, _) = (spans(batch.column(batch.schema.get_field_index(c))) for c in ("sa", "sb"))
            apart = np.concatenate([[0], np.cumsum(np.bitwise_count(sa ^ sb), dtype=np.int64)])
            apart = apart[off[1:]] - apart[off[:-1]]
            yield batch.select(["a", "b"]).filter(pa.array(apart * (den + num) <= (na + nb) * (den - num)))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _still_apart(stars: DataFrame, roots: DataFrame, meta: DataFrame, sketches: DataFrame, bodies: DataFrame, n: int, num: int, den: int, by: Bands) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a group and may be linked."""
    groups = stars.groupBy("bucket").agg(F.count("*").alias("size"), F.min("a").alias("node"))
    member = stars.select("bucket", F.col("b").alias("node")).union(groups.select("bucket", "node")).distinct()
    member = member.join(groups.select("bucket", "size"), "bucket")
    # each set leaves out the last `spare` of its groups, the largest
    last = Window.partitionBy("node", F.expr("bucket & 64")).orderBy(F.col("size").desc(), "bucket")
    member = member.withColumn("k", F.row_number().over(last)).where(F.col("k") > F.expr("bucket & 63")).select("bucket", "node")
    member = cut(_joined(member, "node", roots))
    mixed = member.groupBy("bucket").agg(F.min("node_root").alias("r"), F.max("node_root").alias("s"), F.count("*").alias("members")).where("r <> s").select("bucket", "members")
    sizes = meta.groupBy("node").agg(F.first("n").alias("n"))
    side = member.join(mixed, "bucket").join(sizes, "node")
    side = cut(side.withColumn("odd", F.expr("cast(shiftright(bucket & 64, 6) as int)")))
    lists = side.groupBy("node", "odd").agg(F.sort_array(F.collect_list("bucket")).alias("groups"))  # at most as many as a sketch has words
    dense = sketches.select("node", "odd", "sketch").join(lists, ["node", "odd"])
    few = side.where(F.col("members") <= _FEW).join(dense, ["node", "odd"]).select("bucket", "node", "node_root", "n", "sketch", "groups")
    pairs = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_compare(num, den, by), "a long, b long")
    crowd = side.where(F.col("members") > _FEW).select("node", "odd", "node_root").distinct()
    if not crowd.isEmpty():
        met = cut(_by_rare_shingles(cut(crowd), bodies, n, num, den, by))
        pairs = pairs.union(_likely(met, sketches, num, den, by))
    return pairs.distinct()


def _by_rare_shingles(crowd: DataFrame, bodies: DataFrame, n: int, num: int, den: int, by: Bands) -> DataFrame:
    """Pairs (a, b) of crowd (node, odd, node_root) that share a rare shingle and whose sizes and its places allow a link."""
    own = narrowed(bodies.withColumnRenamed("node", "key"), crowd.select(F.col("node").alias("key")))
    rows = cut(own.mapInArrow(_shingles(n), "node long, n long, token long"))
    # shingles that one set alone has come first; they make no pairs
    known = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("node").orderBy("df", "token")
    rows = rows.join(known, "token").withColumn("place", F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.row_number().over(order) - 1)
    rows = rows.where(f"place <= n - ({num} * n + {den - 1}) div {den}").select("node", "n", "token", "place")
    rows = cut(rows.join(crowd, "node"))
    names = rows.columns
    first = rows.where(f"place <= n - ({2 * num} * n + {num + den - 1}) div {num + den}").select(*[F.col(c).alias(f"{c}_a") for c in names])
    second = rows.select(*[F.col(c).alias(f"{c}_b") for c in names])
    met = (F.col("odd_a") == F.col("odd_b")) & (F.col("token_a") == F.col("token_b")) & (F.col("node_root_a") != F.col("node_root_b"))
    met &= (F.struct("n_a", "node_a") < F.struct("n_b", "node_b")) & (F.col("n_a") * den >= F.col("n_b") * num)
    # what both have from this shingle on suffices
    met &= F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * (num + den) >= (F.col("n_a") + F.col("n_b")) * num
    pairs = first.join(second, met).where(_band(F.col("n_a"), by) % 2 == F.col("odd_a"))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _shingles(n: int):
    """(node, size, shingle) of each shingle of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(Words(batch.column(batch.schema.get_field_index("text")), SPACE, lower=True), n)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            node = batch.column(batch.schema.get_field_index("key")).to_numpy()
            yield pa.record_batch([pa.array(np.repeat(x, size)) for x in (node, size)] + [pa.array(signed(np.concatenate(sets)))], names=["node", "n", "token"])

    return run


def _dense(n: int, by: Bands):
    """Bit-parity sketches of each node, one for its own band and one for the band below: two bits to a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(batch.schema.get_field_index("text")), SPACE, lower=True)
            node = batch.column(batch.schema.get_field_index("node")).to_pylist()
            rows = ([], [], [], [])
            for who, own in zip(node, shingle_sets(words, n), strict=True):
                top = int(np.searchsorted(by.low, len(own), side="right")) - 1
                for band in (top, top - 1) if top else (top,):
                    bits = 64 * (-(-2 * by.low[min(band + 1, len(by.low) - 1)] // 64))
                    spot = np.bincount((mix64(own ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                    for column, x in zip(rows, (who, band % 2, len(own), np.packbits(spot.astype(bool)).tobytes()), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], names=["node", "odd", "n", "sketch"])

    return run


def _compare(num: int, den: int, by: Bands):
    """Rows sorted by bucket: pairs of different components that may be linked.

    Sizes, the dense sketches and the number of shared groups must allow it; a
    pair comes from the first group that both have.
    """
    sure = np.array(by.words) - np.array(by.blank) - np.array(by.spare)

    def pairs(bucket, rows):
        node, root, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        sketch = np.stack([np.frombuffer(r[3], dtype=np.uint64) for r in rows])
        lists = [np.array(r[4], dtype=np.int64) for r in rows]
        for x in range(len(rows) - 1):
            rest = slice(x + 1, None)
            small, large = np.minimum(n[x], n[rest]), np.maximum(n[x], n[rest])
            band = np.searchsorted(by.low, small, side="right") - 1
            # groups are counted in the band of the smaller set alone
            at = np.flatnonzero((root[rest] != root[x]) & (small * den >= large * num) & (band % 2 == (bucket & 64) >> 6))
            if not len(at):
                continue
            apart = np.bitwise_count(sketch[at + x + 1] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            both = n[at + x + 1] + n[x]
            for y, total in zip(at[fits := apart * (den + num) <= both * (den - num)], both[fits], strict=True):
                shared = np.intersect1d(lists[x], lists[x + 1 + y], assume_unique=True)
                if shared[0] == bucket and len(shared) >= sure[band[y]] - total * (den - num) // (den + num):
                    a, b = sorted((int(node[x]), int(node[x + 1 + y])))
                    yield a, b

    def batch_of(found):
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if len(rows) > 1 and (found := list(pairs(now, rows))):
                        yield batch_of(found)
                    now, rows = bucket, []
                rows.append(row)
        if len(rows) > 1 and (found := list(pairs(now, rows))):
            yield batch_of(found)

    return run


def _band(size: Column, by: Bands) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, by.low)), lambda x: x <= size)) - 1


def _classes(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, n_shingles, component_id) of (key, text)."""
    rows = texts.mapInArrow(_first_pass(n, num, den), _SCHEMA)
    dealt = F.when(F.col("kind") == _WORD, F.col("b")).otherwise(F.xxhash64("kind", "b", "a", "c"))
    met = cut(rows.repartition(dealt).sortWithinPartitions("b", "a").mapInArrow(_meet, _SCHEMA))
    meta = met.where(F.col("kind") == _META).select(F.col("b").alias("key"), F.col("a").alias("node"), F.col("c").alias("n"))
    stars = met.where(F.col("kind") == _STAR).select(F.col("b").alias("bucket"), "a", F.col("c").alias("b"))

    tested = cut(stars.select("a", "b").distinct())
    wanted = tested.select(F.col("a").alias("node")).union(tested.select(F.col("b").alias("node"))).distinct()
    first = meta.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node")
    bodies = cut(first.join(texts, "key").select("node", "text"))
    by = bands(num, den, meta.agg(F.max("n")).first()[0] or 1)
    sketches = cut(bodies.mapInArrow(_dense(n, by), "node long, odd int, n long, sketch binary"))
    links = cut(_links(cut(_likely(tested, sketches, num, den, by)), bodies, n, num, den))
    roots = cut(components(links))

    left = cut(_still_apart(stars, roots, meta, sketches, bodies, n, num, den, by).join(tested, ["a", "b"], "left_anti"))
    if not left.isEmpty():
        links = links.union(_links_in_rounds(left, bodies, n, num, den))
        roots = cut(components(links))

    named = meta.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # an empty set is linked with nothing
    group = F.when(F.col("n") == 0, F.struct(F.lit(1).alias("one"), F.col("key").alias("id"))).otherwise(F.struct(F.lit(0).alias("one"), F.col("root").alias("id")))
    named = named.select("key", F.col("n").alias("n_shingles"), group.alias("g"))
    least = cut(named.groupBy("g").agg(F.min("key").alias("component_id")))
    return named.join(least, "g").select("key", "n_shingles", "component_id")


def similar_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: classes of documents that links of Jaccard >= num/den connect."""
    tune(docs.sparkSession)
    texts, keys = keyed(docs)
    return restored(_classes(texts, n, num, den), keys, also=("component_id",))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each class: that of the least doc_id, text hash breaking ties."""
    tune(docs.sparkSession)
    texts, keys = keyed(docs)
    first = _classes(texts, n, num, den).where("key = component_id").select("key")
    out = with_key(docs, keys).join(first, "key", "left_semi")
    return (out if keys is None else out.dropDuplicates(["key"])).select("row.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    return similar_components(documents(spark, sf_dir))
