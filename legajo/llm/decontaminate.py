"""Benchmark decontamination by a distributed positional inverted index.

Index: postings (term, document, position) of the training texts.  A benchmark
item is cut into windows of `window` words (an item of fewer words is one
window).  The lists of a window's two rarest terms are shifted by the terms'
offsets in the window and intersected; where both agree on a start, the words
there are compared with the window by a hash of 64 bits of their hashes
(phrase), or their span is checked (proximity).

Terms are counted over the whole corpus first, and only postings of terms that
are the rarest of some window are kept, so frequent words never enter the
index.  Per slice of texts, counts are combined before the shuffle.  Which
terms are counted and posted is told by a Bloom filter of fixed size; the joins
that follow select exactly, so a filter that is full, with very many test
terms, costs time only.  Texts are read again only to compare candidates: another
such filter drops other documents before that join's shuffle.

Defined results: a null or blank text or item has no words and matches
nothing.  Items that share an item_id count once; words of an item without id
count as hit, but it is not listed.  doc_ids as in common.keyed: rows repeated
in full are judged alike.  Without items no word is hit; an empty table gives no
rows; further columns are ignored, or carried along by drop_contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import cut, keyed, narrowed, restored, tune, with_key, without
from legajo.llm.text import NON_WORD, Words, signed, slices, window_hash

WINDOW = 13
BITS = 24  # of the filter of terms: 2^24 bits, 2 MB


def _words(batch: pa.RecordBatch) -> Words:
    return Words(batch.column(batch.schema.get_field_index("text")), NON_WORD, lower=True)


def _spot(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _maybe(values: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Which of values the filter lets through."""
    spot = _spot(values, bits)
    return (table[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _filter(terms: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column `term`: 2^bits bits, whatever the number of terms."""
    spot = F.shiftrightunsigned("term", 64 - bits)
    words = terms.select(F.shiftright(spot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - bits}) & 63 as int))").alias("bit"))
    table = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)
    for word, mask in words.groupBy("word").agg(F.bit_or("bit")).collect():
        table[word] = np.uint64(mask & ((1 << 64) - 1))
    return table


def _item_windows(window: int):
    """(item, phrase, size, terms) of each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = _words(batch)
            items = batch.column(batch.schema.get_field_index("item_id"))
            for k in np.unique(np.minimum(words.count, window)):
                # items of at least `window` words share k
                at = words.starts_of(k) if k else np.zeros(0, dtype=np.int64)
                at = at[(np.minimum(words.count, window) == k)[words.text_of_word()[at]]]
                terms = words.hash[(at[:, None] + np.arange(k)).ravel()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), pa.array(signed(terms)))
                names = items.take(pa.array(words.text_of_word()[at]))
                yield pa.record_batch([names, pa.array(signed(words.windows(int(k))[at])), lists], names=["item", "phrase", "terms"])

    return run


def _count_terms(table: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            value = signed(_words(batch).hash)
            term, n = np.unique(value[_maybe(value, table, bits)], return_counts=True)
            yield pa.record_batch([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "n"])

    return run


def _post(table: np.ndarray, bits: int):
    """Postings of the terms in table; for each document also (null, key, number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = _words(batch)
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            value = signed(words.hash)
            at = np.flatnonzero(_maybe(value, table, bits))
            doc = words.text_of_word()[at]
            term = pa.concat_arrays([pa.array(value[at]), pa.nulls(len(key), pa.int64())])
            keys = np.concatenate([key[doc], key])
            place = np.concatenate([at - words.bounds[doc], words.count]).astype(np.int64)
            yield pa.record_batch([term, pa.array(keys), pa.array(place)], names=["term", "key", "at"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, text, found) the starts whose words are those of the window."""
    for batch in slices(batches, "text"):
        words = _words(batch)
        found = batch.column(batch.schema.get_field_index("found"))
        hits = found.flatten()
        row = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
        start, size, phrase = (hits.field(i).to_numpy().astype(np.int64) for i in range(3))
        at = words.bounds[row] + start
        ok = (start >= 0) & (at + size <= words.bounds[row + 1])
        for k in np.unique(size[ok]):
            own = np.flatnonzero(ok & (size == k))
            ok[own] = signed(words.windows(int(k)))[at[own]] == phrase[own]
        key = batch.column(batch.schema.get_field_index("key")).to_numpy()[row[ok]]
        yield pa.record_batch([pa.array(c) for c in (key, start[ok], size[ok], phrase[ok])], names=["key", "start", "size", "phrase"])


class Index:
    """Postings of a training corpus (key, text) for the rarest terms of benchmark windows."""

    def __init__(self, texts: DataFrame, items: DataFrame, window: int = WINDOW, bits: int = BITS):
        tune(texts.sparkSession)
        named = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        self.texts = texts
        self.windows = cut(named.mapInArrow(_item_windows(window), "item string, phrase long, terms array<long>"))
        phrases = self.windows.dropDuplicates(["phrase"]).select("phrase", "terms")
        places = phrases.select("phrase", F.posexplode("terms").alias("offset", "term"))
        counts = texts.mapInArrow(_count_terms(_filter(places, bits), bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        # a window with a term that no text has can't occur
        known = cut(places.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))))
        order = F.array_sort(F.collect_list(F.struct("n", "offset", "term")))
        rare = known.groupBy("phrase").agg(order.alias("o"), F.count("*").cast("int").alias("size")).where("o[0].n > 0")
        second = F.coalesce(F.get("o", F.lit(1)), F.get("o", F.lit(0)))
        self.rare = cut(rare.select("phrase", "size", F.get("o", F.lit(0)).alias("r1"), second.alias("r2")))
        used = self.rare.select(F.col("r1.term").alias("term")).union(self.rare.select("r2.term"))
        self.posted = cut(texts.mapInArrow(_post(_filter(used, bits), bits), "term long, key long, at long"))
        self.postings = self.posted.where("term is not null")
        self.sizes = self.posted.where("term is null").select("key", F.col("at").alias("n_words"))

    def _shifted(self, rank: str) -> DataFrame:
        wanted = self.rare.select(F.col(f"{rank}.term").alias("term"), F.col(f"{rank}.offset").alias("offset"), "phrase", "size")
        return self.postings.join(wanted, "term").select("key", "phrase", "size", (F.col("at") - F.col("offset")).alias("start"))

    def phrase_matches(self) -> DataFrame:
        """(key, start, size, phrase): places whose words are those of a window, by a hash of 64 bits."""
        both = self._shifted("r1").join(self._shifted("r2"), ["key", "phrase", "size", "start"]).distinct()
        found = cut(both.groupBy("key").agg(F.collect_list(F.struct("start", "size", "phrase")).alias("found")))
        return narrowed(self.texts, found).join(found, "key").select("key", "text", "found").mapInArrow(_compare, "key long, start long, size long, phrase long")

    def proximity_matches(self, slack: int) -> DataFrame:
        """(key, start, phrase): a window's two rarest terms, in either order, at most `slack` words off their distance."""
        one, two = self._shifted("r1"), self._shifted("r2").withColumnRenamed("start", "other")
        near = F.abs(F.col("start") - F.col("other")) <= slack
        # starts at most `slack` apart fall in the same or in neighbouring cells
        cell = slack + 1
        one = one.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / cell) + d for d in (-1, 0, 1)])))
        two = two.withColumn("cell", F.floor(F.col("other") / cell))
        return one.join(two.drop("size"), ["key", "phrase", "cell"]).where(near).select("key", "start", "phrase").distinct()


def _contamination(texts: DataFrame, items: DataFrame, window: int, bits: int) -> DataFrame:
    """(key, n_words, n_hit, items, contaminated) of (key, text)."""
    index = Index(texts, items, window, bits)
    matches = cut(index.phrase_matches())
    # words under at least one match: matches sorted by start, each counts what reaches beyond those before
    places = F.array_sort(F.collect_set(F.struct("start", F.col("size").alias("size"))))
    reach = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, m: F.struct(
            F.greatest(acc["end"], m["start"] + m["size"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), m["start"] + m["size"] - F.greatest(acc["end"], m["start"]))).alias("n"),
        ),
    )
    hits = matches.groupBy("key").agg(places.alias("places")).select("key", reach["n"].alias("n_hit"))
    owners = index.windows.where("item is not null").select("phrase", "item").distinct()
    named = matches.select("key", "phrase").distinct().join(owners, "phrase")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.sizes.join(hits, "key", "left").join(named, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = out.select("key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside matches), items (their ids, sorted), contaminated."""
    tune(docs.sparkSession)
    texts, keys = keyed(docs)
    return restored(_contamination(texts, items, window, bits), keys)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    tune(docs.sparkSession)
    texts, keys = keyed(docs)
    bad = _contamination(texts, items, window, bits).where("contaminated").select("key")
    return without(with_key(docs, keys), bad).select("row.*")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")
