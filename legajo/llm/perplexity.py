"""Quality by perplexity under an interpolated modified Kneser-Ney character n-gram model.

The model is trained on trusted text (documents whose labels all say quality
1), one per language; a fifth of the trusted documents, by a hash of their
ids, is held out of it.  N-grams are counted per slice of texts, then by
partial aggregation; lower orders count distinct continuations; count-of-count
discounts, context sums and back-off weights come from joins that are sharded
by n-gram and context.  The model's rows grow far slower than the trusted text.

Documents meet the counts shard by shard.  A shard holds the models of some
languages, or a part of one language's model, cut by the two characters in the
middle of a 4-gram, which all rows of order 3 and 4 that the 4-gram needs share
(orders 1 and 2 go to every part).  It has at most `most_rows` rows (16 bytes
each) beside those of orders 1 and 2, and is sent to the tasks that read the
documents of its languages; what a document's n-grams add up to in each part is
summed by document.  So no row of a document is shuffled for a language whose
model fits one shard, no n-gram is a join key and what is sent at once is bounded,
whatever the size of the model: more shards mean more passes over the texts of
their languages.

A document is kept if its perplexity is at most `margin` times the quantile
`level` of the held-out trusted documents of its language, or of all its trusted
ones where that is higher: few held-out documents may happen to be easy ones.

Defined results: null or blank text has no characters, perplexity null, and is
not kept; shorter texts than MIN_CHARS are kept; where a language (null is one) has no trusted text, perplexity and
threshold are null and the document is kept, as nothing speaks against it.
Rows are judged one by one; repeated rows, doc_ids and further columns change
nothing.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import cut, narrowed, tune
from legajo.llm.text import mix64, signed, slices, stream64

ORDER = 4
MOST_ROWS = 1 << 21  # rows of one shard
FOLDS = 5  # one of which is held out for the thresholds
LEVEL, MARGIN = 0.995, 1.05
MIN_CHARS = 40  # shorter texts aren't judged
_BEGIN, _END = 1, 2
_PLACE = stream64(23, ORDER + 1) | np.uint64(1)
_SIZE = stream64(29, ORDER + 1)


def _salt(lang: str | None) -> np.uint64:
    from zlib import crc32

    return mix64(np.array([crc32((lang or "").encode()) + (1 << 40) * (lang is None)], dtype=np.uint64))[0]


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ORDER - 1 marks before and one after each; text and use of each place."""
    bodies = [" ".join((x or "").split()) for x in texts]
    bodies = ["\1" * (ORDER - 1) + b + "\2" if b else "" for b in bodies]
    points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    use = (np.arange(len(points)) - first[owner]) >= ORDER - 1 if len(points) else np.zeros(0, dtype=bool)
    return points, owner, use


def _hashes(points: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for n = 1 to ORDER (index n - 1)."""
    out, total = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(points), dtype=np.uint64)
        shifted[n - 1 :] = points[: len(points) - n + 1]
        total = total + shifted * _PLACE[n - 1]
        out.append(mix64(total + _SIZE[n] + salt))
    return out


def _text(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, n): counts of 4-grams as two pairs of code points."""
    for batch in slices(batches, "text", 4 << 20):
        langs = _text(batch, "lang")
        points, owner, use = _points(_text(batch, "text"))
        at = np.flatnonzero(use)
        a = (points[at - 3] << np.uint64(21)) | points[at - 2]
        b = (points[at - 1] << np.uint64(21)) | points[at]
        known = sorted(set(langs), key=lambda x: (x is None, x or ""))
        code = {x: i for i, x in enumerate(known)}
        whose = np.array([code[x] for x in langs], dtype=np.int64)[owner[at]]
        order = np.lexsort((b, a, whose))
        a, b, whose = a[order], b[order], whose[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (whose[1:] != whose[:-1])) if len(a) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(a)))
        lang = pa.array([known[i] for i in whose[first]], pa.string())
        yield pa.record_batch([lang, pa.array(signed(a[first])), pa.array(signed(b[first])), pa.array(n.astype(np.int64))], names=["lang", "a", "b", "n"])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each counted 4-gram: its suffixes g1 to g4, and their contexts x1 to x4."""
    mask = np.uint64((1 << 21) - 1)
    for batch in batches:
        a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
        points = np.stack([a >> np.uint64(21), a & mask, b >> np.uint64(21), b & mask], axis=1)
        langs = batch.column(0).to_pylist()
        salts = {x: _salt(x) for x in set(langs)}
        salt = np.array([salts[x] for x in langs], dtype=np.uint64)
        columns = []
        for end in (4, 3):
            total = np.zeros(len(a), dtype=np.uint64)
            for n in range(1, ORDER + 1 - (4 - end)):
                total = total + points[:, end - n] * _PLACE[n - 1]
                columns.append(signed(mix64(total + _SIZE[n] + salt)))
        g, x = columns[:4], [signed(mix64(_SIZE[0] + salt)), *columns[4:]]
        arrays = [batch.column(0), *[pa.array(c) for c in g], *[pa.array(c) for c in x], batch.column(3)]
        yield pa.record_batch(arrays, names=["lang", "g1", "g2", "g3", "g4", "x1", "x2", "x3", "x4", "n"])


class Model:
    """grams (lang, g, part, p): interpolated log probabilities; contexts (lang, x, part, p): log back-off weights.

    part: hash of the two characters in the middle of the 4-grams that need the row; null for orders 1 and 2.
    """

    def __init__(self, trusted: DataFrame):
        tune(trusted.sparkSession)
        counts = trusted.where("text is not null").select("lang", "text").mapInArrow(_count, "lang string, a long, b long, n long")
        counts = counts.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
        names = [f"{k}{n}" for k in "gx" for n in range(1, ORDER + 1)]
        now = cut(counts.mapInArrow(_name, "lang string, " + ", ".join(f"{x} long" for x in names) + ", n long"))
        levels = {ORDER: now}
        for n in range(ORDER - 1, 0, -1):
            # each row above is another first character: counting rows counts continuations
            rest = [F.first(f"{k}{m}").alias(f"{k}{m}") for k in "gx" for m in range(1, n + 1) if (k, m) != ("g", n)]
            now = cut(now.groupBy("lang", f"g{n}").agg(*rest, F.count("*").alias("n")))
            levels[n] = now
        below, grams, contexts = None, [], []
        for n in range(1, ORDER + 1):
            below, weights = self._level(levels[n], n, below)
            grams.append(below)
            contexts.append(weights)
        self.grams = cut(self._all(grams, "g"))
        self.contexts = cut(self._all(contexts, "x"))

    @staticmethod
    def _all(tables: list[DataFrame], key: str) -> DataFrame:
        out = tables[0].select("lang", key, "part", "p")
        for t in tables[1:]:
            out = out.union(t.select("lang", key, "part", "p"))
        return out

    @staticmethod
    def _level(rows: DataFrame, n: int, below: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in range(1, 5)]
        kinds = rows.groupBy("lang").agg(*of, F.count("*").alias("types"))
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

        def discount(k: int) -> Column:
            d = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
            # where the counts of counts can't tell, half of the count
            return F.coalesce(F.when((F.col(f"n{k}") > 0) & (d > 0) & (d < k), d), F.lit(k / 2)).alias(f"d{k}")

        cuts = kinds.select(F.col("lang").alias("_lang"), "types", *map(discount, (1, 2, 3)))
        rows = rows.join(cuts, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumn("d", d)
        part = (F.col("x3") if n > 2 else F.lit(None).cast("long")).alias("part")
        sums = rows.select("lang", f"x{n}", "n", "d", part).groupBy(f"x{n}").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"), F.first("lang").alias("lang"), F.first("part").alias("part"))
        weights = sums.select("lang", F.col(f"x{n}").alias("x"), "part", F.log(F.col("mass") / F.col("total")).alias("p"))
        rows = rows.join(sums.drop("lang", "part"), f"x{n}")
        own, back = (F.col("n") - F.col("d")) / F.col("total"), F.col("mass") / F.col("total")
        if below is None:
            under = 1 / (F.col("types") + 1)  # one more for a character not seen
        else:
            rows = rows.join(below.select(F.col("g").alias(f"g{n - 1}"), F.exp("p").alias("under")), f"g{n - 1}")
            under = F.col("under")
        out = cut(rows.select("lang", F.col(f"g{n}").alias("g"), part, F.log(own + back * under).alias("p")))
        if n == 1:
            # the share of one unseen character
            unseen = rows.select("lang", F.col("x1").alias("x"), part, F.log(F.col("mass") / F.col("total") / (F.col("types") + 1)).alias("p")).distinct()
            return out, cut(unseen)
        return out, cut(weights)


class Lookup:
    """Open addressing from 64-bit keys to values, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        self.full = np.zeros(1 << bits, dtype=bool)
        self.value = np.zeros(1 << bits, dtype=np.float64)
        left, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(left):
            free = ~self.full[at]
            slot, one = np.unique(np.where(free, at, -1), return_index=True)
            one = one[slot >= 0]
            place = at[one]
            self.key[place], self.value[place], self.full[place] = keys[left[one]], values[left[one]], True
            stay = np.ones(len(left), dtype=bool)
            stay[one] = False
            left, at = left[stay], at[stay]
            at = np.where(self.full[at], (at + 1) & int(self.mask), at)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, nan where a key is missing."""
        at = (keys & self.mask).astype(np.int64)
        out = np.where(self.full[at] & (self.key[at] == keys), self.value[at], np.nan)
        left = np.flatnonzero(self.full[at] & (self.key[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            hit = self.full[at] & (self.key[at] == keys[left])
            out[left[hit]] = self.value[at[hit]]
            on = self.full[at] & ~hit
            left, at = left[on], at[on]
        return out


def _log_probabilities(points: np.ndarray, salt: np.ndarray, use: np.ndarray, grams: Lookup, contexts: Lookup) -> np.ndarray:
    """Of each used place; nan where the language has no model."""
    g = _hashes(points, salt)
    at = np.flatnonzero(use)
    out = np.zeros(len(at))
    left = np.arange(len(at))
    for n in range(ORDER, 0, -1):
        own = grams.get(g[n - 1][at[left]])
        missing = np.isnan(own)
        out[left[~missing]] += own[~missing]
        left = left[missing]
        if n > 1:
            back = contexts.get(g[n - 2][at[left] - 1])
            out[left] += np.nan_to_num(back, nan=0.0)
    if len(left):
        out[left] += contexts.get(mix64(_SIZE[0] + salt[at[left]]))
    return out


_SUMS = "doc_id long, lang string, mark long, n_chars long, s double"


def _sum(tables, parts: int, part: int):
    """The number of a text's characters, and the sum of the log probabilities of those whose 4-gram falls to the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, contexts = (Lookup(k, v) for k, v in tables.value)
        for batch in slices(batches, "text", 1 << 20):
            langs, texts = _text(batch, "lang"), _text(batch, "text")
            points, owner, use = _points(texts)
            salt = np.array([_salt(x) for x in langs], dtype=np.uint64)[owner]
            n = np.bincount(owner[use], minlength=len(texts))
            if parts > 1:
                middle = np.append(np.zeros(1, dtype=np.uint64), _hashes(points, salt)[1][:-1])
                use = use & (middle % np.uint64(parts) == part)
            s = np.bincount(owner[use], weights=_log_probabilities(points, salt, use, grams, contexts), minlength=len(texts)).astype(np.float64)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "lang", "mark")]
            yield pa.record_batch([*rest, pa.array(n.astype(np.int64)), pa.array(s)], names=["doc_id", "lang", "mark", "n_chars", "s"])

    return run


def _shards(model: Model, most_rows: int) -> list[tuple[list[str | None], int, int]]:
    """(languages, number of parts, part) of each shard.  One row per language comes to the driver."""
    rows = model.grams.select("lang", "part").unionAll(model.contexts.select("lang", "part")).groupBy("lang").agg(F.count("*").alias("n")).collect()
    out, few, size = [], [], 0
    for r in sorted(rows, key=lambda r: (r.lang is None, r.lang or "")):
        if (parts := -(-r.n // most_rows)) > 1:
            out += [([r.lang], parts, i) for i in range(parts)]
        elif size + r.n > most_rows:
            out.append((few, 1, 0))
            few, size = [r.lang], r.n
        else:
            few, size = [*few, r.lang], size + r.n
    return out + ([(few, 1, 0)] if few else [])


def _pairs(df: DataFrame, key: str, langs: list[str | None], parts: int = 1, part: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a shard."""
    own = df.where(_among(langs))
    if parts > 1:
        # the hashes are unsigned: the remainder is put together from that of both halves
        high, low = F.shiftrightunsigned("part", 32), F.col("part").bitwiseAND(F.lit((1 << 32) - 1))
        own = own.where(F.col("part").isNull() | ((high % parts * ((1 << 32) % parts) + low) % parts == part))
    rows = own.select(key, "p").toArrow()
    return rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()


def _among(langs: list[str | None]) -> Column:
    named = F.coalesce(F.col("lang").isin([x for x in langs if x is not None]), F.lit(False))
    return named | F.col("lang").isNull() if None in langs else named


def perplexities(docs: DataFrame, model: Model, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of each row of docs."""
    spark = tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("mark"))
    shards = _shards(model, most_rows)
    known = sorted({x for langs, _, _ in shards for x in langs}, key=lambda x: (x is None, x or ""))
    if all(parts > 1 for _, parts, _ in shards):
        shards.append(([], 1, 0))
    home = next(s for s in shards if s[1] == 1)  # languages without a model go along with the first shard that isn't a part
    whole, pieces = [], []
    for shard in shards:
        langs, parts, part = shard
        mine = _among(langs) | ~_among(known) if shard is home else _among(langs)
        tables = spark.sparkContext.broadcast(tuple(_pairs(df, key, langs, parts, part) for df, key in ((model.grams, "g"), (model.contexts, "x"))))
        rows = own.where(mine).mapInArrow(_sum(tables, parts, part), _SUMS)
        if parts == 1:
            whole.append(rows)
        else:
            same = rows.groupBy("doc_id", "lang", "mark").agg(F.first("n_chars").alias("n_chars"), F.first("s").alias("s"), F.count("*").alias("copies"))
            pieces.append(cut(same))
    if pieces:
        # a part's rows of repeated documents are equal; they are summed over the parts once and repeated again
        every = pieces[0]
        for p in pieces[1:]:
            every = every.union(p)
        every = every.groupBy("doc_id", "lang", "mark").agg(F.first("n_chars").alias("n_chars"), F.sum("s").alias("s"), F.first("copies").cast("int").alias("copies"))
        whole.append(every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "lang", "mark", "n_chars", "s"))
    out = whole[0]
    for rows in whole[1:]:
        out = out.union(rows)
    mean = F.col("s") / F.when(F.col("n_chars") > 0, F.col("n_chars"))
    return out.select("doc_id", "lang", "n_chars", F.when(~F.isnan(mean), F.exp(-mean)).alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids all of whose labels say quality 1."""
    return labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1 and doc_id is not null").select("doc_id")


def held_out(doc_id: str) -> Column:
    """True for the documents that the model doesn't see."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def classify(docs: DataFrame, labels: DataFrame, level: float = LEVEL, margin: float = MARGIN, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept of each row of docs."""
    tune(docs.sparkSession)
    trusted = cut(trusted_ids(labels).select(F.col("doc_id").cast("long").alias("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "lang", "text")
    # a Bloom filter of fixed size first; then texts move for one join, whatever the number of labels
    ids = trusted.where(~held_out("doc_id")).select(F.col("doc_id").alias("key"))
    model = Model(narrowed(texts, ids).join(ids.hint("merge"), "key", "left_semi"))
    scored = cut(perplexities(docs, model, most_rows))
    bound = scored.join(trusted, "doc_id", "left_semi").where("perplexity is not null")
    quantile = lambda x: F.percentile_approx(x, level, 10_000)
    unseen = quantile(F.when(held_out("doc_id"), F.col("perplexity")))
    bound = bound.groupBy("lang").agg((F.greatest(unseen, quantile("perplexity")) * margin).alias("threshold"))
    out = scored.join(cut(bound).withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    good = (F.col("n_chars") < MIN_CHARS) | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    kept = (F.col("n_chars") > 0) & good
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))


def op7_perplexity(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
