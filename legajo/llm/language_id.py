"""Language identification by rank-order n-gram profiles (out-of-place distance).

Text is lower-cased; each run of letters is a word, padded with one blank on
both sides; n-grams of 1 to 3 characters inside the padded words are counted.
A language's profile ranks its most frequent n-grams.  A document's most
frequent n-grams are compared with each profile: an n-gram of rank i in the
document and j in the profile is |i - j| out of place, one that the profile
lacks counts as the maximum.  The language with the least sum wins.

Training counts cover all given rows; they are combined per slice of texts and
by Spark's partial aggregation before n-grams meet.  Profiles are held in
groups of at most `group` languages (so what one task holds is bounded); with
more languages than that, documents pass through one group after the other and
keep the best language so far.  Work grows with the number of groups, and no
language is left out.

Defined results: `und` with score 0 where the text is null or has no letter, or
where nothing was learned.  N-grams of equal count rank by their code.  Equal
distances go to the language that sorts first.  Rows are judged one by one: repeated rows and doc_ids and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.common import cut, tune
from legajo.llm.text import mix64, slices

PROFILE = 400  # n-grams of a language's profile
TOP = 300  # n-grams of a document that are compared
LANGUAGES = 1000  # profiles that are held in memory at once
_GRAM = np.uint64((1 << 44) - 1)


@cache
def _letters() -> np.ndarray:
    """Lower-case code point of each code point that is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """44-bit n-gram codes of the texts, and the text of each."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(x) for x in texts], dtype=np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(points)]
    low = _letters()[points].astype(np.uint64)
    # blanks: one before and one after each word (neighbouring words share one)
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    keep[:-1] |= low[1:] > 0
    low, owner = low[keep], owner[keep]
    if not len(low):
        return low, owner
    # a word at the very start of the batch, or beside another text's, still gets its blank
    low = np.append(np.uint64(0), np.append(low, np.uint64(0)))
    owner = np.append(owner[0], np.append(owner, owner[-1]))
    before, here, after = low[:-2], low[1:-1], low[2:]
    letter = here > 0
    whose = owner[1:-1][letter]
    pair = (here << np.uint64(21)) | after
    # an empty third place tells the sizes apart: 1 << 63 is no code point's bit
    one = here[letter] | np.uint64(1 << 63)
    two = pair[letter]
    three = ((before << np.uint64(42)) | pair)[letter] ^ np.uint64(3 << 61)
    return mix64(np.concatenate([one, two, three])) & _GRAM, np.concatenate([whose, whose, whose])


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count), sorted by text and n-gram."""
    grams, owner = _grams(texts)
    value = np.sort((owner.astype(np.uint64) << np.uint64(44)) | grams)
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(value)))
    value = value[first]
    return (value >> np.uint64(44)).astype(np.int64), (value & _GRAM).astype(np.int64), count


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        names = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        known = sorted(set(names))
        code = {x: i for i, x in enumerate(known)}
        text, gram, count = _counted(_texts(batch))
        own = np.array([code[x] for x in names], dtype=np.uint64)[text]
        value = (own << np.uint64(44)) | gram.astype(np.uint64)
        order = np.argsort(value)
        value, count = value[order], count[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else []
        total = np.add.reduceat(count, first) if len(value) else count
        value = value[first]
        lang = pa.array([known[i] for i in (value >> np.uint64(44)).astype(int)], pa.string())
        yield pa.record_batch([lang, pa.array((value & _GRAM).astype(np.int64)), pa.array(total.astype(np.int64))], names=["lang", "gram", "n"])


class Profiles:
    """Rank-order profiles: languages, and per language its n-grams with their ranks."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        code = {x: i for i, x in enumerate(self.langs)}
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        #: rank of each n-gram in each language, `size` where it has none
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), size, dtype=np.int32)
        for lang, gram, rank in rows:
            self.ranks[code[lang], np.searchsorted(self.grams, gram)] = rank

    def judge(self, texts: list[str], top: int = TOP) -> tuple[list[str], list[float]]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, [0.0] * n
        text, gram, count = _counted(texts)
        order = np.lexsort((gram, -count, text))
        text, gram = text[order], gram[order]
        begin = np.searchsorted(text, np.arange(n))
        rank = np.arange(len(text)) - begin[text] if len(text) else text
        use = rank < top
        text, gram, rank = text[use], gram[use], rank[use]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        used = np.bincount(text, minlength=n)
        off = np.empty((len(self.langs), n))
        for i, own in enumerate(self.ranks):
            place = own[at]
            step = np.where(place == self.size, self.size, np.minimum(np.abs(place - rank), self.size))
            off[i] = np.bincount(text, weights=step, minlength=n)
        best = off.argmin(axis=0)
        most = np.maximum(used * self.size, 1)
        score = np.clip(1 - off.min(axis=0) / most, 0.0, 1.0)
        lang = [self.langs[b] if u else "und" for b, u in zip(best, used, strict=True)]
        return lang, [float(s) if u else 0.0 for s, u in zip(score, used, strict=True)]


def learn(docs: DataFrame, size: int = PROFILE, group: int = LANGUAGES) -> list[Profiles]:
    """Profiles from all rows of docs with a text and a lang, in groups of languages in their order."""
    tune(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    best = cut(best.select("lang", "gram", "rank"))
    known = sorted(r.lang for r in best.select("lang").distinct().collect())
    parts = [known[i : i + group] for i in range(0, len(known), group)]
    return [Profiles([tuple(r) for r in best.where(F.col("lang").between(p[0], p[-1])).collect()], size) for p in parts]


def _pass(profiles: Profiles, top: int, first: bool):
    """Adds lang_pred and score, or betters those that an earlier group of languages gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, score = profiles.judge(_texts(batch), top)
            rest = batch.columns
            if not first:
                *rest, before, had = rest
                for i, (x, y) in enumerate(zip(before.to_pylist(), had.to_pylist(), strict=True)):
                    if y >= score[i]:
                        lang[i], score[i] = x, y
            yield pa.record_batch([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[: len(rest)], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: list[Profiles], top: int = TOP, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, in columns called `names` (which replace any of docs)."""
    tune(docs.sparkSession)
    docs = docs.drop(*names)
    # mapInArrow takes no names with dots or backquotes
    out = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    schema = T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    for i, group in enumerate(profiles or [Profiles([])]):
        out = out.mapInArrow(_pass(group, top, i == 0), schema)
    return out.toDF(*docs.columns, *names)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of documents that nothing is learned from (a null id counts as text '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
