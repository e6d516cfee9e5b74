"""Substring deduplication by level-wise doubling.

A window is `length` consecutive words of one document.  Windows that repeat
are found level by level: sub-windows of `base` words first, and only windows
whose sub-window repeats are looked at with twice as many words, until the
full length is reached or no candidate survives.

At each level a window is represented by its sub-window of least hash, which
depends on the window's words alone.  So equal windows have equal
representatives, and neighbouring windows share theirs: at the first level a
sixth of the positions is shuffled instead of all.

Skew: rows of one key are combined within each slice of texts before the
shuffle.  A passage that a third of all documents hold sends one row per
slice, not one per document.

Windows are told apart by hashes: 64 bits, of the last level 96, both made of the
64-bit hashes of their words, so words of equal hash count as equal.

Defined results: a null or blank text has no words, nothing is removed and the
kept text is empty.  doc_id orders the documents, null last; rows that share a
doc_id but not the text are separate documents ordered by text hash; rows
repeated in full are one document whose result each of them carries.  Further
columns of the input are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import cut, keyed, restored, tune
from legajo.llm.text import SPACE, Words, signed, slices, spans, unsigned

_ROWS = "h long, g int, key long, pos int, flag int"  # h and g: 96 bits of the hash
_SENT, _KNOWN, _DIRECT = 0, 1, 2


def _representatives(words: Words, size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Position of the least sub-window of `size` words in the window at each start."""
    if size == length:
        return starts
    value = words.windows(size)
    best, at = value[starts].copy(), starts.copy()
    for j in range(1, length - size + 1):
        other = value[starts + j]
        less = other < best
        best[less] = other[less]
        at[less] = starts[less] + j
    return at


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray] | None:
    at = batch.schema.get_field_index(name)
    if at < 0:
        return None
    column = batch.column(at)
    if column.null_count:
        column = pa.array([x or [] for x in column.to_pylist()], type=column.type)
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _candidates(batch: pa.RecordBatch, words: Words, before: int | None, length: int) -> np.ndarray:
    """Word indexes where a window starts whose representative at the level before survived."""
    starts = words.starts_of(length)
    if before is None or not len(starts):
        return starts
    values, sizes = _lists(batch, "positions")
    alive = np.zeros(len(words), dtype=bool)
    alive[values + np.repeat(words.bounds[:-1], sizes)] = True
    return starts[alive[_representatives(words, before, starts, length)]]


def _emit(size: int, before: int | None, length: int):
    """The rows of one level.  The last level (size == length) keeps a window's first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(batch.schema.get_field_index("text")), SPACE)
            starts = _candidates(batch, words, before, length)
            if not len(starts):
                continue
            at = np.unique(_representatives(words, size, starts, length))
            h = words.windows(size)[at]
            last = size == length
            g = words.windows(size, second=True)[at] if last else np.zeros(len(at), dtype=np.uint64)
            doc = words.text_of_word()[at]
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()[doc]
            pos = at - words.bounds[doc]
            order = np.lexsort((pos, key, g, h))
            h, g, key, pos = h[order], g[order], key[order], pos[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            flag = np.where(new, _SENT, _DIRECT).astype(np.int32)
            if not last:
                # the first of several is known to repeat: it goes on at once and is sent for others to see
                many = new & ~np.append(new[1:], True)
                flag[many] = _KNOWN
                again = np.flatnonzero(many)
                h, g, key, pos = (np.append(x, x[again]) for x in (h, g, key, pos))
                flag = np.append(flag, np.full(len(again), _DIRECT, dtype=np.int32))
            h[flag == _DIRECT] = 0
            g[flag == _DIRECT] = 0
            order = np.lexsort((pos, key))  # neighbours share most bytes of key and place: the shuffle compresses them
            h, g, key, pos, flag = (x[order] for x in (h, g, key, pos, flag))
            yield pa.record_batch(
                [pa.array(signed(h)), pa.array(g.astype(np.uint32).view(np.int32)), pa.array(key), pa.array(pos, pa.int32()), pa.array(flag)],
                names=["h", "g", "key", "pos", "flag"],
            )

    return run


def _meet(last: bool):
    """Of rows sorted by (flag = direct, h, g, key, pos): what repeats, or at the last level all but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None  # (h, g) of the row before
        held = None  # (key, pos) of a row that is alone so far
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, key, pos, flag = (batch.column(i).to_numpy() for i in range(5))
            direct = flag == _DIRECT
            keys, places = [key[direct]], [pos[direct]]
            h, g, key, pos, flag = (x[~direct] for x in (h, g, key, pos, flag))
            if len(h):
                same = np.zeros(len(h), dtype=bool)  # as the row before
                same[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
                same[0] = prev == (h[0], g[0])
                prev = (h[-1], g[-1])
                if last:
                    out = same
                else:
                    if held is not None and same[0]:
                        keys.append(np.array([held[0]]))
                        places.append(np.array([held[1]], dtype=np.int32))
                    out = same | np.append(same[1:], False)
                    wait = not out[-1] and flag[-1] == _SENT
                    held = (key[-1], pos[-1]) if wait else None
                    out &= flag == _SENT
                keys.append(key[out])
                places.append(pos[out])
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["key", "pos"])

    return run


def _by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(F.collect_list("pos").alias("positions"))


def repeated_windows(texts: DataFrame, length: int = 20, base: int = 10) -> DataFrame:
    """(key, pos) of each window of (key, text) whose words start earlier too, in document order."""
    if length < 1 or base < 1:
        raise ValueError("length and base must be positive")
    tune(texts.sparkSession)
    size, before, found = min(base, length), None, None
    while True:
        source = texts if found is None else texts.join(_by_document(found), "key")
        rows = source.mapInArrow(_emit(size, before, length), _ROWS)
        last = size == length
        dealt = F.when(F.col("flag") == _DIRECT, F.xxhash64("key", "pos")).otherwise(F.col("h"))
        met = rows.repartition(dealt).sortWithinPartitions("h", "g", "key", "pos")
        found = cut(met.mapInArrow(_meet(last), "key long, pos int"))
        if last or found.isEmpty():
            return found
        size, before = min(2 * size, length), size


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = spans(batch.column(batch.schema.get_field_index("text")))
            values, sizes = _lists(batch, "positions")
            ends = np.cumsum(sizes)
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = data[off[i] : off[i + 1]].tobytes().split()
                n_words.append(len(words))
                if sizes[i]:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    at = values[ends[i] - sizes[i] : ends[i]]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + length, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    words = [words[j] for j in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("key")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["key", "n_words", "n_removed", "kept_text"],
            )

    return run


def deduplicate_substrings(docs: DataFrame, length: int = 20, base: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    texts, keys = keyed(docs)
    found = _by_document(repeated_windows(texts, length, base))
    cleaned = texts.join(found, "key", "left").mapInArrow(_remove(length), "key long, n_words long, n_removed long, kept_text string")
    return restored(cleaned, keys)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    out = deduplicate_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
