"""Token counts of whole texts; huge texts in overlapping chunks that are spliced.

A text longer than `huge` characters is encoded in chunks of `chunk` characters
of which neighbours overlap.  The tokenizer splits a text into pieces from left
to right, and a piece depends only on what follows its start, so two encodings
that begin a piece at the same character agree from there on, until the first
piece that the end of the earlier chunk may have cut.  A splice point is
therefore proven when, in the overlap, both encodings begin a piece at the same
character with the same run of `agree` tokens, and that run ends before the
last piece of the earlier chunk.  Where there is no such point, the overlap is
doubled and the chunk encoded again, in the end from the earlier splice point
itself, where the encoding begins a piece anyway, over twice as much new text
each time: text without any boundary costs a fixed multiple of one encoding.

Defined results: null counts as empty and has 0 tokens.  Rows are counted one
by one: repeated rows and doc_ids, null ids and further columns change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from legajo.llm.common import tune
from legajo.llm.text import slices, spans

TOKENIZER = "byte_bpe_50k.json"
HUGE, CHUNK, OVERLAP, AGREE, LIMIT = 1 << 15, 1 << 14, 1 << 9, 4, 1024


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunk:
    """Tokens of text[at : at + size] with absolute places."""

    def __init__(self, tokenizer, text: str, at: int, end: int):
        own = tokenizer.encode(text[at:end], add_special_tokens=False)
        self.at, self.end, self.ids = at, min(end, len(text)), own.ids
        self.start = [at + a for a, _ in own.offsets]
        word = own.word_ids
        # special strings are pieces of their own and carry no word id of the chunk
        self.begins = [i == 0 or word[i] is None or word[i] != word[i - 1] for i in range(len(word))]

    def last_piece(self) -> int:
        """Index of the first token of the last piece."""
        i = len(self.ids) - 1
        while i > 0 and not self.begins[i]:
            i -= 1
        return i


def _splice(left: _Chunk, right: _Chunk, first: int, agree: int) -> tuple[int, int] | None:
    """Token indexes (i in left, j in right) of the first proven common boundary; i is at least `first`."""
    places = {(left.start[i], left.ids[i]): i for i in range(first, left.last_piece()) if left.begins[i]}
    stop = left.last_piece()
    for j in range(1, len(right.ids)):
        if right.start[j] >= left.end:
            break
        i = places.get((right.start[j], right.ids[j])) if right.begins[j] else None
        if i is None or i + agree > stop:
            continue
        if left.ids[i : i + agree] == right.ids[j : j + agree] and left.start[i : i + agree] == right.start[j : j + agree]:
            return i, j
    return None


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> Iterator[list[int]]:
    """The token ids of text, chunk by chunk; together those of one encoding of the whole text."""
    left, done, more = _Chunk(tokenizer, text, 0, chunk), 0, chunk
    while left.end < len(text):
        wide, right, cut = overlap, None, None
        while cut is None:
            begin = left.end - wide
            if left.last_piece() < done + agree or begin <= left.start[done]:
                # no boundary proven: encode on from the last one, over more text
                left, more = _Chunk(tokenizer, text, left.at, left.end + more), 2 * more
                break
            right = _Chunk(tokenizer, text, begin, left.end + chunk)
            cut = _splice(left, right, done, agree)
            wide *= 2
        if cut is not None:
            yield left.ids[done : cut[0]]
            left, done, more = right, cut[1], chunk
    yield left.ids[done:]


def _count(path: str, huge: int, chunk: int, overlap: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in slices(batches, "text", 256 << 10):
            column = batch.column(batch.schema.get_field_index("text"))
            _, off = spans(column)
            sizes = off[1:] - off[:-1]
            texts = [x or "" for x in column.to_pylist()]
            short = [i for i, x in enumerate(texts) if len(x) <= huge]
            counts = [0] * len(texts)
            for i, own in zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
                counts[i] = len(own)
            for i in set(range(len(texts))) - set(short):
                counts[i] = sum(map(len, spliced(tokenizer, texts[i], chunk, overlap, agree)))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.record_batch([*rest, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row; `path`: a tokenizers .json file that all executors have."""
    tune(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_count(path or tokenizer_path(), huge, chunk, overlap, agree), "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    from legajo.llm.common import documents

    out = token_counts(documents(spark, sf_dir))
    return out.withColumn("over_limit", out.n_tokens > LIMIT)
