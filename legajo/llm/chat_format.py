"""Chat formatting of typed content parts, with an exact reader.

A turn holds parts: text, or an image, audio or document with a reference and
the number of tokens it expands to.  A visitor flattens them in order; an
attachment leaves a placeholder and an entry (kind, reference, tokens, place of
the placeholder).  The template writes

    <|turn|>role<|content|>flattened parts<|end|>

and escapes control strings that occur in roles and texts: a backslash goes in
after the first character, and one more where there are some already, so that
the escaped text holds no control string and the reader can undo it exactly.
The loss mask covers the texts of trainable roles, without placeholders.

A conversation's turns are streamed through one task in order, with constant
memory (digests can't be computed in pieces); a turn's format needs no other
turn.

Defined results: null text or role is empty; null turn sorts first, null
conv_id is a conversation of its own; rows that share conv_id and turn are
ordered by role and text, and repeated rows stay; unknown part types raise, and
so does a formatted text that doesn't consist of whole turns, or attachments
that don't fit its placeholders.  Further columns are ignored; a table without
turns gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import tune

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that texts may not hold as they are: the template's own and those of common chat templates.
CONTROL = (TURN, CONTENT, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED = ("assistant",)

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_FIRST = re.escape("".join(sorted({c[0] for c in CONTROL})))
#: First character, backslashes, rest; the rest decides with the character, so "<INST]" is harmless but escaped alike.
_ESCAPE = re.compile(rf"([{_FIRST}])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([{_FIRST}])\\(\\*)(?={_TAILS})")
_TURN = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(CONTENT)}(.*?){re.escape(END)}", re.DOTALL)
_PLACE = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))
_KIND = {v: k for k, v in PLACEHOLDERS.items()}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass
class Part:
    type: str
    text: str = ""
    ref: str = ""
    tokens: int = 0


@dataclass
class Flattener:
    """Visits parts in order and builds a turn's body."""

    at: int = 0
    out: list[str] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)

    def visit(self, part: Part) -> None:
        getattr(self, f"visit_{part.type}", self._unknown)(part)

    def visit_text(self, part: Part) -> None:
        # escaped on its own: a control string can't arise across parts, as parts are joined by placeholders or END
        body = escape(part.text)
        self.texts.append((self.at, self.at + len(body)))
        self._put(body)

    def visit_image(self, part: Part) -> None:
        self._attach(part)

    def visit_audio(self, part: Part) -> None:
        self._attach(part)

    def visit_document(self, part: Part) -> None:
        self._attach(part)

    def _attach(self, part: Part) -> None:
        self.attachments.append((part.type, part.ref, part.tokens, self.at))
        self._put(PLACEHOLDERS[part.type])

    def _put(self, body: str) -> None:
        self.out.append(body)
        self.at += len(body)

    def _unknown(self, part: Part) -> None:
        raise ValueError(f"unknown part type {part.type!r}")


def _joined_texts(parts: list[Part]) -> list[Part]:
    """Neighbouring text parts as one, so that no control string is built across their border."""
    out: list[Part] = []
    for p in parts:
        if p.type == "text" and out and out[-1].type == "text":
            out[-1] = Part("text", out[-1].text + p.text)
        else:
            out.append(p)
    return out


def format_turn(role: str, parts: list[Part]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int, int]]]:
    """The formatted turn, the spans of its texts, and its attachments (kind, ref, tokens, place)."""
    head = f"{TURN}{escape(role)}{CONTENT}"
    body = Flattener(at=len(head))
    for part in _joined_texts(parts):
        body.visit(part)
    return head + "".join(body.out) + END, body.texts, body.attachments


def parse(formatted: str, attachments: list[tuple[str, int]] | None = None) -> list[tuple[str, list[Part]]]:
    """(role, parts) of each turn of a formatted text.

    attachments: (reference, tokens) of all its placeholders in order; without
    them parts have their kind only.
    """
    out, end = [], 0
    left = None if attachments is None else list(attachments)
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"no turn begins at {end}")
        end = m.end()
        parts, at = [], 0
        for p in _PLACE.finditer(m[2]):
            if p.start() > at:
                parts.append(Part("text", unescape(m[2][at : p.start()])))
            if left is not None and not left:
                raise ValueError("more placeholders than attachments")
            ref, tokens = left.pop(0) if left else ("", 0)
            parts.append(Part(_KIND[p[0]], ref=ref, tokens=tokens))
            at = p.end()
        if at < len(m[2]) or not parts:
            parts.append(Part("text", unescape(m[2][at:])))
        out.append((unescape(m[1]), parts))
    if end != len(formatted):
        raise ValueError(f"no turn begins at {end}")
    if left:
        raise ValueError("more attachments than placeholders")
    return out


_CONTENT = "array<struct<type:string,text:string,ref:string,tokens:int>>"
_FORMATTED = "conv_id long, turn long, role string, text string, formatted string, loss array<struct<a:int,b:int>>, attachments array<struct<kind:string,ref:string,tokens:int,at:int>>, n_expanded long"


def _format(trained: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role = [x or "" for x in batch.column(2).to_pylist()]
            text = [x or "" for x in batch.column(3).to_pylist()]
            content = batch.column(4).to_pylist()
            formatted, loss, attached, expanded = [], [], [], []
            for r, t, c in zip(role, text, content, strict=True):
                parts = [Part("text", t)] if c is None else [Part(p["type"] or "text", p["text"] or "", p["ref"] or "", p["tokens"] or 0) for p in c]
                body, spans, more = format_turn(r, parts)
                formatted.append(body)
                loss.append([{"a": a, "b": b} for a, b in spans] if r in trained else [])
                attached.append([{"kind": k, "ref": f, "tokens": n, "at": at} for k, f, n, at in more])
                expanded.append(sum(n for _, _, n, _ in more))
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(role, pa.string()),
                    pa.array(text, pa.string()),
                    pa.array(formatted, pa.string()),
                    pa.array(loss, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array(attached, pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32()), ("at", pa.int32())]))),
                    pa.array(expanded, pa.int64()),
                ],
                names=["conv_id", "turn", "role", "text", "formatted", "loss", "attachments", "n_expanded"],
            )

    return run


def format_conversations(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row per turn: its formatted text, loss spans and attachments.

    turns: conv_id, turn, role and text or `content`, an array<struct<type
    string, text string, ref string, tokens int>>.  With both columns a row's
    content goes before its text, unless it is null.
    """
    tune(turns.sparkSession)
    if not {"text", "content"} & set(turns.columns):
        raise ValueError("turns have neither text nor content")
    text = F.col("text") if "text" in turns.columns else F.lit(None).cast("string")
    content = F.col("content").cast(_CONTENT) if "content" in turns.columns else F.lit(None).cast(_CONTENT)
    own = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", text.alias("text"), content.alias("content"))
    return own.mapInArrow(_format(trained), _FORMATTED)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, contents = [], []
        for formatted, attached in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            ((role, parts),) = parse(formatted, [(a["ref"], a["tokens"]) for a in attached])
            roles.append(role)
            contents.append([{"type": p.type, "text": p.text, "ref": p.ref, "tokens": p.tokens} for p in parts])
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(contents, kind)], names=["conv_id", "turn", "role", "content"])


def read_parts(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, role and content of each formatted turn: what format_conversations was given, neighbouring texts as one."""
    return formatted.select("conv_id", "turn", "formatted", "attachments").mapInArrow(_parts, f"conv_id long, turn long, role string, content {_CONTENT}")


class _Reader:
    """Digests of one conversation, read back from its formatted turns."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        for role, parts in parse(formatted):
            self.n += 1
            text = "".join(PLACEHOLDERS.get(p.type, p.text) for p in parts)
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss:
            text = unescape(formatted[span["a"] : span["b"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])
        done.clear()
        return out

    for batch in batches:
        for conv, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Reader(conv)
            now.add(formatted, loss)
        if done:
            yield flush()
    if now is not None:
        done.append(now.row())
        yield flush()


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: digests of what the reader finds in its formatted turns, in order."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(_read, _DIGEST)


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = tune(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(more)))
