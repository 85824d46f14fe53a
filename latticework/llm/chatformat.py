"""Conversations formatted by a compiled template, with generation masks, and read back from the output.

A `Format` is a template over `messages` (see templates.py), a list of control strings that mark turns in it, and how the marks
open and close a turn. The filter `escape` puts a backslash after the first character of each control string inside a text (and
one more where there are some already), so a text never holds a control string and every escape can be undone.

Formatted conversations are tables of parts: (key, part, text, spans), spans being the bounds, in code points of the part, of what
lies under the generation mask. A conversation is one part, or several of over PART code points, each of whole turns, so parts can
be read back on their own. Rows are ordered by turn within a conversation; they pass through the renderer one at a time, so
a conversation with very many turns takes no more memory than one turn and one part. Its turns do pass through one task, in
order: a template may look at the turn before, and the digest over a conversation is one chain.

Defined results: a null role or text is an empty one. Null turns come first; rows that tie in turn are ordered by role, then text,
nulls first; repeated rows are turns of their own. Rows with a null id are one conversation. Further columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, templates

#: Code points after which a part ends with the turn, and rows or code points of one batch of output.
PART, ROWS_OUT, SIZE_OUT = 1 << 20, 256, 1 << 22
TEMPLATE = """
{%- for m in messages -%}
    {%- if m.role == 'user' -%}
        {{ '[INST] ' ~ (m.text | escape) ~ ' [/INST]' }}
    {%- elif m.role == 'assistant' -%}
        {{ '<s>' }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '</s>' }}
    {%- elif m.role == 'system' -%}
        {{ '[SYS] ' ~ (m.text | escape) ~ ' [/SYS]' }}
    {%- else -%}
        {{ '[ROLE] ' ~ (m.role | escape) ~ ' [TEXT] ' ~ (m.text | escape) ~ ' [/ROLE]' }}
    {%- endif -%}
    {{ '\\n' }}
{%- endfor -%}
"""
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[TEXT]", "[/ROLE]")
#: (role, what opens its turns, what closes them); a null role stands between the opening and `named`.
MARKS = (("user", "[INST] ", " [/INST]\n"), ("assistant", "<s>", "</s>\n"), ("system", "[SYS] ", " [/SYS]\n"), (None, "[ROLE] ", " [/ROLE]\n"))
NAMED = " [TEXT] "


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    loss: str | None  # what of it lies under the mask


class Format:
    def __init__(self, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, marks: tuple = MARKS, named: str = NAMED):
        for c in controls:
            if len(c) < 2 or "\\" in c or any(c[0] in other[1:] for other in controls):
                raise ValueError(f"a control string needs two characters or more, no backslash, and a first character that none has further on: {c!r}")
        heads = {c[0]: [] for c in controls}
        for c in controls:
            heads[c[0]].append(re.escape(c[1:]))
        any_of = "|".join(f"{re.escape(h)}(?=\\\\*(?:{'|'.join(rest)}))" for h, rest in heads.items())
        self._escape = re.compile(any_of)
        self._unescape = re.compile(f"({any_of})\\\\")
        self.template, self.controls, self.marks, self.named = template, controls, marks, named
        self._render = templates.compiled(template, {"escape": lambda x: self.escaped(templates.shown(x))})

    def __reduce__(self) -> tuple:
        return Format, (self.template, self.controls, self.marks, self.named)  # compiled anew in each worker

    def escaped(self, text: str) -> str:
        return self._escape.sub(r"\g<0>\\", text)

    def unescaped(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def parts(self, messages: Iterable[dict], most: int = PART) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, spans) of one conversation; there is always one, be it empty."""
        texts: list[str] = []
        spans: list[tuple[int, int]] = []
        size, given = 0, False
        for piece in self._render(messages=messages):
            if piece is templates.CUT:
                if size >= most:
                    yield "".join(texts), spans
                    texts, spans, size, given = [], [], 0, True
                continue
            text, generated = piece
            if text and generated:
                spans.append((size, size + len(text)))
            texts.append(text)
            size += len(text)
        if size or not given:
            yield "".join(texts), spans

    def turns(self, text: str, spans: list[tuple[int, int]]) -> Iterator[Turn]:
        """The turns of one part, read by its marks, each with what lies under the mask inside it."""
        at, masked = 0, iter([*spans, (len(text) + 1, 0)])
        start, end = next(masked)
        while at < len(text):
            role, opening, closing = next((m for m in self.marks if text.startswith(m[1], at)), (None, None, None))
            if opening is None:
                raise ValueError(f"no turn begins at code point {at}")
            at += len(opening)
            if role is None:
                to = text.index(self.named, at)
                role, at = self.unescaped(text[at:to]), to + len(self.named)
            to = text.index(closing, at)
            loss = []
            while start < to:
                loss.append(self.unescaped(text[max(start, at) : min(end, to)]))
                start, end = next(masked)
            yield Turn(role, self.unescaped(text[at:to]), "".join(loss) if loss else None)
            at = to + len(closing)


# --- tables ---------------------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_at: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded count and size."""
    some: list[tuple] = []
    size = 0
    for row in rows:
        some.append(row)
        size += len(row[size_at]) if size_at is not None else 0
        if len(some) >= ROWS_OUT or size >= SIZE_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(
    spark: SparkSession, rows: DataFrame, form: Format | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(key, part, text, spans) of every conversation; the parts of one lie in one partition, in order."""
    shared.small_batches(spark)
    form = form or Format()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for one, group in itertools.groupby(_rows(batches), lambda r: r[0]):
                messages = ({"role": r[2] or "", "text": r[3] or ""} for r in group)
                for n, (said, spans) in enumerate(form.parts(templates.Stream(messages))):
                    yield one, n, said, [{"start": a, "end": b} for a, b in spans]
                for _ in messages:  # what a template has left unread
                    pass

        kind = pa.schema([("key", kind_of["key"]), ("part", pa.int64()), ("text", pa.string()), ("spans", _ARROW_SPAN)])
        yield from _batches(made(), kind, 2)

    given = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", SPAN)])
    kind_of = {"key": _arrow(rows.schema[key].dataType)}
    dealt = rows.select(rows[key].alias("key"), rows[turn].alias("turn"), rows[role].alias("role"), rows[text].alias("text"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return dealt.mapInArrow(run, given).withColumnRenamed("key", key)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_back(spark: SparkSession, parts: DataFrame, form: Format | None = None, key: str = "conv_id") -> DataFrame:
    """(key, part, n, role, text, loss): the turns of every part, numbered within it, and what of each lies under the mask (null: nothing)."""
    form = form or Format()
    kind = _arrow(parts.schema[key].dataType)
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for one, part, text, spans in _rows(batches):
                for n, t in enumerate(form.turns(text, [(s["start"], s["end"]) for s in spans])):
                    yield one, part, n, t.role, t.text, t.loss

        yield from _batches(made(), pa.schema([("key", kind), ("part", pa.int64()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string())]), 4)

    given = T.StructType([T.StructField("key", parts.schema[key].dataType), T.StructField("part", T.LongType()), T.StructField("n", T.LongType())])
    for c in ("role", "text", "loss"):
        given.add(c, T.StringType())
    return parts.select(parts[key].alias("key"), "part", "text", "spans").mapInArrow(run, given).withColumnRenamed("key", key)


def digests(spark: SparkSession, parts: DataFrame, form: Format | None = None, key: str = "conv_id", in_order: bool = False) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from its parts.

    Parts straight from `format_conversations` are `in_order`; others are dealt by conversation and sorted first.
    """
    form = form or Format()
    kind = _arrow(parts.schema[key].dataType)
    shared.small_batches(spark)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for one, group in itertools.groupby(_rows(batches), lambda r: r[0]):
                turns, losses = hashlib.sha256(), hashlib.sha256()
                n = lost = size = 0
                for _, _, text, spans in group:
                    size += len(text)
                    for t in form.turns(text, [(s["start"], s["end"]) for s in spans]):
                        n += 1
                        turns.update(f"{t.role}\n{t.text}\n".encode())
                        lost += len(t.loss or "")
                        losses.update((t.loss or "").encode())
                yield one, n, turns.hexdigest(), lost, losses.hexdigest(), size

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from _batches(made(), pa.schema([("key", kind), *zip(names, kinds, strict=True)]))

    given = T.StructType([T.StructField("key", parts.schema[key].dataType)])
    for c in names:
        given.add(c, T.StringType() if c.endswith("256") else T.LongType())
    parts = parts.select(parts[key].alias("key"), "part", "text", "spans")
    if not in_order:
        parts = parts.repartition("key").sortWithinPartitions("key", "part")
    return parts.mapInArrow(run, given).withColumnRenamed("key", key)
