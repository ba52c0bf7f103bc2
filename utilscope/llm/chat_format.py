"""Conversations formatted by a chat template, with the spans that a model is trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilscope.llm.template import Template

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "{%- for message in messages -%}<s>{{ message.role | line | escape }}{{ '\\n' }}"
    "{%- if message.role == 'assistant' -%}"
    "{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{%- else -%}[INST]{{ ' ' ~ (message.content | escape) ~ ' ' }}[/INST]{%- endif -%}"
    "</s>{%- endfor -%}"
)
_TURN = re.compile(r"<s>([^\n]*)\n(?:\[INST\] (.*?) \[/INST\]|(.*?))</s>", re.S)


class Escapes:
    """Reversible escapes: a backslash behind the first character parts a control string.

    Further backslashes already there are kept, so that `unescape(escape(text)) == text` for every
    text, and an escaped text holds no control string.
    """

    def __init__(self, controls: tuple[str, ...] = CONTROLS):
        heads = {c[0] for c in controls}
        if any(set(c[1:]) & heads or len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("a control string's first character must not occur further on in any of them")
        parts = "|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in controls)
        undo = "|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in controls)
        self._add, self._remove = re.compile(parts), re.compile(undo)

    def escape(self, text: str) -> str:
        return self._add.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._remove.sub("", text)


def to_line(text: str) -> str:
    """The text in one line; reversible."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def from_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def compiled(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Template:
    return Template(source, {"escape": Escapes(controls).escape, "line": to_line})


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text formatted by TEMPLATE."""
    escapes, turns, at = Escapes(), [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        body = found[2] if found[2] is not None else found[3]
        turns.append((from_line(escapes.unescape(found[1])), escapes.unescape(body)))
    if at != len(formatted):
        raise ValueError("not a text of the template")
    return turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[dict]]]:
    """(conversation, messages) of rows sorted by conversation and turn; one is held at a time."""
    current, messages = None, []
    for batch in batches:
        ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for conv_id, role, text in zip(ids, roles, texts):
            if messages and conv_id != current:
                yield current, messages
                messages = []
            current = conv_id
            messages.append({"role": role or "", "content": text or ""})
    if messages:
        yield current, messages


def _formatted(batches: Iterator[pa.RecordBatch], source: str, most: int = 1000) -> Iterator[pa.RecordBatch]:
    template = compiled(source)
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])
    rows: list[dict] = []
    for conv_id, messages in _conversations(batches):
        text, spans = template.render({"messages": messages})
        spans = [{"start": a, "end": b} for a, b in spans]
        rows.append({"conv_id": conv_id, "n_turns": len(messages), "formatted": text, "loss_spans": spans})
        if len(rows) >= most:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def format_conversations(turns: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """`conv_id`, `n_turns`, `formatted`, `loss_spans` for every conversation.

    `turns` has conv_id, turn, role and text; further columns are not read. Turns are ordered by
    `turn` (NULL first), then role and text; repeated rows are turns of their own. NULL roles
    and texts are empty; rows of NULL conv_id make up one conversation. A conversation becomes
    one row, so one is rendered in one task; spans are code points of `formatted`, its
    generation markers.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        lambda batches: _formatted(batches, source),
        "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    escapes = Escapes()
    for batch in batches:
        rows = []
        for conv_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
            turns = read_back(text)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(escapes.unescape(text[s["start"]:s["end"]]) for s in spans)
            rows.append({
                "conv_id": conv_id, "n_turns": len(turns),
                "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(loss),
                "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text),
            })
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
        ]))


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from the formatted texts, as digests."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
