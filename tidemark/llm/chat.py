r"""Chat formatting by a grammar round trip.

    conversation = turn*        turn = "### " role ": " text "</turn>\n"

A backslash before a control string (`### `, `</turn>`, in roles also `: `) or before a backslash makes it plain text; any other backslash is itself. Each
value is rendered, read back by the same parser that readers use, and compared with its source: as it is, else with its control strings
escaped, else with its backslashes escaped too, until they are identical. A turn that reads back right does so in any place, as the
grammar is a row of turns.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length is spread over tasks, and written in parts of whole
turns; the parts of a conversation in order are its text. Loss spans are places (code points) inside a part.

A null text or role is empty. Rows with a null turn come first, those with a null conversation are one conversation. Turns of equal number stand by
role, then by the MD5 of their text, so repeated rows are turns of their own. An empty table gives no parts. Other columns take no part."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import splits, store, text_or_empty

OPEN, MID, CLOSE, END = "### ", ": ", "</turn>", "\n"
#: Control strings of a role, which MID ends, and of a text, which CLOSE ends.
CONTROLS = {MID: (OPEN, CLOSE, MID), CLOSE: (OPEN, CLOSE)}
BARE = {end: re.compile("|".join(map(re.escape, controls))) for end, controls in CONTROLS.items()}
TOKEN = {end: re.compile(rf"\\(?:\\|{p.pattern})|{p.pattern}") for end, p in BARE.items()}
#: Code points after which a part ends with its turn.
PART = 1 << 15
#: The role whose texts are learnt.
LEARNT = "assistant"


def read(text: str, at: int, end: str) -> tuple[str, int] | None:
    """The value that begins at a place and where what follows its end begins; None if the text breaks the grammar."""
    value = []
    for found in TOKEN[end].finditer(text, at):
        token = found.group()
        value.append(text[at : found.start()])
        if token == end:
            return "".join(value), found.end()
        if token[0] != "\\":
            return None
        value.append(token[1:])
        at = found.end()
    return None


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered text."""
    at, turns = 0, []
    while at < len(text):
        if not text.startswith(OPEN, at) or not (role := read(text, at + len(OPEN), MID)) or not (body := read(text, role[1], CLOSE)) or not text.startswith(END, body[1]):
            raise ValueError(f"no turn at {at}")
        turns.append((role[0], body[0]))
        at = body[1] + len(END)
    return turns


def escaped(value: str, end: str) -> str:
    """The value, escaped as little as makes it read back identical."""
    marked = lambda x: BARE[end].sub(r"\\\g<0>", x)
    for form in (lambda: value, lambda: marked(value), lambda: marked(value.replace("\\", "\\\\"))):
        tried = form()
        if read(tried + end, 0, end) == (value, len(tried) + len(end)):
            return tried
    raise AssertionError("an escaped value must read back")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends."""
    head = OPEN + escaped(role, MID) + MID
    body = escaped(text, CLOSE)
    return head + body + CLOSE + END, len(head), len(head) + len(body)


FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:int,stop:int>>, alone boolean"


def _parts(batches: Iterator[pa.RecordBatch], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Turns in order become parts. alone: no other part can hold turns of the conversation, as it neither meets an end of the task's
    range nor was cut."""
    first = part = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    now, begun, cut = None, False, False
    pieces, loss, size = [], [], 0

    def flush(alone: bool) -> None:
        nonlocal part, pieces, loss, size
        if pieces:
            rows.append((now, part, "".join(pieces), loss, alone))
            part += 1
        pieces, loss, size = [], [], 0

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv != now:
                flush(alone=not cut and part > first)
                cut = False
            elif size >= PART:
                flush(alone=False)
                cut = True
            now, begun = conv, True
            turn, start, stop = render(role, text)
            if role == LEARNT:
                loss.append({"start": size + start, "stop": size + stop})
            pieces.append(turn)
            size += len(turn)
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
            rows = []
    flush(alone=False)
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def _schema(spans: bool) -> pa.Schema:
    if spans:
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", span), ("alone", pa.bool_())])
    return pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. Returns the stored parts: conv_id, part (ascending along a conversation), formatted, loss (spans of
    formatted that are the assistant's texts), alone (whether the part is all of its conversation for certain)."""
    text = text_or_empty()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_or_empty("role").alias("role"), text.alias("text"), F.md5(text).alias("tie"))
    keys = ["conv_id", "turn", "role", "tie"]
    ordered = rows.repartitionByRange(splits(rows), *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text")
    target = _schema(True)
    return store(ordered.mapInArrow(lambda batches: _parts(batches, target), FORMATTED), "chats", compression="zstd")


def _digests(batches: Iterator[pa.RecordBatch], target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation from parts in order; only a batch of them and two running digests are held."""
    now, state, begun = None, None, False
    rows: list[tuple] = []

    def done() -> None:
        if begun:
            n, turns, chars, learnt, size = state
            rows.append((now, n, turns.hexdigest(), chars, learnt.hexdigest(), size))

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "loss")]
        for conv, formatted, loss in zip(*columns, strict=True):
            if not begun or conv != now:
                done()
                now, begun, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text, _ = read(formatted[span["start"] : span["stop"]] + CLOSE, 0, CLOSE)
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
            rows = []
    done()
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def turns(parts: DataFrame) -> DataFrame:
    """The turns that parts read back to: conv_id, part, place (in the part, from 0), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, part, i, role, text) for conv, part, formatted in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (role, text) in enumerate(parse(formatted))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["conv_id", "part", "place", "role", "text"])

    return parts.select("conv_id", "part", "formatted").mapInArrow(run, "conv_id long, part long, place int, role string, text string")


def report(parts: DataFrame) -> DataFrame:
    """What the stored parts read back to, a row a conversation: conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (the texts under the loss mask, one after the other), formatted_chars.

    Parts that are alone are read where they stand. The others, two conversations a task and those that were cut, are dealt by
    conversation and stream through a task in order."""
    target = _schema(False)
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "part", "formatted", "loss"]
    here = parts.where("alone").select(*columns)
    apart = parts.where("not alone").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    digest = lambda batches: _digests(batches, target)
    return here.mapInArrow(digest, kinds).unionByName(apart.mapInArrow(digest, kinds))
