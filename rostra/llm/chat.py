r"""Chat formatting by a grammar round trip.

A turn is ``<|im_start|>`` role, line end, text, ``<|im_end|>``, line end; a conversation is
its turns. Every turn is first rendered as it is and read again by :func:`parse`, which
knows one reading of any string or refuses it. What comes back must be the turn that went
in: a role or text that does not is escaped, and the turn is rendered and read again until it
is identical. Escaping puts one more backslash between ``<`` and ``|`` wherever only backslashes
stand there, and reading takes one off, so escaped content holds no control string and any
number of escapings comes off again; a line end in a role becomes ``<|nl|>``.

As turns are complete in themselves, they are rendered where their rows are, before any
shuffle. One shuffle by conversation then brings the rendered turns in order, and a task
streams them into parts of at most ``PART_CHARS`` code points (one turn at least), so that a
conversation of any length needs no more memory than a part. A digest is one sequential pass
over a conversation by nature; it streams too.

Loss spans are (start, length) in code points of a part: the escaped text of each turn of
the trained role, without its marks.

Defined results: a null text or role is empty; a conversation is the rows of one id, a null id
being an id as well; turns go by number, null first, equal numbers by their rendered text;
repeated rows are turns each; a table without rows gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The marks of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TRAINED = "assistant"
PART_CHARS = 1 << 20
#: Code points of the parts that go to Spark together.
_BATCH_CHARS = 1 << 22

_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PARTS = "part long, formatted string, loss array<struct<start:long,length:long>>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Turn(NamedTuple):
    role: str
    text: str
    start: int
    end: int


def escape(text: str) -> str:
    """Without control strings; :func:`unescape` gives the text back."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(formatted: str) -> Iterator[Turn]:
    """The turns of a formatted text, with the places of their texts; ValueError if it is not a row of turns."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(START)
        line = formatted.find("\n", at)
        if line < 0:
            raise ValueError(f"the role at {at} has no end")
        names = formatted[at:line].split(LINE)
        if any("<|" in x for x in names):
            raise ValueError(f"a control string stands in the role at {at}")
        end = formatted.find("<|", line + 1)
        if end < 0 or not formatted.startswith(END + "\n", end):
            raise ValueError(f"the text at {line + 1} has no end")
        yield Turn("\n".join(map(unescape, names)), unescape(formatted[line + 1 : end]), line + 1, end)
        at = end + len(END) + 1


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reads back as it is, and the start and length of its text in it."""
    head, body = role, text
    while True:
        out = f"{START}{head}\n{body}{END}\n"
        try:
            (read,) = parse(out)
        except ValueError:
            read = None
        if read and (read.role, read.text) == (role, text):
            return out, read.start, read.end - read.start
        # what conflicts is escaped once; a second failure cannot be, as nothing is left to conflict
        new = (head if _reads_as(head, "", role, "") else LINE.join(map(escape, role.split("\n"))), body if _reads_as("", body, "", text) else escape(text))
        if new == (head, body):
            raise AssertionError("an escaped turn does not read back")
        head, body = new


def _reads_as(head: str, body: str, role: str, text: str) -> bool:
    try:
        return [(t.role, t.text) for t in parse(f"{START}{head}\n{body}{END}\n")] == [(role, text)]
    except ValueError:
        return False


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """(conv, turn, piece, loss_start, loss_length): every row rendered; no shuffle. Turns of other roles have no loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [render(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            spans = [(a, n) if r == trained else (None, None) for r, (_, a, n) in zip(roles, done, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([p for p, _, _ in done], pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([n for _, n in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "turn", "piece", "loss_start", "loss_length"])

    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, piece string, loss_start long, loss_length long")


def parts(pieces: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv, part, formatted, loss): the turns of :func:`turns` joined in order; a conversation's parts are numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        conv, part, held, at, spans = None, 0, [], 0, []
        for batch in batches:
            for c, piece, a, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if held and (c != conv or at + len(piece) > part_chars):
                    found.append((conv, part, "".join(held), spans))
                    size += at
                    part = part + 1 if c == conv else 0
                    held, at, spans = [], 0, []
                conv = c
                if a is not None:
                    spans.append({"start": at + a, "length": n})
                held.append(piece)
                at += len(piece)
                if size > _BATCH_CHARS:
                    yield pack(found)
                    found, size = [], 0
        if held:
            found.append((conv, part, "".join(held), spans))
        if found:
            yield pack(found)

    kind = pieces.schema["conv"].dataType
    conv_type = to_arrow_type(kind)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        c, p, f, s = zip(*rows, strict=True)
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(c, conv_type), pa.array(p, pa.int64()), pa.array(f, pa.string()), pa.array(s, span)], names=["conv", "part", "formatted", "loss"])

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "turn", "piece")
    return ordered.mapInArrow(run, f"conv {kind.simpleString()}, {_PARTS}")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv, part, formatted, loss): all conversations under the template, with their loss spans."""
    return parts(turns(df, conv, turn, role, text, trained), part_chars).withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id", arranged: bool = False) -> DataFrame:
    """A digest of each conversation, from nothing but the formatted parts and their loss spans.

    n_turns; the sha256 of role, line end, text, line end of its turns; code points and
    sha256 of the unescaped text under the loss mask; code points of all parts. ``arranged``:
    the rows come straight from :func:`format_conversations`, in whose partitions conversations
    are whole and in order; others are dealt and sorted here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv_, state = None, None
        for batch in batches:
            for c, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or c != conv_:
                    if state is not None:
                        done.append(ended(conv_, state))
                    conv_, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for t in parse(text):
                    state[0] += 1
                    state[1].update(f"{t.role}\n{t.text}\n".encode())
                for s in spans:
                    loss = unescape(text[s["start"] : s["start"] + s["length"]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if len(done) >= 4096:
                yield pack(done)
                done = []
        if state is not None:
            done.append(ended(conv_, state))
        if done:
            yield pack(done)

    def ended(c, state: list) -> tuple:
        return c, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    kind = formatted.schema[conv].dataType
    conv_type = to_arrow_type(kind)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], names=[conv, *[x.split()[0] for x in DIGESTS.split(", ")]])

    rows = formatted.select(conv, "part", "formatted", "loss")
    if not arranged:
        rows = rows.repartition(conv).sortWithinPartitions(conv, "part")
    return rows.mapInArrow(run, f"`{conv}` {kind.simpleString()}, {DIGESTS}")


#: The same digests without a template engine: escaping is one replacement, and turns are joined in order.
ORACLE = r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""
