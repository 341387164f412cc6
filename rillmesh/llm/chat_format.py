"""Chat formatting through incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string.  The
operator never looks inside it: it renders the first turn, the first two, and so
on, and compares consecutive outputs.  If an output extends the one before it, the
added part is exactly that turn's span.  If it does not, the template rewrites
history (it trims, reorders or summarises earlier turns) and the turn is flagged
with how many characters of the previous output survived.

Prefixes would cost a quadratic amount of rendering on a long conversation, so a
template states ``lookback``: how many earlier turns may influence a turn's
rendering.  The sliding list of turns handed to the template is then cut to that many
turns of context, with ``window`` new turns at a time.  The statement is checked: each window is also rendered
together with the one before it, and a template that then writes anything else raises :class:`LooksBack`, so
a preamble before the first turn only, or a history trimmed to fewer than ``2 * window`` turns, is not passed over.
``lookback=None`` renders every prefix whole.

A shuffle brings a conversation's turns (or a block of them) together; the rows arrive sorted
and are consumed as a stream, so with a stated ``lookback`` a task holds two windows of turns, never a
conversation; with ``None`` it holds the conversation at hand.

The default template marks turns with ``<|turn|>`` and ``<|end|>`` and escapes, inside
roles and texts, every marker-like opening ``<|`` and the escape character itself,
so a text that contains control strings of this or of other common templates
(``</s>``, ``[INST]``) reads back unchanged.

Defined results: null text and null role are empty strings; equal turn numbers are
ordered by role, then text; null turn numbers come first; repeated rows are repeated
turns; rows with a null conv_id form one conversation with a null id; very long texts and conversations are formatted
whole; an empty table gives no row; only the four columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Turn = tuple[str, str]
OPEN, MIDDLE, CLOSE, ESCAPE = "<|turn|>", "<|text|>", "<|end|>", "\\"
#: What other widespread templates use; escaped too, so no consumer can be misled.
FOREIGN = ("</s>", "<s>", "[INST]", "[/INST]")
_UNSAFE = re.compile("|".join(re.escape(x) for x in (ESCAPE, "<|", *FOREIGN)))
_ESCAPED = re.compile(re.escape(ESCAPE) + r"([\s\S])")
#: New turns per rendered window, and turn numbers per block of a split conversation.
WINDOW, BLOCK_TURNS = 16, 256


def escape(text: str) -> str:
    """Puts the escape character before every control-like opening and before itself."""
    return _UNSAFE.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    """Inverse of :func:`escape`: the escape character yields what follows it."""
    return _ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """The default template: context-free, one marked block per turn."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


_BLOCK = re.compile(re.escape(OPEN) + r"((?:\\[\s\S]|[^\\<]|<(?!\|))*)" + re.escape(MIDDLE) + r"((?:\\[\s\S]|[^\\<]|<(?!\|))*)" + re.escape(CLOSE))


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the span of the escaped text, for every block of ``formatted``."""
    found, at = [], 0
    while at < len(formatted):
        m = _BLOCK.match(formatted, at)
        if not m:
            raise ValueError(f"no turn block at {at}")
        found.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return found


@dataclass(frozen=True)
class Template:
    """A black-box renderer, its declared context and the reader of its output."""

    render: Callable[[list[Turn]], str] = turn_template
    lookback: int | None = 0
    parse: Callable[[str], list[tuple[str, str, int, int]]] | None = parse_turns


@dataclass(frozen=True)
class Span:
    """Where a turn landed: ``kept`` is how much of the previous output survived."""

    added: str
    rewrites: bool
    kept: int


def turn_spans(turns: list[Turn], render: Callable[[list[Turn]], str], known: int = 0) -> list[Span]:
    """Spans of ``turns[known:]`` by rendering ever longer prefixes."""
    before = render(turns[:known]) if known else ""
    spans = []
    for n in range(known + 1, len(turns) + 1):
        now = render(turns[:n])
        if now.startswith(before):
            spans.append(Span(now[len(before) :], False, len(before)))
        else:
            kept = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            spans.append(Span(now[kept:], True, kept))
        before = now
    return spans


class LooksBack(ValueError):
    """A template's output depends on more earlier turns than it states."""


def stream_spans(turns: Iterator[Turn], template: Template, window: int = WINDOW) -> Iterator[tuple[Turn, Span]]:
    """Spans of a conversation of any length, ``window`` new turns at a time."""
    context: list[Turn] = []
    pending: list[Turn] = []
    before: tuple[list[Turn], list[Span]] | None = None

    def spans() -> list[Span]:
        found = turn_spans(context + pending, template.render, len(context))
        if before is not None and not any(s.rewrites for s in before[1] + found):
            both = template.render(before[0] + pending)
            if both != template.render(before[0]) + "".join(s.added for s in found):
                raise LooksBack(f"a turn is written otherwise with more than {template.lookback} turns before it")
        return found

    for turn in turns:
        pending.append(turn)
        if len(pending) == window and template.lookback is not None:
            found = spans()
            yield from zip(pending, found, strict=True)
            before = (context + pending, found)
            context = (context + pending)[-template.lookback :] if template.lookback else []
            pending = []
    if pending:
        yield from zip(pending, spans(), strict=True)


_OUT = "conv_id {id}, turn_no long, turn long, role string, formatted string, start long, end long, loss_start long, loss_end long, rewrites_history boolean"


def _in_order(rows: DataFrame, partitions: int | None) -> DataFrame:
    """Turns of a conversation together and sorted; one shuffle."""
    keyed = rows.repartition("conv_id") if partitions is None else rows.repartition(partitions, "conv_id")
    return keyed.sortWithinPartitions("conv_id", "turn", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator]]:
    """Groups a sorted stream by conversation without holding one."""
    yield from itertools.groupby(_stream(batches), key=lambda r: r[0])


def normalised(conversations: DataFrame) -> DataFrame:
    """The four columns that are read, with nulls made empty."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_turns(conversations: DataFrame, template: Template = Template(), window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """One row per turn: its formatted part, its span in the conversation's output, and
    the span under the loss mask (assistant texts; null for other roles)."""
    common.short_batches(conversations.sparkSession)
    rows = normalised(conversations)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, group in _conversations(batches):
            at, numbers = 0, []

            def turns() -> Iterator[Turn]:
                for _, number, role, text in group:  # noqa: B023
                    numbers.append(number)  # noqa: B023
                    yield role, text

            for i, ((role, text), span) in enumerate(stream_spans(turns(), template, window)):
                start = at if not span.rewrites else span.kept
                loss = (None, None)
                if role == "assistant" and template.parse and not span.rewrites:
                    *_, (_, _, a, b) = template.parse(span.added)
                    loss = (start + a, start + b)
                out.append((conv, i, numbers[i], role, span.added, start, start + len(span.added), *loss, span.rewrites))
                at = start + len(span.added)
                if len(out) >= common.BATCH_ROWS:
                    yield _batch(out, _SCHEMA)
                    out = []
        if out:
            yield _batch(out, _SCHEMA)

    _SCHEMA = pa.schema([("conv_id", pa.int64() if kind in ("bigint", "int") else pa.string()), ("turn_no", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites_history", pa.bool_())])
    return _in_order(rows, partitions).mapInArrow(run, _OUT.format(id="long" if kind in ("bigint", "int") else "string"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _parsed(rows: DataFrame, template: Template, window: int) -> DataFrame:
    """One row per turn with what its formatted span reads back as: the costly part.

    Where a turn's rendering depends on no earlier turn, a conversation is cut into blocks of
    ``BLOCK_TURNS`` turn numbers that are formatted apart, so a conversation that holds a third of all
    rows is spread over many tasks; otherwise a conversation is one block.
    """
    block = F.floor(F.col("turn") / BLOCK_TURNS) if template.lookback == 0 else F.lit(0)
    keyed = rows.withColumn("block", block.cast("long")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kept", pa.int64()), ("added", pa.int64()), ("rewrites", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "role", "text")), strict=True))
        out: list[tuple] = []
        for (conv, blk), group in itertools.groupby(stream, key=lambda r: r[:2]):
            pos = 0
            for _, span in stream_spans(((role, text) for _, _, role, text in group), template, window):
                # A template that rewrites history can add several turns at once, or none (null role).
                read = template.parse(span.added) or [(None, None, 0, 0)]
                for k, (role, text, _, _) in enumerate(read):
                    out.append((conv, blk, pos, role, text, span.kept if span.rewrites else -1, len(span.added) if k == 0 else 0, span.rewrites))
                    pos += 1
                if len(out) >= common.BATCH_ROWS:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return keyed.mapInArrow(run, "conv_id long, block long, pos long, role string, text string, kept long, added long, rewrites boolean")


def read_back(conversations: DataFrame, template: Template = Template(), window: int = WINDOW) -> DataFrame:
    """One row per conversation, digested from the formatted output.

    Each turn's span is parsed back from what the template wrote, so roles, texts and
    the loss mask come from the output and not from the input.  Formatting and parsing are spread
    over blocks of turns; the digests, which are sequential by nature, then stream over a
    conversation's turns in order.  Neither step ever holds a conversation.
    """
    common.short_batches(conversations.sparkSession)
    turns = _parsed(normalised(conversations), template, window).repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "kept", "added", "rewrites")), strict=True))
        out: list[tuple] = []
        for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
            whole, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            changed = False
            for _, role, text, kept, added, rewrites in group:
                changed |= rewrites
                chars = (kept if kept >= 0 and added else chars) + added
                if role is None:
                    continue
                n += 1
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            out.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, changed))
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")


#: The conversation that every run adds: control strings as content.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(rows.unionByName(probe))


_ESC = "replace(replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '<|', '\\<|'), '</s>', '\\</s>'), '<s>', '\\<s>'), '[INST]', '\\[INST]'), '[/INST]', '\\[/INST]')"
OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}'
), e AS (
  SELECT *, length({_ESC.format(c="role")}) + length({_ESC.format(c="text")}) + {len(OPEN + MIDDLE + CLOSE)} AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM e GROUP BY conv_id
"""
