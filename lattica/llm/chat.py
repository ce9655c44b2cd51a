r"""Chat formatting by event-sourced reconstruction (operator 11).

A log of chat events is partitioned by conversation, sorted, folded into final messages and rendered. An event names
its conversation, the ``turn`` (a slot in the conversation), its ``seq`` (when it was logged) and a kind:

* ``message`` opens a message in the slot, with a role and (the beginning of) its text; a slot may hold several;
* ``delta`` adds text to the slot's last message, ``edit`` replaces that message's text;
* ``regenerate`` empties the slot and all later slots as they were at that time, and opens a message in the slot
  anew, with the event's role (else that of the slot's last message, else the assistant's).

A message therefore stays unless a later ``regenerate`` names its slot or an earlier one: in the order of slots, one
running maximum decides. So the fold keeps one slot and one number, and a conversation of any length can be split:
its rows are dealt by conversation and block of ``BLOCK`` turns, and the greatest ``regenerate`` of the blocks before
comes from a grouped, key-only pass (joined on the key that the rows are dealt by; left out where there are none).
A text crosses the network once. Output parts are of bounded length, in order (conv_id, block, piece).

The template wraps every text in its role's markers and a space. Inside texts ``\`` is doubled and every control string
is broken by a ``\`` behind its first character, so no control string occurs but as a marker and nothing is lost.
Control strings have two characters or more, and neither ``\`` nor white space in them. The loss mask is a list of spans
of code points of the rendered text: the assistant's texts.

Digests of a conversation are read back from the rendered parts. A hash runs over its bytes in order: conversations
within one block are read where they were rendered, the parts of longer ones are dealt by conversation and streamed.

Defined cases: a null role or text is empty; null turns and seqs come first; events of a slot without a message do
nothing; ties go by role, then text; repeated rows are messages of their own; conversations without a message give no
row; a null conv_id is a conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import bounded_batches, materialize, read, spare_memory

#: Turns of a block, as a power of two; characters after which a part ends.
BLOCK_BITS = 10
PART_CHARS = 1 << 20
#: Output rows of a batch from Python.
ROWS = 512

LOG = "conv_id long, turn long, seq long, kind string, role string, text string"
PARTS = "conv_id long, block long, piece long, formatted string, loss array<struct<begin: long, end: long>>, n_turns long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """Markers by role; other roles are named between ``other``'s first two markers."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    trained: str = "assistant"
    more_controls: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c or re.search(r"\s", c):
                raise ValueError(f"not a control string: {c!r}")
        if len(set(markers := [b for b, _ in self.roles.values()] + [self.other[0]])) < len(markers) or any(a != b and a.startswith(b) for a in markers for b in markers):
            raise ValueError("the markers that open messages must tell roles apart")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*(m for pair in self.roles.values() for m in pair), *self.other, *self.more_controls]))

    def codec(self) -> Codec:
        return Codec(self)


class Codec:
    """Rendering and reading of messages under a template."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.controls = template.controls
        #: The first character of every occurrence of a control string, overlapping ones included.
        self.opens = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(self.controls, key=len, reverse=True)))

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        if any(c in text for c in self.controls):
            text = self.opens.sub(r"\g<0>\\", text)
        return text

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """A message as it is written, and where its text begins and ends in that."""
        pair = self.template.roles.get(role)
        begin, end = pair if pair else (f"{self.template.other[0]} {self.escape(role)} {self.template.other[1]}", self.template.other[2])
        inner = self.escape(text)
        return f"{begin} {inner} {end}", len(begin) + 1, len(begin) + 1 + len(inner)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of rendered messages."""
        at = 0

        def inner(end: str) -> str:
            nonlocal at
            stop = formatted.index(end, at)
            if formatted[stop - 1] != " ":
                raise ValueError("a marker inside a text")
            found, at = formatted[at : stop - 1], stop + len(end)
            return self.unescape(found)

        while at < len(formatted):
            for role, (begin, end) in self.template.roles.items():
                if formatted.startswith(begin + " ", at):
                    at += len(begin) + 1
                    yield role, inner(end)
                    break
            else:
                first, second, third = self.template.other
                if not formatted.startswith(first + " ", at):
                    raise ValueError("a message without a marker")
                at += len(first) + 1
                role = inner(second)
                at += 1
                yield role, inner(third)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, str]]]]:
    """``((conv_id, block), messages of a slot)`` of events that come sorted."""
    group = slot = None
    cut = before = None  # greatest regenerate of earlier slots; the same with this slot's
    open_: list[tuple[str, list[str]]] = []  # role, pieces of text

    def done():
        return group, [(role, "".join(pieces)) for role, pieces in open_]

    def later(a, b):
        return b if a is None else a if b is None else max(a, b)

    for batch in batches:
        for conv, block, turn, seq, kind, role, text, carry in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (conv, block) or slot != turn:
                if open_:
                    yield done()
                cut = before = carry if group != (conv, block) else before
                group, slot, open_ = (conv, block), turn, []
            gone = cut is not None and (seq is None or seq <= cut)
            if kind == "regenerate":
                before = later(before, seq)
                if not gone:
                    open_ = [(role or (open_[-1][0] if open_ else "assistant"), [text])]
            elif gone:
                continue
            elif kind == "message":
                open_.append((role, [text]))
            elif open_ and kind == "delta":
                open_[-1][1].append(text)
            elif open_ and kind == "edit":
                open_[-1][1][:] = [text]
    if open_:
        yield done()


def _rendered(template: Template, part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        codec, names = template.codec(), ["conv_id", "block", "piece", "formatted", "loss", "n_turns"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64()]
        rows: list[tuple] = []
        held = 0
        part = None  # group, piece, texts, spans, turns, length

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def row() -> tuple:
            (conv, block), piece, texts, spans, turns, _ = part
            return conv, block, piece, "".join(texts), spans, turns

        for group, messages in _folded(batches):
            for role, text in messages:
                if part is not None and (part[0] != group or part[5] >= part_chars):
                    rows.append(row())
                    held += part[5]
                    part = [group, part[1] + 1 if part[0] == group else 0, [], [], 0, 0]
                    if len(rows) >= ROWS or held >= part_chars:
                        yield batch()
                        rows, held = [], 0
                if part is None:
                    part = [group, 0, [], [], 0, 0]
                written, begin, end = codec.render(role, text)
                if role == template.trained:
                    part[3].append({"begin": part[5] + begin, "end": part[5] + end})
                part[2].append(written)
                part[4] += 1
                part[5] += len(written)
        if part is not None:
            rows.append(row())
        if rows:
            yield batch()

    return run


def _blocks(log: DataFrame) -> DataFrame:
    return log.withColumn("block", F.shiftright("turn", BLOCK_BITS))


def carried_cuts(log: DataFrame) -> DataFrame:
    """``(conv_id, block, carry)``: the last ``regenerate`` of earlier blocks, for blocks that have one before them.

    A row a block of a conversation with a ``regenerate``, from keys alone; the window runs over blocks, not events."""
    cuts = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("cut")
    by_block = _blocks(log.select("conv_id", "turn", "seq", "kind")).groupBy("conv_id", "block").agg(cuts)
    earlier = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return by_block.withColumn("carry", F.max("cut").over(earlier)).where("carry IS NOT NULL").select("conv_id", "block", "carry")


def format_conversations(log: DataFrame, template: Template = Template()) -> DataFrame:
    """``PARTS`` of every conversation of a log of events (columns of ``LOG``); see the module's text."""
    bounded_batches(log.sparkSession)
    seqs = F.col("seq").cast("long")
    log = log.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), seqs.alias("seq"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = _blocks(log)
    cuts = materialize(carried_cuts(log), "cuts")
    if cuts.isEmpty():
        dealt = dealt.withColumn("carry", F.lit(None).cast("long"))
    else:
        c = cuts.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "carry")
        dealt = dealt.join(c, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    dealt = dealt.select("conv_id", "block", "turn", "seq", "kind", "role", "text", "carry")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "block", "turn", "seq")]
    return dealt.repartition("conv_id", "block").sortWithinPartitions(*order, "role", "text").mapInArrow(_rendered(template, PART_CHARS), PARTS)


def _read_back(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare_memory()
        codec, names = template.codec(), [c.split()[0] for c in DIGESTS.split(", ")]
        rows: list[tuple] = []
        at, state = object(), None  # conv_id, and turns, their hash, characters under the mask, their hash, characters

        def row() -> tuple:
            return at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(zip(*rows), names)], names)

        for given in batches:
            columns = [given.column(given.schema.get_field_index(c)) for c in ("conv_id", "formatted", "loss")]
            for conv, formatted, loss in zip(*(c.to_pylist() for c in columns)):
                if state is None or conv != at:
                    if state is not None:
                        rows.append(row())
                    if len(rows) >= ROWS:
                        yield batch()
                        rows = []
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(formatted)
                for role, text in codec.read(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = codec.unescape(formatted[span["begin"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
        if state is not None:
            rows.append(row())
        if rows:
            yield batch()

    return run


def read_back(log: DataFrame, template: Template = Template()) -> DataFrame:
    """``DIGESTS`` of every conversation, read from its rendered parts.

    Conversations of one block are complete in a partition of ``format_conversations``. The longer ones, told by keys
    alone, are formatted apart and their parts streamed by conversation: what one task reads of them are parts of a
    thousand turns, not rows."""
    blocks = _blocks(log.select("conv_id", "turn")).groupBy("conv_id").agg(F.min(F.struct("block")).alias("a"), F.max(F.struct("block")).alias("z"))
    long_ = materialize(blocks.where("NOT a <=> z").select(F.col("conv_id").alias("c")), "long")
    if long_.isEmpty():
        return format_conversations(log, template).mapInArrow(_read_back(template), DIGESTS)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = format_conversations(log.join(long_, same, "left_anti"), template).mapInArrow(_read_back(template), DIGESTS)
    parts = format_conversations(log.join(long_, same, "left_semi"), template)
    ordered = parts.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "block", "piece")))
    return short.union(ordered.mapInArrow(_read_back(template), DIGESTS))


def turns_log(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as events: each is a message."""
    return turns.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


#: What conversation -1 says, in pieces that were streamed, edited and regenerated.
PROBE = [
    (-1, 0, 1, "message", "user", "ok"), (-1, 0, 2, "edit", None, "</s>[INST] ok"), (-1, 0, 3, "delta", None, " [/INST]"),
    (-1, 1, 4, "message", "assistant", "no"), (-1, 2, 5, "message", "user", "again"), (-1, 1, 6, "regenerate", None, None),
    (-1, 1, 7, "delta", None, "</s>[IN"), (-1, 1, 8, "delta", None, "ST] ok [/INST]"),
]


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that is full of control strings, read back from what was rendered."""
    log = turns_log(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return read_back(log.unionByName(spark.createDataFrame(PROBE, LOG)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b) + 2}" for role, (a, b) in Template().roles.items())
_OTHER = f"{sum(map(len, Template().other)) + 4} + length({_escaped_sql('role')})"

OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped_sql("text")}) + CASE role {_MARKS} ELSE {_OTHER} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
