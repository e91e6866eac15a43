"""Chat formatting: a finite-state machine over roles checks turn order and emits text segments with loss flags.

A declarative Template names the marks and, for each role, whether its text carries loss. Each turn gives three
segments: head, body, tail. Control strings inside a text or role are broken by an escape mark after their first
character (the escape mark itself is doubled), so no control string survives in a body and reading back is exact.

Rows are dealt out by conversation and sorted by turn; a task streams over them, holding one batch and the state of one
conversation. A conversation of any length therefore needs no memory, though its digest is one chain of hashing.

Defined results: null text and null role count as empty; a null conversation id is a conversation of its own; rows with
equal turns are ordered by role, then text; a null turn comes first; a conversation whose order the machine refuses is
formatted all the same, with valid false and the first refused position; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles whose text carries loss, and the strings a text may not contain."""

    open: str = "<|turn|>"
    between: str = "\n"
    close: str = "</s>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("<|turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> role -> next state
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: frozenset[str] = frozenset({"assistant"})


CHAT = Template()


class Codec:
    def __init__(self, t: Template):
        self.t = t
        self.controls = re.compile("(?=(?:" + "|".join(map(re.escape, t.controls)) + "))(.)", re.S)
        self.escaped = re.compile(re.escape(ESCAPE) + "(.)", re.S)

    def escape(self, text: str) -> str:
        return self.controls.sub(lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text) if ESCAPE in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, text, loss) of one turn. A role is one line: its line ends are escaped too."""
        head = self.t.open + self.escape(role).replace("\n", ESCAPE + "n") + self.t.between
        return [("head", head, False), ("body", self.escape(text), role in self.t.loss_roles), ("tail", self.t.close, False)]

    def role_in(self, head: str) -> str:
        inner = head[len(self.t.open) : len(head) - len(self.t.between)]
        return self.escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], inner)


def step(t: Template, state: str, role: str) -> str:
    """The next state; 'refused' has no way out."""
    return t.moves.get(state, {}).get(role, "refused")


SEGMENT = "conv_id bigint, turn bigint, pos bigint, segment int, kind string, text string, loss boolean, state string"


def _sorted(conversations: DataFrame) -> DataFrame:
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _emit(rows: Iterable[pa.RecordBatch], t: Template) -> Iterator[tuple[Any, Any, int, list[tuple[str, str, bool]], str]]:
    """(conv_id, turn, position, segments, state) of sorted rows."""
    codec, conv, state, pos, first = Codec(t), None, "start", 0, True
    for batch in rows:
        for c, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
            if first or c != conv:
                conv, state, pos, first = c, "start", 0, False
            state = step(t, state, role)
            yield c, turn, pos, codec.segments(role, text), state
            pos += 1


def format_segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row for each segment, in SEGMENT's columns; joining text by conv_id, pos, segment gives the formatted chat."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c, turn, pos, parts, state in _emit(rows, template):
            out += [(c, turn, pos, k, kind, text, loss, state) for k, (kind, text, loss) in enumerate(parts)]
            if len(out) >= 3000:
                yield _batch(out, SEGMENT_ARROW)
                out = []
        if out:
            yield _batch(out, SEGMENT_ARROW)

    return _sorted(conversations).mapInArrow(run, SEGMENT)


SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("pos", pa.int64()), ("segment", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, refused_at bigint"
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("refused_at", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Reader:
    """Reads one conversation back from its segments: what the formatted text says, not what went in."""

    def __init__(self, codec: Codec, conv: Any):
        self.codec, self.conv, self.turns, self.chars, self.loss_chars, self.refused = codec, conv, 0, 0, 0, None
        self.all, self.loss, self.state = hashlib.sha256(), hashlib.sha256(), "start"

    def add(self, parts: list[tuple[str, str, bool]], state: str) -> None:
        for kind, text, loss in parts:
            self.chars += len(text)
            if kind == "head":
                self.all.update(self.codec.role_in(text).encode() + b"\n")
            elif kind == "body":
                plain = self.codec.unescape(text)
                self.all.update(plain.encode() + b"\n")
            if loss:
                plain = self.codec.unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        if state == "refused" and self.refused is None:
            self.refused = self.turns
        self.turns, self.state = self.turns + 1, state

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state in self.codec.t.final, self.refused)


def digest(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row for each conversation, read back from its formatted segments."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reader, out = Codec(template), None, []
        for c, _, pos, parts, state in _emit(rows, template):
            if pos == 0:
                if reader:
                    out.append(reader.row())
                reader = Reader(codec, c)
                if len(out) >= 5000:
                    yield _batch(out, DIGEST_ARROW)
                    out = []
            reader.add(parts, state)
        if reader:
            yield _batch([*out, reader.row()], DIGEST_ARROW)

    return _sorted(conversations).mapInArrow(run, DIGEST)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def _oracle() -> str:
    def body(col: str) -> str:
        marks = " + ".join(f"(length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}" for c in CHAT.controls)
        return f"length({col}) + (length({col}) - length(replace({col}, '\\', ''))) + {marks}"

    fixed = len(CHAT.open + CHAT.between + CHAT.close)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS prev, lead(role) OVER w IS NULL AS is_last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, coalesce((prev IS NULL AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user' AND pos = 1) OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user'), false) AS ok FROM o)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({fixed} + {body("role")} + {body("text")}) AS BIGINT) AS formatted_chars,
    bool_and(ok) AND bool_or(is_last AND role = 'assistant') AS valid,
    CAST(min(pos) FILTER (NOT ok) AS BIGINT) AS refused_at
FROM s GROUP BY conv_id
"""


ORACLES = {"op4_chat_format": _oracle()}
QUERIES = {"op4_chat_format": op4_chat_format}
