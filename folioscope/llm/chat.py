"""Operator 7: chat formatting of typed content parts.

A visitor walks a message's parts in order. Text is escaped and copied, every attachment (image, audio,
document) becomes an ordered placeholder, and its reference and the number of tokens that it will
expand to are recorded. A turn is a segment of the formatted conversation; the loss mask is a span of
code points in it. Control strings inside texts are escaped reversibly: backslashes are doubled and a
control string gets a backslash in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table

BEGIN = "<s>"
#: Template of each role: what stands before and after the text. Other roles use ROLE.
TEMPLATE = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", "</s>")}
ROLE = ("[ROLE:{}] ", " [/ROLE]")
CONTROL = re.compile(r"\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[OUT\]|\[ROLE:|<\|(?:image|audio|document):\d+\|>")
ESCAPED = re.compile(r"\\(\\|</?s>|\[/?(?:INST|SYS|ROLE)\]|\[OUT\]|\[ROLE:|<\|(?:image|audio|document):\d+\|>)")
SEGMENT = re.compile(r"\[(INST|SYS|OUT)\] (.*?)(?: \[/\1\]|</s>)|\[ROLE:((?:[^\\\]]|\\.)*)\] (.*) \[/ROLE\]", re.S)
OPENED = {"INST": "user", "SYS": "system", "OUT": "assistant"}
#: Tokens that attachments expand to: image patches of PATCH pixels a side, audio frames a second, document tokens a page.
PATCH, FRAMES, PAGE = 14, 25, 512
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Flattened:
    text: str = ""
    attachments: list[dict] = field(default_factory=list)


class Visitor:
    """One method a part type; an unknown or null type is read as text."""

    def __init__(self, first: int = 0):
        self.next = first

    def visit(self, parts: Iterable[dict | None]) -> Flattened:
        out = Flattened()
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part.get('type')}", self.visit_text)(part, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text += escape(part.get("text") or "")

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.text += f"<|{kind}:{self.next}|>"
        out.attachments.append({"place": self.next, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.next += 1

    def visit_image(self, part: dict, out: Flattened) -> None:
        wide, high = part.get("width") or 0, part.get("height") or 0
        self._attach("image", part, -(-wide // PATCH) * -(-high // PATCH), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, int(-(-(part.get("seconds") or 0) * FRAMES // 1)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PAGE, out)


def render(role: str | None, parts: Iterable[dict | None]) -> dict:
    """A turn's segment, its loss span (code points; empty unless the role is learned) and its attachments."""
    role = role or ""
    body = Visitor().visit(parts)
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = ROLE[0].format(re.sub(r"([\\\]])", r"\\\1", role)), ROLE[1]
    start, end = (len(before), len(before) + len(body.text)) if role == LEARNED else (0, 0)
    return {"segment": before + body.text + after, "loss_start": start, "loss_end": end, "attachments": body.attachments}


def read_back(segment: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if segment.startswith("[ROLE:"):
        m = SEGMENT.fullmatch(segment)
        return re.sub(r"\\(.)", r"\1", m[3], flags=re.S), unescape(m[4])
    name = segment[1 : segment.index("]")]
    role = OPENED[name]
    before, after = TEMPLATE[role]
    if not segment.endswith(after):
        raise ValueError("not a formatted turn")
    return role, unescape(segment[len(before) : len(segment) - len(after)])


ATTACHMENTS = "array<struct<place:int,kind:string,ref:string,tokens:bigint>>"
ATTACHED = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def formatted_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """One row per message: (conv, turn, segment, loss_start, loss_end, attachments).

    A message is parts_col (array of structs with type, text, ref, width, height, seconds, pages as far
    as they exist) or else one text part of text_col. Null texts, parts and roles are empty. A
    conversation is BEGIN and its segments in order of turn. Placeholders are numbered within a message.
    """
    body = parts_col or text_col
    conv, turn = (messages.schema[c].dataType.simpleString() for c in (conv_col, turn_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(3).to_pylist()
            rows = [render(r, (b or []) if parts_col else [{"type": "text", "text": b}]) for r, b in zip(batch.column(2).to_pylist(), bodies)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in (("segment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", ATTACHED)))],
                ["conv", "turn", "segment", "loss_start", "loss_end", "attachments"],
            )

    return messages.select(conv_col, turn_col, role_col, body).mapInArrow(run, f"conv {conv}, turn {turn}, segment string, loss_start int, loss_end int, attachments {ATTACHMENTS}")


class _Digest:
    """Running digests of one conversation; memory does not grow with its length."""

    def __init__(self) -> None:
        self.turns, self.loss = sha256(), sha256()
        self.n_turns, self.loss_chars, self.chars = 0, 0, len(BEGIN)

    def add(self, segment: str, start: int, end: int) -> None:
        role, text = read_back(segment)
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.chars += len(segment)
        if end > start:
            learned = unescape(segment[start:end])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """formatted_turns -> one row per conversation, read back from the segments and loss spans.

    Conversations are streamed in turn order (nulls first, equal turns by segment): a task holds one
    running digest, never a conversation. Rows without a conversation id form one. An empty table gives no rows.
    """
    conv = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[r[0] for r in rows], *([f(r[1]) for r in rows] for f in (lambda d: d.n_turns, lambda d: d.turns.hexdigest(), lambda d: d.loss_chars, lambda d: d.loss.hexdigest(), lambda d: d.chars))]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        now: tuple | None = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for c, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is None or now[0] != c:
                    if now is not None:
                        done.append(now)
                    now = (c, _Digest())
                now[1].add(segment, start, end)
            if done:
                yield out(done)
        if now is not None:
            yield out([now])

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "segment")
    return ordered.select("conv", "segment", "loss_start", "loss_end").mapInArrow(run, f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversation_digests(formatted_turns(rows.unionByName(extra))).withColumnRenamed("conv", "conv_id")


QUERIES = {"op7_chat_formatting": op7_chat_formatting}
_SAFE = r"replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '\', '\\'), '<s>', '\<s>'), '</s>', '\</s>'), '[INST]', '\[INST]'), '[/INST]', '\[/INST]'), '[SYS]', '\[SYS]'), '[/SYS]', '\[/SYS]'), '[OUT]', '\[OUT]'), '[ROLE:', '\[ROLE:'), '[/ROLE]', '\[/ROLE]')"
ORACLE = {
    "op7_chat_formatting": f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE r WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 10 ELSE 17 + length(r) END + length(regexp_replace({_SAFE}, '<\\|(image|audio|document):[0-9]+\\|>', '\\\\\\0', 'g')) AS n FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
