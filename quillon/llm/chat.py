"""Chat formatting from typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens the parts, in
order, into one string in which each attachment is a placeholder, and records for each
attachment what it refers to, where it stands, and how many tokens it expands to. Turns are
marked by control strings; what looks like one inside a text is escaped, so the texts can be
read back exactly from the formatted conversation, and the loss mask covers assistant texts only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded
from quillon.llm.spool import Spool, parts_for

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What must not survive inside a text: our own marks and those of templates in wide use.
CONTROL = [TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>"]
_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*)" + re.escape(END), re.S)
_ATTACHED = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))


def escape(text: str) -> str:
    """No control string is left: each gets a backslash after its first character; backslashes double."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Costs:
    """Tokens that an attachment expands to: an image by its patches, audio by its length, a document by its pages."""

    patch: int = 28
    audio_per_second: float = 12.5
    per_page: int = 512
    least: int = 1

    def image(self, part: dict) -> int:
        return max(self.least, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def audio(self, part: dict) -> int:
        return max(self.least, math.ceil((part.get("seconds") or 0) * self.audio_per_second))

    def document(self, part: dict) -> int:
        return max(self.least, (part.get("pages") or 0) * self.per_page)


@dataclass
class Flattener:
    """Visits parts in order. out: pieces of the formatted body; attachments: one record each."""

    costs: Costs = field(default_factory=Costs)
    out: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        kind = (part or {}).get("type")
        if part is None or kind is None:
            return
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"no such content part: {kind}")
        method(part)

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def end_text(self) -> None:
        """Escape the texts since the last attachment as one: a control string may begin in one part and end in the next."""
        if self.texts:
            self._put(escape("".join(self.texts)))
            self.texts.clear()

    def _attach(self, part: dict, tokens: int) -> None:
        self.end_text()
        kind = part["type"]
        self.attachments.append({"type": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self._put(PLACEHOLDERS[kind])

    def visit_image(self, part: dict) -> None:
        self._attach(part, self.costs.image(part))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, self.costs.audio(part))

    def visit_document(self, part: dict) -> None:
        self._attach(part, self.costs.document(part))


def format_turn(role: str, parts: list[dict | None], costs: Costs | None = None) -> tuple[str, int, int, list[dict]]:
    """The formatted turn, the loss span in it (equal ends: none), and its attachments."""
    visitor = Flattener(costs or Costs())
    for p in parts:
        visitor.visit(p)
    visitor.end_text()
    head, body = f"{TURN}{escape(role)}{BODY}", "".join(visitor.out)
    low = len(head)
    for a in visitor.attachments:
        a["at"] += low
    return f"{head}{body}{END}", low, low + len(body) if role == "assistant" else low, visitor.attachments


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders are not text."""
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(_ATTACHED.sub("", m[2]))


SEGMENTS = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, attachments array<struct<type: string, ref: string, at: int, tokens: int>>, expanded_tokens long"
_SEGMENT_TYPE = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))


def _format(costs: Costs):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(source):
            done = [format_turn(role or "", parts or [], costs) for role, parts in zip(b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True)]
            text, low, high, attached = zip(*done, strict=True) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(text, pa.string()), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
                pa.array(attached, _SEGMENT_TYPE), pa.array([sum(a["tokens"] for a in x) for x in attached], pa.int64()),
            ], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"])

    return run


def format_conversations(turns: DataFrame, costs: Costs | None = None) -> DataFrame:
    """One formatted segment a turn, conversations together and turns in order; a conversation's
    text is its segments in a row.

    turns: conv_id, turn, role, parts (see PARTS). Null parts are skipped, a null text is empty, a null role is ''.
    Rows with a null conv_id are left out; turns with equal numbers follow by role and parts.
    A conversation of any length is a run of rows, so no task ever holds one whole.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(PARTS).alias("parts")).where("conv_id is not null")
    n = parts_for(turns)
    ordered = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return ordered.mapInArrow(_format(costs or Costs()), SEGMENTS)


def _digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map segments, in order, to a row a conversation; holds digests of one conversation at a time."""
    now, state = None, None

    def row():
        return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d, e, f = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d, pa.int64()), pa.array(e), pa.array(f, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in bounded(source):
        done = []
        for conv, segment, low, high in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
            if conv != now:
                if state:
                    done.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            learnt = unescape(_ATTACHED.sub("", segment[low:high]))
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(segment)
        if done:
            yield out(done)
    if state:
        yield out([row()])


def conversation_digests(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted segments.

    formatted_chars: code points of all of a conversation's segments.
    """
    columns = segments.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end")
    ordered = columns.repartition(parts_for(columns), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def text_parts(text):
    """A text column as content parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def format_and_read_back(conversations: DataFrame, spool: Spool) -> DataFrame:
    """Format conversations (conv_id, turn, role, text), write the segments, and digest what is read back."""
    turns = conversations.select("conv_id", "turn", "role", text_parts(F.col("text").cast("string")).alias("parts"))
    return conversation_digests(spool.table("formatted", format_conversations(turns)))
