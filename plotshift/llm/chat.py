"""Chat formatting with typed content parts.

A visitor goes over a turn's parts in order: text is escaped, images, audio and documents become numbered placeholders,
whose references and expanded token counts are recorded. A turn becomes one segment with its place of text, which is under
the loss if the role is the assistant's. Rows are dealt by conversation and sorted by turn within the tasks; a task walks
through them and holds one turn at a time, so one conversation with a third of all rows needs no more memory than another.

Template of a turn: ``### <role>:``, a new line, the content, ``</turn>``, a new line. Inside contents (and roles) a
backslash before a character stands for it: backslashes are doubled, and control strings are broken by one after their
first character, so no content can open or close a turn or imitate a placeholder, and ``unescape`` gives it back.

Defined cases: a null text is empty; a null role is the empty role; null conversation ids form one conversation; ties in a
turn are ordered by role and text, repeated rows all stay; unknown part kinds are an error of the data and read as text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, LOSS_ROLE = "### ", "</turn>\n", "assistant"
CONTROL = re.compile(r"\\|###|</turn>|<\|")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Backslashes doubled; the control strings broken behind their first character."""
    return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:] if m[0] != "###" else "\\#\\#\\#", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class Visitor:
    """Flattens parts into text with placeholders; a method per kind of part."""

    attachments: list[dict] = field(default_factory=list)
    #: Tokens of a 512-pixel tile and of each image, of a second of sound, and of a page.
    tile: int = 170
    image: int = 85
    second: int = 50
    page: int = 1500

    def visit(self, parts: list[dict]) -> str:
        return "".join(getattr(self, f"on_{p.get('kind')}", self.on_text)(p) for p in parts)

    def on_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def on_image(self, part: dict) -> str:
        tiles = -(-(part.get("width") or 512) // 512) * -(-(part.get("height") or 512) // 512)
        return self._attach("image", part, self.image + self.tile * tiles)

    def on_audio(self, part: dict) -> str:
        return self._attach("audio", part, int(-(-(part.get("seconds") or 0.0) * self.second // 1)))

    def on_document(self, part: dict) -> str:
        return self._attach("document", part, self.page * (part.get("pages") or 1))

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"index": len(self.attachments), "kind": kind, "uri": part.get("uri"), "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, visitor, turn = object(), Visitor(), 0
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("place", "segment", "loss_start", "loss_end", "attachments", "extra_tokens")}
        for conv, role, parts in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "parts")]):
            if conv != last:
                last, visitor, turn = conv, Visitor(), 0
            seen = len(visitor.attachments)
            content = visitor.visit(parts or [])
            new = visitor.attachments[seen:]
            head = f"{OPEN}{escape(role or '').replace(':', chr(92) + ':')}:\n"
            loss = role == LOSS_ROLE
            out["place"].append(turn)
            out["segment"].append(head + content + CLOSE)
            out["loss_start"].append(len(head) if loss else 0)
            out["loss_end"].append(len(head) + len(content) if loss else 0)
            out["attachments"].append(new)
            out["extra_tokens"].append(sum(a["tokens"] for a in new))
            turn += 1
        ref = pa.list_(pa.struct([("index", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), ref, pa.int64())
        yield pa.RecordBatch.from_pydict({"conv_id": batch.column("conv_id")} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of (conv_id, turn, role, parts), conversations together and turns in order inside a partition:
    (conv_id, place, segment, loss_start, loss_end, attachments, extra_tokens). A conversation's text is its segments."""
    ordered = turns.select("conv_id", "turn", "role", "parts").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    schema = (
        "conv_id long, place long, segment string, loss_start long, loss_end long, "
        "attachments array<struct<index:long,kind:string,uri:string,tokens:long>>, extra_tokens long"
    )
    return ordered.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(_format, schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from nothing but its segments and loss places."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "extra_tokens")
    open_: list | None = None

    def close() -> list:
        return [open_[0], open_[1], open_[2].hexdigest(), open_[3], open_[4].hexdigest(), open_[5], open_[6]]

    for batch in batches:
        done = []
        for conv, place, segment, lo, hi, extra in zip(
            *[batch.column(c).to_pylist() for c in ("conv_id", "place", "segment", "loss_start", "loss_end", "extra_tokens")]
        ):
            if place == 0:
                if open_ is not None:
                    done.append(close())
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, content in TURN.findall(segment):
                open_[1] += 1
                open_[2].update(f"{unescape(role)}\n{unescape(content)}\n".encode())
            under = unescape(segment[lo:hi])
            open_[3] += len(under)
            open_[4].update(under.encode())
            open_[5] += len(segment)
            open_[6] += extra
        yield _rows(names, done)
    if open_ is not None:
        yield _rows(names, [close()])


def _rows(names: tuple[str, ...], rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))


def text_parts(conversations: DataFrame) -> DataFrame:
    """Rows with a text as rows with one text part."""
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *empty)
    return conversations.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def report(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns; a conversation -7 of control strings is added."""
    spark, said = conversations.sparkSession, "\\### Assistant: </turn> ok"
    kinds = dict(conversations.dtypes)
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, LOSS_ROLE, said)], "conv_id long, turn long, role string, text string")
    probe = probe.select(*[F.col(c).cast(kinds[c]).alias(c) for c in probe.columns])
    turns = text_parts(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, extra_tokens long"
    return format_turns(turns).mapInArrow(_read_back, schema)
