"""Secret scans with a worklist of decoded layers.

A text is the first layer. Every layer is scanned, and for every code (percent escapes, ``\\u``/``\\x`` and character
references, base64, also over several lines, zlib and gzip inside base64) the whole layer with its stretches replaced by
their decoding is a new layer that goes on the worklist, until no layer gives another. A layer with the same text from the
same places is not opened again, which ends cycles. A find in a layer is reported at the part of the outermost text that it
came from, wherever it stands. Everything happens in the row, without a shuffle.

Kinds: ``assign``, ``access`` and ``hex`` by their stated rules on the text itself; finds in inner layers are additions
named ``<kind>@<steps>``, for instance ``access@base64``.

Defined cases: a null text counts as empty; rows are judged one by one, repeated ones alike; an inner layer that would
unpack to more than ``MOST_BYTES`` is named ``oversized`` as a find of its own instead of being opened.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 1, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: A text without any of these holds no find of its kind; testing that is cheaper than trying the rule at every place.
HINTS = {"assign": re.compile(r"[:=]"), "access": re.compile("AKIA"), "hex": re.compile("[0-9a-f]{32}")}

#: Percent-coded and character-coded stretches, and base64: a line's run, the lines that may continue it, and a run's end.
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
ESCAPES = re.compile(rf"(?:{ESCAPE.pattern})+".replace("([", "(?:["))
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
NEXT = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2}|={1,2})")
LINE_END = re.compile(r"[\x20\t]*(?:\r?\n|\Z)")
#: How base64 of a gzip or zlib stream begins.
ZIPPED = ("H4s", "eA", "eF", "eJ", "eN")
STANDARD = str.maketrans("-_", "+/", "=")
MOST_BYTES = 16 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every find in one layer."""
    found = []
    for place, (kind, rule, group, shortest) in enumerate(KINDS):
        if HINTS[kind].search(text):
            found += [(m.start(), place, m.end()) for m in rule.finditer(text) if m.end(group) - m.start(group) >= shortest]
    return sorted(found)


def _inflate(data: bytes) -> bytes | None:
    """The unpacked bytes of a zlib or gzip stream; None if it is none; more than MOST_BYTES if it is too large."""
    if data[:2] != b"\x1f\x8b" and not (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0):
        return None
    try:
        return zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(data, MOST_BYTES + 1)
    except zlib.error:
        return None


#: What one step decodes together: its name, and (start, end, text) of its parts, each with the text that takes its place.
Decoded = tuple[str, list[tuple[int, int, str]]]


def _percent(layer: str) -> Iterator[Decoded]:
    for m in PERCENT.finditer(layer):
        yield "url", [(*m.span(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"))]


def _unicode(layer: str) -> Iterator[Decoded]:
    for m in ESCAPES.finditer(layer):
        plain = ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else html.unescape(e[0]), m[0])
        yield "unicode", [(*m.span(), plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))]


def _unpacked(body: str) -> tuple[str, str] | int:
    """Step and text of one base64 body; else how many of its bytes may begin a readable text."""
    if len(body) % 4 == 1:
        return len(body) * 3 // 4
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return 0
    inner = _inflate(data)
    if inner is not None and len(inner) > MOST_BYTES:
        return "oversized", ""
    try:
        text = (data if inner is None else inner).decode()
    except UnicodeDecodeError as e:
        return e.start if inner is None else 0
    for i, c in enumerate(text):
        if not (c.isprintable() or c in "\t\n\r"):
            return len(text[:i].encode()) if inner is None else 0
    return "base64" if inner is None else "base64+zip", text


def _base64(layer: str) -> Iterator[Decoded]:
    """Of a run with the lines that continue it (all of one length, the last may be shorter) the longest part that decodes."""
    at = 0
    while m := BASE64.search(layer, at):
        at = m.end()
        body = m[0].translate(STANDARD)
        begin, full = _unpacked(body[: len(body) // 4 * 4]), len(body) // 4 * 3
        if isinstance(begin, int) and begin + 4 <= full and not body.startswith(ZIPPED):
            continue  # what is unreadable before the run's end stays so with more lines
        parts, lines, length = [body], [(len(body), *m.span())], 0  # characters so far, and the line's place
        while layer[lines[-1][2] - 1] != "=" and LINE_END.match(layer, lines[-1][2]) and (n := NEXT.match(layer, lines[-1][2])):
            run = n[1].translate(STANDARD)
            if length and len(run) > length:
                break
            parts.append(run)
            lines.append((lines[-1][0] + len(run), *n.span(1)))
            if length and len(run) < length:
                break
            length = length or len(run)
        whole = "".join(parts)
        while lines:
            out = _unpacked(whole[: lines[-1][0]])
            if isinstance(out, tuple):
                at = lines[-1][2]
                yield out[0], _by_line(lines, out[1]) if out[0] == "base64" else [(m.start(), at, out[1])]
                break
            lines.pop()
            while len(lines) > 1 and lines[-1][0] * 3 // 4 > out:
                lines.pop()


def _by_line(lines: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, str]]:
    """The text cut where its base64 lines end between two bytes and two characters; breaks between the lines go."""
    data, out, begin, done = text.encode(), [], lines[0][1], 0
    for i, (n, _, end) in enumerate(lines):
        to = n // 4 * 3
        if i + 1 == len(lines):
            out.append((begin, end, data[done:].decode()))
        elif n % 4 == 0 and (to >= len(data) or data[to] & 0xC0 != 0x80):
            out += [(begin, end, data[done:to].decode()), (end, lines[i + 1][1], "")]
            begin, done = lines[i + 1][1], to
    return out


#: What a layer must contain for a decoder to be tried, and the decoder.
DECODERS = ((PERCENT.search, _percent), (ESCAPE.search, _unicode), (BASE64.search, _base64))


@dataclass(frozen=True)
class Layer:
    """A text and where it comes from: from place ``at[i]`` on it is the outermost text from ``lo[i]`` on, character by
    character if ``hi[i]`` is None, else decoded from the stretch that ends at ``hi[i]``."""

    text: str
    at: tuple[int, ...] = (0,)
    lo: tuple[int, ...] = (0,)
    hi: tuple[int | None, ...] = (None,)

    def outer(self, s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, s) - 1, bisect_right(self.at, e - 1) - 1
        start = self.lo[i] + (s - self.at[i] if self.hi[i] is None else 0)
        return start, self.lo[j] + e - self.at[j] if self.hi[j] is None else self.hi[j]

    def replaced(self, stretches: list[tuple[int, int, str]]) -> Layer:
        """The layer with the stretches' decoding in their places."""
        text, at, lo, hi, size = [], [], [], [], 0

        def add(part: str, start: int, end: int | None) -> None:
            nonlocal size
            if part:
                text.append(part), at.append(size), lo.append(start), hi.append(end)
                size += len(part)

        place = 0
        for s, e, inner in [*stretches, (len(self.text), len(self.text), "")]:
            while place < s:  # what stands between is taken over piece by piece
                i = bisect_right(self.at, place) - 1
                to = min(s, self.at[i + 1]) if i + 1 < len(self.at) else s
                add(self.text[place:to], self.lo[i] + (place - self.at[i] if self.hi[i] is None else 0), self.hi[i])
                place = to
            if e > s:
                add(inner, *self.outer(s, e))
                place = e
        return Layer("".join(text), tuple(at), tuple(lo), tuple(hi)) if size else Layer("")


def _together(decoded: list[Decoded]) -> Iterator[Decoded]:
    """Stretches of one step that open together; new texts of up to ``MOST_BYTES`` in all, or of one stretch."""
    for name in sorted({step for step, _ in decoded}):
        own, size = [], 0
        for step, parts in decoded:
            if step == name:
                more = sum(len(t) for _, _, t in parts)
                if own and size + more > MOST_BYTES:
                    yield name, own
                    own, size = [], 0
                own.extend(parts)
                size += more
        yield name, own


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int, int]]]:
    """Finds in the text itself, and (start, kind, end, layers) of those in layers below, at their place in the text."""
    base, added, top = scan(text), set(), Layer(text)
    told = {(k, s, e, text[s:e]) for s, k, e in base}
    seen = {top}  # with their origin: a layer left out has its finds at the same places
    work = deque([(top, "", 0, frozenset())])  # a layer, the steps that led to it, its depth, the packed stretches opened on the way
    while work:
        layer, steps, depth, opened = work.popleft()
        for hint, decode in DECODERS:
            if not hint(layer.text):
                continue
            decoded = []
            for step, parts in decode(layer.text):
                place = layer.outer(parts[0][0], parts[-1][1])
                if step == "oversized":
                    added.add((place[0], step, place[1], depth + 1))
                elif step != "base64+zip" or (place, layer.text[parts[0][0] : parts[-1][1]]) not in opened:
                    decoded.append((step, parts))
            for step, parts in _together(decoded):
                inner = layer.replaced(parts)
                if inner in seen:
                    continue
                seen.add(inner)
                path = f"{steps}+{step}" if steps else step
                found = {(k, *inner.outer(s, e), inner.text[s:e]) for s, k, e in scan(inner.text)}
                for own in [p for n, p in decoded if n == step]:  # also alone: what stands before may end a find elsewhere
                    alone, (lo, hi) = "".join(t for _, _, t in own), layer.outer(own[0][0], own[-1][1])
                    for s, k, e in scan(alone):
                        if not any(x[0] == k and lo <= x[1] and x[2] <= hi and alone[s:e] in x[3] for x in found):
                            found.add((k, lo, hi, alone[s:e]))
                added.update((lo, f"{KINDS[k][0]}@{path}", hi, depth + 1) for k, lo, hi, _ in found - told)
                told |= found
                packed = {(layer.outer(s, e), layer.text[s:e]) for s, e, _ in parts} if step == "base64+zip" else ()
                work.append((inner, path, depth + 1, opened.union(packed)))
    return base, sorted(added)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layer", pa.int64())])
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            base, added = find(text or "")
            out.append(
                [{"kind": KINDS[k][0], "start": s, "end": e, "layer": 0} for s, k, e in base]
                + [{"kind": k, "start": s, "end": e, "layer": d} for s, k, e, d in added]
            )
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(entry))], names=["doc_id", "secrets"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets): array of (kind, start, end, layer), the text's own by start and kind, then those of inner layers."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, secrets array<struct<kind:string,start:long,end:long,layer:long>>")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the stated kinds, and all spans by start."""
    out = scan_documents(docs)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("secrets", lambda s: s["layer"] == 0)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    rank = F.transform(
        "secrets",
        lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), s["kind"]).alias("r"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    return out.select(
        "doc_id", *[count(k[0]).alias(f"n_{k[0]}") for k in KINDS], F.sha2(named(own), 256).alias("base_sha256"), named(F.sort_array(rank)).alias("spans")
    )


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text in batch.column("text").to_pylist():
            base, added = find(text) if text else ([], [])
            spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e, _ in added])
            out, at = [], 0
            for s, e in spans:
                if e > at:
                    out += [text[at : max(at, s)], "[SECRET]" if s >= at else ""]
                    at = e
            texts.append("".join([*out, text[at:]]) if out else text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every find, and every stretch that hides one, replaced by ``[SECRET]``."""
    return docs.mapInArrow(_mask, docs.schema)
