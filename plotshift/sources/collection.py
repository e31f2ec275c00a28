"""Features of GeoJSON feature collections, each file read by as many tasks as it has splits.

A collection is one JSON document, but it need not be one task. Spark's text source cuts a file into splits and, told that
records end with ``}``, hands each task whole records from any store that Spark reads. What a task cannot see is where it
stands in the document: whether its first byte is inside a string, and how deep in brackets. Two passes settle it.

1. Each split is summed up without knowing: the parity of its quotes, and for both answers to "does it begin inside a
   string" how far the depth moves, how many objects open at each relative depth in what was open before, and in each
   ``"features"`` array that opens in the split. One short row per split goes to the driver, which keeps a descriptor per
   split of any file scan anyway, and their running composition says where each split begins: inside a string or not, how
   deep, inside the features or not, behind how many of them.
2. Each split is read again and gives its features' texts: those that begin and end in it whole, and at most two pieces of
   features that it shares with its neighbours, which are put together by feature number.

A feature is an object that opens in the document's own ``"features"`` array, at depth two; foreign members are passed over.
No escape and no key of an array can stand across a ``}``, so no record cuts one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = re.compile(rb"\\.", re.S)
FEATURES = re.compile(rb'"features"\s*:\s*\[')
#: Bytes that are looked at together; a longer record is looked at whole.
BLOCK = 4 << 20
OUTER = 2


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(path, block, bytes) in the order of the file, about ``BLOCK`` bytes of one split each."""
    held, size, key = [], 0, None
    for batch in batches:
        for value, *at in zip(*[batch.column(c).to_pylist() for c in ("value", "path", "block")]):
            if held and (at != key or size > BLOCK):
                yield *key, "".join(held).encode()
                held, size = [], 0
            key = at
            held += (value, "}")
            size += len(value) + 1
    if held:
        yield *key, "".join(held).encode()


@dataclass
class Scan:
    """Of each byte of a block: ``odd`` quotes up to it, whether it opens or closes a bracket; and where features may begin."""

    data: bytes

    def __post_init__(self):
        plain = ESCAPE.sub(b"  ", self.data) if b"\\" in self.data else self.data
        self.buf = np.frombuffer(plain, np.uint8)
        self.odd = (np.cumsum(self.buf == 0x22) & 1).astype(bool)
        opens = (self.buf == 0x7B) | (self.buf == 0x5B)
        self.step = opens.astype(np.int8) - ((self.buf == 0x7D) | (self.buf == 0x5D)).astype(np.int8)
        self.arrays = np.array([m.end() - 1 for m in FEATURES.finditer(plain)], np.int64)

    def levels(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bracket moves and depth after each byte, and the places of objects' beginnings and features arrays."""
        move = np.where(self.odd ^ inside, 0, self.step)  # nothing moves inside strings
        return move, depth + np.cumsum(move), np.flatnonzero((self.buf == 0x7B) & (move > 0)), self.arrays[move[self.arrays] > 0]


class Summary:
    """What a split does to a state that it does not know, for a start outside (or inside) a string."""

    def __init__(self, inside: bool):
        self.inside, self.depth, self.least = inside, 0, 0
        self.opened: Counter = Counter()  # objects by relative depth that open in what was open before the split
        self.arrays: list[list] = []  # [depth, objects in it, whether it is closed] of each features array that opens here

    def add(self, scan: Scan) -> None:
        _, level, objects, arrays = scan.levels(self.inside, self.depth)
        least = np.minimum.accumulate(np.minimum(level, self.least))
        known = level[objects]
        self.opened.update(known[known - 1 <= least[objects]].tolist())
        new = [[int(level[at]), 0, False] for at in arrays]
        for array, begin in [*((x, 0) for x in self.arrays if not x[2]), *zip(new, arrays.tolist())]:
            below = np.flatnonzero(level[begin:] < array[0])
            end = begin + int(below[0]) if len(below) else len(level)
            array[1] += int(((known == array[0] + 1) & (objects > begin - (begin == 0)) & (objects < end)).sum())
            array[2] = bool(len(below))
        self.arrays += new
        self.inside ^= bool(scan.odd[-1])
        self.depth, self.least = int(level[-1]), int(least[-1])


SUMMARY = "depth: long, least: long, opened: map<int,long>, arrays: array<struct<depth: long, n: long, closed: boolean>>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its quotes' parity and both summaries."""
    key, odd, sums = None, False, []
    array = pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("closed", pa.bool_())]))
    kind = pa.struct([("depth", pa.int64()), ("least", pa.int64()), ("opened", pa.map_(pa.int32(), pa.int64())), ("arrays", array)])

    def row() -> pa.RecordBatch:
        both = [
            pa.array([{"depth": s.depth, "least": s.least, "opened": list(s.opened.items()), "arrays": [dict(zip(("depth", "n", "closed"), x)) for x in s.arrays]}], kind)
            for s in sums
        ]
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([odd]), *both], names=["path", "block", "odd", "outside", "inside"])

    for path, block, data in _blocks(batches):
        if (path, block) != key:
            if key:
                yield row()
            key, odd, sums = (path, block), False, [Summary(False), Summary(True)]
        scan = Scan(data)
        for s in sums:
            s.add(scan)
        odd ^= bool(scan.odd[-1])
    if key:
        yield row()


def starts(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[bool, int, bool, int]]:
    """Where each split begins: inside a string, at which depth, in the features, behind how many of its file."""
    schema = f"path string, block long, odd boolean, outside struct<{SUMMARY}>, inside struct<{SUMMARY}>"
    rows = _records(spark, path).mapInArrow(_summed, schema).collect()  # one short row per split
    out: dict[tuple[str, int], tuple[bool, int, bool, int]] = {}
    last = None
    for r in sorted(rows, key=lambda r: (r.path, r.block)):
        if r.path != last:
            last, inside, depth, listed, n = r.path, False, 0, False, 0
        out[r.path, r.block] = inside, depth, listed, n
        s = r.inside if inside else r.outside
        here = [x for x in s.arrays if x.depth == OUTER - depth]
        n += (s.opened.get(OUTER + 1 - depth, 0) if listed else 0) + sum(x.n for x in here)
        listed = (listed and depth + s.least >= OUTER) or any(not x.closed for x in here)
        depth += s.depth
        inside ^= r.odd
    return out


WHOLE, TAIL, MIDDLE, HEAD = range(4)


def _cut(states):
    """Texts of features and pieces of features, for splits that begin as ``states`` (a broadcast) says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending, held = None, [], None  # held: the kind of the unfinished piece, TAIL if it began here
        rows: list[tuple] = []

        def leave() -> None:
            if held is not None:
                rows.append((*key, number - 1, TAIL if held == TAIL else MIDDLE, b"".join(pending)))

        def table() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "block", "fid", "kind", "text"])
            rows.clear()
            return out

        for path, block, data in _blocks(batches):
            if (path, block) != key:
                leave()
                key, pending = (path, block), []
                inside, depth, listed, number = states.value[key]
                held = MIDDLE if listed and depth > OUTER else None
            scan = Scan(data)
            move, level, objects, arrays = scan.levels(inside, depth)
            # features begin between the opening of their array and the next closing of what is as deep
            turns = np.concatenate([arrays[level[arrays] == OUTER], np.flatnonzero((move < 0) & (level == OUTER - 1))])
            order = np.argsort(turns)
            kinds = np.append(np.arange(len(turns)) < (level[arrays] == OUTER).sum(), listed)[np.append(order, len(turns))]
            objects = objects[level[objects] == OUTER + 1]
            begin = objects[kinds[np.searchsorted(turns[order], objects) - 1]].tolist()
            end = np.flatnonzero((scan.buf == 0x7D) & (move < 0) & (level == OUTER))
            if held is not None:
                if len(end) and (not begin or end[0] < begin[0]):
                    pending.append(data[: end[0] + 1])
                    rows.append((*key, number - 1, WHOLE if held == TAIL else HEAD, b"".join(pending)))
                    held, pending = None, []
                elif begin:
                    held, pending = None, []
                else:
                    pending.append(data)
            nearest = np.searchsorted(end, begin)
            stops = end[nearest[nearest < len(end)]].tolist()
            for at, stop in zip(begin, stops):
                rows.append((*key, number, WHOLE, data[at : stop + 1]))
                number += 1
            if len(begin) > len(stops):
                held, pending = TAIL, [data[begin[-1] :]]
                number += 1
            inside, depth, listed = inside ^ bool(scan.odd[-1]), int(level[-1]), bool(kinds[-2 if len(turns) else -1])
            yield table()
        leave()
        yield table()

    return run


def features(spark: SparkSession, path: str) -> DataFrame:
    """(path, fid, text): every feature of the collections under ``path`` with its position in its file."""
    states = spark.sparkContext.broadcast(starts(spark, path))
    pieces = _records(spark, path).mapInArrow(_cut(states), "path string, block long, fid long, kind int, text string")
    whole = pieces.where(F.col("kind") == WHOLE).select("path", "fid", "text")
    shared = pieces.where(F.col("kind") != WHOLE).groupBy("path", "fid").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p")
    )
    shared = shared.where(F.exists("p", lambda p: p["kind"] == TAIL) & F.exists("p", lambda p: p["kind"] == HEAD))
    return whole.union(shared.select("path", "fid", F.array_join(F.col("p.text"), "")))
