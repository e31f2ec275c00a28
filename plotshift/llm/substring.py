"""Repeated passages: fixed blocks as anchors, probed by every rolling window, hits extended to maximal repeats.

1. Index and probe. Every document's words are cut into non-overlapping blocks of 25; their hashes are the index. Every
   rolling window of 25 words of every document probes it. Both go to buckets by hash. A run of 50 words that two
   documents share contains a whole block of either, which the other one probes, so nothing is missed.
2. Extend. A hit is extended to the runs of 50 words around it. Those runs' 96-bit hashes meet in buckets again; there the
   smallest document id of each run is known, and every later document learns which of its runs stand in an earlier one.
   The union of a document's confirmed runs is the union of its maximal repeats of at least 50 words.
3. Remove. Words covered by a confirmed run go; judged on the input, not on what is left.

No pair of documents is ever formed: a passage shared by a third of the table costs one record per document and run.
Every step is a scan, a shuffle of packed records (``blobs``) or a join on the id, so lost executors cost their tasks.
Records are filtered by a 32-bit value and the bucket first (a false hit only adds runs to step 2), and by 96 bits last.

Defined cases: a null text has no words, a text under 50 words repeats nothing; a null id counts as larger than all
others, so its repeats go; rows with the same id never remove from each other; extra columns stay with ``remove``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.llm import blobs
from plotshift.llm.text import NOT_SPACE, U, Words, mix, slices, split_words, windows

LAST = (1 << 63) - 1
PACKED = "bucket long, keys binary, counts binary"


def _owners(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


def _probes(block: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch, texts in slices(batches):
            words = split_words(texts, NOT_SPACE, False)
            value, at = windows(words.hashes(), words.first, block, salt=3)
            doc = _owners(words.first, at)
            keys = batch.column("k").to_numpy(zero_copy_only=False)[doc]
            aligned = (at - words.first[doc]) % block == 0
            short = (value >> U(32)).astype(np.uint32)
            out = blobs.deal(value % U(n), keys, probe=short, anchor=aligned)
            if out is not None:
                yield out

    return run


def _answer(f: Callable[[pa.Table], pa.Table]):
    def answer(table: pa.Table) -> pa.Table:
        return f(table)

    return answer


def _routed(n: int, keys: np.ndarray, found: np.ndarray) -> pa.Table:
    """What one bucket found, packed by groups of documents: a row per document and bucket would be as many as both allow."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    out = blobs.deal(mix(keys.view(np.uint64), 50) % U(n), keys, found=found[order])
    empty = {"bucket": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("keys", "counts", "found")}}
    return pa.Table.from_batches([out]) if out is not None else pa.table(empty)


def _by_document(kind: type):
    def gather(table: pa.Table) -> pa.Table:
        keys, found = blobs.record_keys(table), blobs.joined(table, "found", kind)
        order = np.argsort(keys, kind="stable")
        return blobs.by_key(keys[order], found[order])

    return gather


def _shared_blocks(n: int):
    return lambda table: _routed(n, *_shared(table))


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: the probes that are some document's block and that two documents hold, with their documents."""
    keys, probe = blobs.record_keys(table), blobs.joined(table, "probe", np.uint32)
    index = np.unique(probe[blobs.joined(table, "anchor", bool)])
    hit = np.flatnonzero(index[np.minimum(np.searchsorted(index, probe), len(index) - 1)] == probe) if len(index) else []
    keys, probe = keys[hit], probe[hit]
    order = np.lexsort((keys, probe))
    keys, probe = keys[order], probe[order]
    starts, sizes = blobs.runs(probe)
    several = np.repeat(keys[starts] != keys[starts + sizes - 1], sizes) if len(starts) else np.empty(0, bool)
    return keys[several], probe[several]


def _member(first: np.ndarray, at: np.ndarray, values: np.ndarray, found: list[bytes], kind: type) -> np.ndarray:
    """Places in ``at`` whose value is among those found for their document."""
    out = []
    edges = np.searchsorted(at, first)
    for i, blob in enumerate(found):
        if blob:
            lo, hi = edges[i], edges[i + 1]
            out.append(lo + np.flatnonzero(np.isin(values[lo:hi], np.frombuffer(blob, kind))))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _run_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    return windows(words.hashes(), words.first, size, salt=5)


def _candidates(block: int, size: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch, texts in slices(batches):
            words = split_words(texts, NOT_SPACE, False)
            hashes = words.hashes()
            value, at = windows(hashes, words.first, block, salt=3)
            hits = at[_member(words.first, at, (value >> U(32)).astype(np.uint32), batch.column("found").to_pylist(), np.uint32)]
            value, at = windows(hashes, words.first, size, salt=5)
            other, _ = windows(hashes, words.first, size, salt=6)
            reach = np.zeros(len(hashes) + 1, np.int32)  # runs that hold the hit's block start this far before it
            np.add.at(reach, np.maximum(hits - (size - block), 0), 1)
            np.add.at(reach, hits + 1, -1)
            keep = np.cumsum(reach)[at] > 0
            value, other, at = value[keep], other[keep], at[keep]
            keys = batch.column("k").to_numpy(zero_copy_only=False)[_owners(words.first, at)]
            out = blobs.deal(value % U(n), keys, run=value, more=(other >> U(32)).astype(np.uint32))
            if out is not None:
                yield out

    return run


def _later_runs(n: int):
    return lambda table: _routed(n, *_later(table))


def _later(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: the runs that a document with a smaller key holds as well, with their documents."""
    keys, run = blobs.record_keys(table), blobs.joined(table, "run", np.uint64)
    more = blobs.joined(table, "more", np.uint32)
    order = np.lexsort((keys, more, run))
    keys, run, more = keys[order], run[order], more[order]
    same = (run[1:] == run[:-1]) & (more[1:] == more[:-1]) if len(run) else np.empty(0, bool)
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(run) else np.empty(0, np.int64)
    least = np.repeat(keys[starts], np.diff(np.append(starts, len(run))))
    later = keys > least
    return keys[later], run[later]


def _cut(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch, texts in slices(batches):
            found = batch.column("found").to_pylist()
            some = [i for i, blob in enumerate(found) if blob]
            lists = [t.split() for t in texts]
            kept = [b" ".join(x) for x in lists]
            removed: list[list[tuple[int, int]]] = [[] for _ in texts]
            gone = [0] * len(texts)
            if some:
                words = split_words([texts[i] for i in some], NOT_SPACE, False)
                value, at = _run_hashes(words, size)
                hits = at[_member(words.first, at, value, [found[i] for i in some], np.uint64)]
                cover = np.zeros(int(words.first[-1]) + 1, np.int32)
                np.add.at(cover, hits, 1)
                np.add.at(cover, hits + size, -1)
                cover = np.cumsum(cover)[:-1] > 0
                for j, i in enumerate(some):
                    mask = cover[words.first[j] : words.first[j + 1]]
                    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
                    removed[i] = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                    gone[i] = int(mask.sum())
                    kept[i] = b" ".join(w for w, m in zip(lists[i], mask.tolist()) if not m)
            spans = pa.array(
                [[{"start": s, "end": e} for s, e in x] for x in removed],
                pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
            )
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array([len(x) for x in lists], pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "removed": spans,
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    return run


def remove(docs: DataFrame, size: int = 50) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, ``removed`` (word spans, end exclusive) and ``kept_text``."""
    block = size // 2
    body = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"))
    n = blobs.buckets(docs)
    probes = body.select("k", "text").mapInArrow(_probes(block, n), f"{PACKED}, probe binary, anchor binary")
    shared = probes.groupBy("bucket").applyInArrow(_answer(_shared_blocks(n)), f"{PACKED}, found binary")
    hits = shared.groupBy("bucket").applyInArrow(_answer(_by_document(np.uint32)), "k long, found binary")
    texts = body.select("k", "doc_id", "text")
    runs = texts.join(hits, "k").mapInArrow(_candidates(block, size, n), f"{PACKED}, run binary, more binary")
    later = runs.groupBy("bucket").applyInArrow(_answer(_later_runs(n)), f"{PACKED}, found binary")
    confirmed = later.groupBy("bucket").applyInArrow(_answer(_by_document(np.uint64)), "k long, found binary")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"
    return texts.join(confirmed, "k", "left").mapInArrow(_cut(size), schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: words, removed words, and a digest of the text that is left."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
