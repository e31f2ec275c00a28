"""Benchmark decontamination with a distributed positional inverted index.

1. Index. Documents are gathered into segments of a few megabytes; for every term that a benchmark item can contain, a row
   (segment, term) stores its positions, and one row per segment stores where its documents begin. Which terms items can
   contain is asked of a bitmap of fixed size; the bitmap only spares postings that no item could use. The index is a
   Parquet table in the shared folder, since counting terms and looking them up both read it.
2. Rarest first. Every item window's terms are counted over the whole index; absent terms count as none. A proximity match
   may miss m = size - ceil(NEAR_SHARE * size) terms, so it holds one of the m + 1 rarest. By a join on these the window meets
   only segments that hold one; there their positions, less the place in the window and up to ``SLOP`` off, are the possible starts.
3. Intersect. The lists of all terms, by rising count and less their places, are intersected with the starts until none is
   left that misses at most m: starts with every term in place are exact phrases, starts of a document where at least
   ``NEAR_SHARE`` of the terms stand within ``SLOP`` places of where they should are proximity matches. ``find`` returns both; only
   exact ones contaminate.

Segments, not terms, are the groups that meet in one task, so a frequent term, passage or source spreads like the text does.

Defined cases: null texts have no words; an item under ten words is one window of all its words, an item without words none;
items with a null id hit words but are not listed or counted; documents are told apart by row, so repeated ids stay rows of
their own; empty tables give no rows (or rows without hits); extra columns stay with ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.llm.blobs import runs
from plotshift.llm.frames import numbered
from plotshift.llm.text import ALNUM, U, slices, split_words
from plotshift.session import materialize

SIZE = 10
SLOP = 2
NEAR_SHARE = 0.8
#: Bits of the bitmap of item terms: 128 KiB, whatever the number of terms.
BITS = 20
#: Possible starts that a segment's task holds at a time.
STARTS = 1 << 19


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of every item as (item_id, terms)."""
    for batch, texts in slices(batches):
        words = split_words(texts, ALNUM, True)
        hashes = words.hashes().view(np.int64)
        items, terms = [], []
        for i, item in enumerate(batch.column("item").to_pylist()):
            own = hashes[words.first[i] : words.first[i + 1]].tolist()
            for lo in range(max(1, len(own) - SIZE + 1) if own else 0):
                items.append(item)
                terms.append(own[lo : lo + SIZE])
        yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.string()), "terms": pa.array(terms, pa.list_(pa.int64()))})


def item_windows(items: DataFrame) -> DataFrame:
    """(window, item, terms): each item's windows of ten consecutive words, or all its words if it has fewer."""
    out = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_item_windows, "item string, terms array<long>")
    return out.withColumn("window", F.xxhash64("terms"))


def _bitmap(windows: DataFrame) -> np.ndarray:
    places = windows.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", 64 - BITS).alias("b")).distinct()
    bits = np.zeros(1 << BITS, bool)
    bits[[r.b for r in places.collect()]] = True  # at most 2^BITS small numbers
    return np.packbits(bits)


def _postings(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        bits = np.unpackbits(bitmap).view(bool)
        for batch, texts in slices(batches):
            words = split_words(texts, ALNUM, True)
            hashes = words.hashes()
            at = np.flatnonzero(bits[hashes >> U(64 - BITS)])
            order = np.argsort(hashes[at], kind="stable")
            terms, at = hashes[at][order].view(np.int64), at[order].astype(np.int32)
            starts, sizes = runs(terms)
            steps = np.diff(at, prepend=np.int32(0))  # gaps between a term's positions: small numbers compress
            steps[starts] = at[starts]
            rows = [steps[lo : lo + n].tobytes() for lo, n in zip(starts.tolist(), sizes.tolist())]
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(np.full(len(rows) + 1, segment, np.int64)),
                    "term": pa.array([None, *terms[starts].tolist()], pa.int64()),
                    "n": pa.array([len(words.starts), *sizes.tolist()], pa.int64()),
                    "places": pa.array([words.first.astype(np.int32).tobytes(), *rows], pa.binary()),
                    "ids": pa.array([ids, *[None] * len(rows)], pa.list_(pa.int64())),
                }
            )
            segment += 1

    return run


INDEX = "segment long, term long, n long, places binary, ids array<long>"


def build_index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The stored index: postings of item terms per segment, and per segment a row (term null) with its documents."""
    body = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return materialize(body.mapInArrow(_postings(_bitmap(windows)), INDEX), "postings")


def _matches(asked: pa.Table, lists: dict[int, np.ndarray], first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Proximity matches of the asked windows as (window row, document, start, size, exact), about ``STARTS`` possible starts at a time."""
    terms, columns = asked.column("terms").combine_chunks(), asked.column("offsets").combine_chunks()
    edges, offset = terms.offsets.to_numpy().astype(np.int64), columns.values.to_numpy().astype(np.int64)
    number = {t: i for i, t in enumerate(lists)}
    term = np.array([number.get(t, -1) for t in terms.values.to_pylist()], np.int64)
    held = np.array([len(x) for x in lists.values()], np.int64)
    before = np.cumsum(held) - held
    places = np.concatenate(list(lists.values()))
    keys = (np.repeat(np.arange(len(held)), held) << 40) + places  # one sorted list of all terms' places
    edges, size = edges[:-1], np.diff(edges)
    most = np.array([n - math.ceil(NEAR_SHARE * n) for n in range(int(size.max()) + 1)])[size]
    row = np.repeat(np.arange(len(size)), size)
    possible = np.bincount(row[term < 0], minlength=len(size)) <= most
    anchor = np.flatnonzero(possible[row] & (term >= 0) & (np.arange(len(row)) - edges[row] <= most[row]))
    work = np.bincount(row[anchor], held[term[anchor]], len(size))
    part = (np.cumsum(work) * (2 * SLOP + 1) // STARTS)[row[anchor]]
    for lo, n in zip(*runs(part)):
        own = anchor[lo : lo + n]
        count = held[term[own]]
        at = places[np.repeat(before[term[own]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        doc = np.repeat(np.searchsorted(first, at, "right") - 1, 2 * SLOP + 1)
        start = ((at - np.repeat(offset[own], count))[:, None] + np.arange(-SLOP, SLOP + 1)).ravel()
        w = np.repeat(np.repeat(row[own], count), 2 * SLOP + 1)
        order = np.lexsort((start, doc, w))
        w, doc, start = w[order], doc[order], start[order]
        left = np.ones(len(w), bool)
        left[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
        w, doc, start = w[left], doc[left], start[left]
        begin, end = first[doc], first[doc + 1]
        whole = (start >= begin) & (start + size[w] <= end)
        missed = np.zeros(len(w), np.int64)
        for place in range(int(size.max())):
            has = place < size[w]
            j = np.minimum(edges[w] + place, len(term) - 1)
            absent, base, want = term[j] < 0, np.maximum(term[j], 0) << 40, start + offset[j]
            got = keys[np.minimum(np.searchsorted(keys, base + np.maximum(want - SLOP, begin)), len(keys) - 1)]
            fits = ~absent & (got >= base + np.maximum(want - SLOP, begin)) & (got <= base + np.minimum(want + SLOP, end - 1))
            missed += has & ~fits
            in_place = ~absent & (keys[np.minimum(np.searchsorted(keys, base + want), len(keys) - 1)] == base + want)
            whole &= in_place | ~has
            left = missed <= most[w]  # what is no proximity match is no exact one either
            w, doc, start, begin, end, whole, missed = (x[left] for x in (w, doc, start, begin, end, whole, missed))
            if not len(w):
                break
        yield w, doc, start, size[w], whole


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Of one segment: per document its words, hit words, and the windows that match exactly and nearly."""
    lists, first, ids = {}, np.zeros(1, np.int64), []
    for term, places, own in zip(index.column("term").to_pylist(), index.column("places").to_pylist(), index.column("ids").to_pylist()):
        if term is None:
            first, ids = np.frombuffer(places, np.int32).astype(np.int64), own
        else:
            lists[term] = np.cumsum(np.frombuffer(places, np.int32), dtype=np.int64)
    cover = np.zeros(int(first[-1]) + 1, np.int32)
    exact: list[set[int]] = [set() for _ in ids]
    near: list[set[int]] = [set() for _ in ids]
    windows = asked.column("window").to_pylist()
    for w, doc, start, size, whole in _matches(asked, lists, first) if windows and lists else ():
        for found, at in ((near, slice(None)), (exact, whole)):
            for x, d in set(zip(w[at].tolist(), doc[at].tolist())):
                found[d].add(windows[x])
        np.add.at(cover, start[whole], 1)
        np.add.at(cover, (start + size)[whole], -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    segment = index.column("segment")[0].as_py()
    return pa.table(
        {
            "segment": pa.array([segment] * len(ids), pa.int64()),
            "place": pa.array(range(len(ids)), pa.int64()),
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_hit": pa.array(hit[first[1:]] - hit[first[:-1]], pa.int64()),
            "windows": pa.array([sorted(x) for x in exact], pa.list_(pa.int64())),
            "near": pa.array([sorted(n - x) for n, x in zip(near, exact)], pa.list_(pa.int64())),
        }
    )


FOUND = "segment long, place long, doc_id long, n_words long, n_hit long, windows array<long>, near array<long>"


def look_up(index: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document with its matches of the item windows."""
    distinct = windows.dropDuplicates(["window"]).select("window", "terms")
    counts = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("count"))
    terms = distinct.select("window", F.size("terms").alias("size"), F.posexplode("terms").alias("pos", "t"))
    known = terms.join(counts, terms.t == counts.term, "left").select("window", "size", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "pos", "t").alias("p"))
    plans = known.groupBy("window", "size").agg(F.sort_array(F.collect_list("p")).alias("plan"))
    most = F.col("size") - F.ceil(F.col("size") * NEAR_SHARE).cast("int")
    rarest = plans.select("window", F.explode(F.slice("plan", F.lit(1), most + 1)).alias("p")).where("p.count > 0").select("window", F.col("p.t").alias("term"))
    places = index.where("term is not null").select(F.col("segment").alias("at"), "term")
    met = rarest.join(places, "term").select("at", "window").distinct()
    asked = met.join(plans, "window").select("at", "window", F.col("plan.t").alias("terms"), F.col("plan.pos").alias("offsets"))
    return asked.groupBy("at").cogroup(index.groupBy("segment")).applyInArrow(_look_up, FOUND)


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document row: ``n_words``, ``n_hit``, ``items`` and ``near_items`` (sorted ids of items with an exact match, and with a
    window that only matches nearly), and ``n_near``, the number of such windows."""
    windows = materialize(item_windows(items), "windows")
    found = materialize(look_up(build_index(docs, windows), windows), "found")
    both = F.array(F.struct(F.lit(True).alias("exact"), F.col("windows").alias("w")), F.struct(F.lit(False).alias("exact"), F.col("near").alias("w")))
    pairs = found.select("segment", "place", F.explode(both).alias("m")).select("segment", "place", "m.exact", F.explode("m.w").alias("window"))
    pairs = pairs.join(windows.select("window", "item"), "window")
    names = [F.sort_array(F.collect_set(F.when(F.col("exact") == flag, F.col("item")))).alias(name) for flag, name in ((True, "items"), (False, "near_items"))]
    out = found.join(pairs.groupBy("segment", "place").agg(*names), ["segment", "place"], "left")
    listed = [F.coalesce(name, F.array().cast("array<string>")).alias(name) for name in ("items", "near_items")]
    return out.select("doc_id", "n_words", "n_hit", *listed, F.size("near").cast("long").alias("n_near"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: hit words, matched items and the verdict."""
    return find(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an exact match, with the columns they came with. Rows are told apart by a stored number, not by id."""
    rows = numbered(docs)
    hit = find(rows.select(F.col("number").alias("doc_id"), "row.text"), items).where("n_hit > 0").select(F.col("doc_id").alias("number"))
    return rows.join(hit, "number", "left_anti").select("row.*")
