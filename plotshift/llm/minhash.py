"""Near-duplicates by bottom-k sketches: one hash function, inverted lists of retained values, exact Jaccard at the end.

1. Sketch. A text's set holds its distinct word shingles; the sketch is the ``K`` smallest of their hashes. Texts with
   equal sets form one class, and only its smallest id goes on, so exact copies cost one row each.
2. Inverted lists. Two sets with a Jaccard of ``threshold`` share at least ``required`` retained values (all but one pair
   in 10^9 for cut sketches, every pair for whole ones). Ordered from the rarest value on, two such sketches therefore
   meet within all but their ``required - 1`` most frequent values; only those enter the lists.
3. Candidates. A list's members are first compared with one pivot only; what links becomes one component. Rounds go on
   while lists hold many members of different components; then the members of different components that are left are
   compared with each other, each pair in the first list that both are in. Members of one component never are, so a group
   of thousands of near copies costs a row per member and list, not one per pair, and no pair that could join two
   components is left out.
4. Filter and verify. The union sketch estimates the Jaccard from the upper 32 bits of the values; a chance equality can only raise
   it (a sketch with one in itself is not filtered). Candidates below what chance allows go. The rest is counted exactly on the full sets of the texts.

Values are counted in packed buckets. What more than ``DENSE`` sketches of one batch hold is counted there, and only its count goes
to a bucket; its holders travel as rows, so no bucket gathers a frequent value. Stored tables go once their last reader is stored.

Defined cases: null, empty and word-free texts have an empty set and stay alone; a text with fewer words than a shingle is
one shingle; rows with null or repeated ids are documents of their own, null ids standing behind all others; very long texts are
taken whole; an empty table gives an empty result; extra columns stay with ``first_of_groups``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotshift.llm.blobs import buckets, deal, joined, record_keys, runs
from plotshift.llm.frames import numbered
from plotshift.llm.graph import components, contracted, smallest_seen
from plotshift.llm.text import LOWER, NOT_SPACE, slices, split_words, windows
from plotshift.session import materialize, materialize_at, remove

#: Sets of up to 0.8 K shingles are compared as wholes: their lists hold only the rarest fifth of their values, so that a passage
#: in many texts, which is more frequent than their own words, makes no list.
K = 256
MISS = 1e-9
#: Members of a list whose pairs are joined as rows; longer lists are compared inside tasks, in pairs of blocks of about BLOCK members.
FEW = 24
BLOCK = 1024
#: Holders of a value in one batch of sketches up to which they are sent to the value's bucket.
DENSE = 8
#: Holders of a value in a block up to which their pairs are listed; more frequent ones are multiplied as a matrix.
PAIRED = 16
LAST = (1 << 63) - 1


def required(k: int, threshold: float, miss: float = MISS) -> int:
    """The most values that all but ``miss`` of pairs at the threshold share in sketches of k (a binomial's lower tail)."""
    total, m = 0.0, 0
    while True:
        total += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        if total > miss:
            return m
        m += 1


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words = split_words(texts, NOT_SPACE, True)
            hashes = words.hashes()
            value, at = windows(hashes, words.first, size, salt=7)
            edges = np.searchsorted(at, words.first)
            sets, counts, keys = [], [], []
            for i in range(len(texts)):
                lo, hi = words.first[i], words.first[i + 1]
                if hi - lo >= size:
                    own = np.unique(value[edges[i] : edges[i + 1]].view(np.int64))  # signed, the order of Spark's longs
                else:  # the words of a shorter text are one shingle
                    own = windows(hashes[lo:hi], np.array([0, hi - lo]), int(hi - lo), salt=8)[0].view(np.int64) if hi > lo else hashes[:0].view(np.int64)
                sets.append(own[:k])
                counts.append(len(own))
                keys.append(_digest(own))
            yield pa.RecordBatch.from_pydict(
                {
                    "k": batch.column("k"),
                    "key": pa.array(keys, pa.binary()),
                    "n": pa.array(counts, pa.int64()),
                    "sketch": pa.array(sets, pa.list_(pa.int64())),
                }
            )

    return run


def _digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes(), usedforsecurity=False).digest()


def _shingles(text: bytes, size: int) -> frozenset:
    words = text.translate(LOWER.tobytes()).split()
    return frozenset(zip(*[words[i:] for i in range(size)])) if len(words) >= size else frozenset([tuple(words)] if words else [])


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, last, own = [], [], None, frozenset()
            ta, tb = batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                if x != last:
                    last, own = x, _shingles(ta[i].as_py(), size)
                other = _shingles(tb[i].as_py(), size)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _comparable(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _alike(a: Column, b: Column, k: int, percent: int, share: int) -> Column:
    """Sketches of less than k values are whole sets and decide; else the union's k smallest values must hold ``share`` common ones."""
    both, union = F.size(F.array_intersect(a, b)), F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    exact = 100 * both >= percent * (F.size(a) + F.size(b) - both)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) < k) & (F.size(b) < k), exact).otherwise(F.array_size(F.array_intersect(union, F.array_intersect(a, b))) >= share)


def _paired(column: np.ndarray, seen: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The counts of ``_common`` for values of 2 to ``PAIRED`` rows: each value's pairs are counted."""
    out = np.zeros(len(left) * len(right), np.float32)
    at = [np.full(n, -1) for _ in range(2)]
    at[0][left], at[1][right] = np.arange(len(left)), np.arange(len(right))
    used = np.flatnonzero((seen[column] > 1) & (seen[column] <= PAIRED))
    used = used[np.argsort(column[used], kind="stable")]
    row, column = row[used], column[used]
    for step in range(1, PAIRED):
        first = np.flatnonzero(column[step:] == column[:-step])
        if not len(first):
            break
        for x, y in ((first, first + step), (first + step, first)):
            x, y = at[0][row[x]], at[1][row[y]]
            both = (x >= 0) & (y >= 0)
            np.add.at(out, x[both] * len(right) + y[both], 1)
    return out.reshape(len(left), len(right))


def _common(values: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, step: int = 2048) -> np.ndarray:
    """How many values row x of ``left`` and row y of ``right`` both hold; values of one row only are left out, the rest come ``step`` at a time."""
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    out = _paired(column, seen, row, n, left, right)
    place = np.cumsum(seen > PAIRED) - 1
    used = np.flatnonzero(seen[column] > PAIRED)
    used = used[np.argsort(place[column[used]], kind="stable")]
    row, column = row[used], place[column[used]]
    wide = int((seen > PAIRED).sum())
    for lo in range(0, wide, step):
        own = slice(*np.searchsorted(column, [lo, lo + step]))
        part = np.zeros((n, min(step, wide - lo)), np.float32)
        part[row[own], column[own] - lo] = 1
        out += part[left] @ part[right].T
    return out


def _held_by_both(p: np.ndarray, q: np.ndarray, k: int) -> int:
    """How many of the ``k`` smallest values of two sorted sets' union are in both."""
    u = np.sort(np.concatenate((p, q)))
    twice = np.concatenate(([0], np.cumsum(u[1:] == u[:-1])))
    return int(twice[np.searchsorted(np.arange(1, len(u) + 1) - twice, k, "right") - 1])


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A list column as one array, its flat values, and the row of each."""
    lists = column.combine_chunks()
    return lists, lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())


def _block(k: int, percent: int, share: int):
    """Candidates among the members of one block pair (i, j) of a list: those of different components that ``_alike`` lets pass.

    Members that both are in one of each other's ``earlier`` lists meet there, so a pair comes out of one list only.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key[1:])
        ids, comp, salt = (t.column(c).to_numpy() for c in ("k", "comp", "salt"))
        left, right = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
        open_ = comp[left][:, None] != comp[right][None, :]
        if i == j:
            open_ &= ids[left][:, None] < ids[right][None, :]
        if "earlier" in t.column_names:
            _, lists, row = _lists(t.column("earlier"))
            open_ &= _common(lists, row, len(ids), left, right) == 0
        at, to = open_.any(axis=1), open_.any(axis=0)
        left, right, open_ = left[at], right[to], open_[at][:, to]
        sketches, values, row = _lists(t.column("sketch"))
        size = np.bincount(row, minlength=len(ids))
        bare = sketches.is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        own = lambda x: values[ends[x] - size[x] : ends[x]]
        asked = np.isin(row, np.concatenate((left, right)))
        common = _common(values[asked], row[asked], len(ids), left, right)
        total = size[left][:, None] + size[right][None, :]
        whole = (size[left] < k)[:, None] & (size[right] < k)[None, :]
        passed = np.where(whole, 100 * common >= percent * (total - common), common >= share)
        unfiltered = bare[left][:, None] | bare[right][None, :]
        passed |= unfiltered
        passed &= open_
        x, y = np.nonzero(passed)
        cut = ~whole[x, y] & ~unfiltered[x, y]
        x, y = left[x], right[y]
        keep = np.ones(len(x), bool)
        for at in np.flatnonzero(cut):
            keep[at] = _held_by_both(own(x[at]), own(y[at]), k) >= share
        x, y = ids[x[keep]], ids[y[keep]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _sorted_values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a batch of sketches in their order, the sketch that holds each, and whether more than ``DENSE`` do."""
    sketches = batch.column("sketch")
    values = sketches.flatten().to_numpy()
    holder = np.repeat(batch.column("k").to_numpy(), sketches.value_lengths().to_numpy())
    order = np.argsort(values, kind="stable")
    values = values[order]
    _, counts = runs(values)
    return values, holder[order], np.repeat(counts > DENSE, counts)


PACKED = "bucket long, keys binary, counts binary, values binary, totals binary"


def _packed(n: int):
    """Per bucket of values a row with the holders of the rarer ones, and a row with the totals of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, holder, often = _sorted_values(batch)
            few, who = values[~often], holder[~often]
            order = np.argsort(who, kind="stable")
            few, who = few[order], who[order]
            starts, totals = runs(values[often])
            many = values[often][starts]
            ones = deal(few.view(np.uint64) % np.uint64(n), who, values=few)
            if ones is not None:
                yield pa.RecordBatch.from_pydict({**dict(zip(ones.schema.names, ones.columns)), "totals": pa.nulls(len(ones), pa.binary())})
            sums = deal(many.view(np.uint64) % np.uint64(n), np.zeros(len(many), np.int64), values=many, totals=totals.astype(np.int64))
            if sums is not None:
                yield sums

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The holders that ``_packed`` leaves out, as rows."""
    for batch in batches:
        values, holder, often = _sorted_values(batch)
        yield pa.RecordBatch.from_pydict({"k": pa.array(holder[often], pa.int64()), "v": pa.array(values[often], pa.int64())})


def _counted(table: pa.Table) -> pa.Table:
    """Of one bucket: (k, v, count) for values of several sketches; without k for values whose holders are rows of their own."""
    values, holder = joined(table, "values", np.int64), record_keys(table)
    totals = [np.ones(len(v) // 8, np.int64) if t is None else np.frombuffer(t, np.int64) for v, t in zip(table.column("values").to_pylist(), table.column("totals").to_pylist())]
    total = np.concatenate(totals)
    summed = np.concatenate([np.full(len(t), x is not None) for t, x in zip(totals, table.column("totals").to_pylist())])
    _, which = np.unique(values, return_inverse=True)
    count = np.bincount(which, total).astype(np.int64)[which]
    rows = np.flatnonzero(~summed & (count > 1))
    _, apart = np.unique(values[summed], return_index=True)
    apart = np.flatnonzero(summed)[apart]
    k = pa.array(np.concatenate([holder[rows], holder[apart]]), pa.int64(), mask=np.arange(len(rows) + len(apart)) >= len(rows))
    at = np.concatenate([rows, apart])
    return pa.table({"k": k, "v": pa.array(values[at], pa.int64()), "count": pa.array(count[at], pa.int64())})


def value_counts(sketches: DataFrame, n: int) -> DataFrame:
    """(k, v, count): the values of each sketch that others hold too, with the number of sketches that hold them."""
    body = sketches.select("k", "sketch")
    counted = body.mapInArrow(_packed(n), PACKED).groupBy("bucket").applyInArrow(_counted, "k long, v long, count long")
    totals = counted.where("k is null").select("v", "count")
    return counted.where("k is not null").union(body.mapInArrow(_frequent, "k long, v long").join(totals, "v").select("k", "v", "count"))


def groups(docs: DataFrame, size: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(k, n, comp): one row per document with its key, its set's size and the smallest key of its component."""
    spark = docs.sparkSession
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), F.col("text"))
    sketches, path = materialize_at(body.mapInArrow(_sketches(size, k), "k long, key binary, n long, sketch array<long>"), "sketches")
    share = required(k, percent / 100)

    # texts with one key have one set, so any of their sketches is the class's
    alike = sketches.where("n > 0").groupBy("key").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps, whole_reps = materialize_at(alike, "classes")
    classes = reps.select("key", F.col("k").alias("rep"))
    members = sketches.select("k", "key", "n").join(classes, "key", "left").select("k", "n", F.coalesce("rep", "k").alias("rep"))
    members = materialize(members, "members")
    remove(spark, path)

    need = F.when(100 * F.col("n") < percent * k, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(share))
    held = value_counts(reps, buckets(body)).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("count", "v"))).alias("held"))  # at most k
    first = F.slice("held", 1, F.greatest(F.size("held") - need + 1, F.lit(0)).cast("int"))
    listed = held.join(reps.select("k", "n"), "k").select("k", "n", F.explode(first).alias("e"))
    lists = materialize(listed.select("e.v", "k", "n"), "lists")

    wanted = lists.select("k").distinct()
    upper = reps.join(wanted, "k", "left_semi").select("k", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("sketch"))
    upper = upper.select("k", F.when(F.size(F.array_distinct("sketch")) == F.size("sketch"), F.col("sketch")).alias("sketch"))
    small, small_path = materialize_at(upper, "small")
    remove(spark, whole_reps)
    texts, texts_path = materialize_at(body.join(wanted, "k", "left_semi").select("k", F.coalesce("text", F.lit("")).alias("text")), "texts")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(small.toDF("a", "sa"), "a").join(small.toDF("b", "sb"), "b")
        return both.where(F.coalesce(_alike(F.col("sa"), F.col("sb"), k, percent, share), F.lit(True))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        whole = pairs.distinct().join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return materialize(whole.mapInArrow(_verify(size, percent), "a long, b long"), "links")

    left = lists.withColumn("comp", F.col("k"))
    edges, before = None, math.inf
    while True:
        pivots = left.groupBy("v").agg(F.min(F.struct("k", "n", "comp")).alias("p"))
        held = left.join(pivots, "v").where(F.col("k") != F.col("p.k"))
        star = held.where(F.col("comp") != F.col("p.comp")).where(_comparable(F.col("n"), F.col("p.n"), percent))
        found = verified(near(star.select(F.col("p.k").alias("a"), F.col("k").alias("b")).distinct()))
        edges = contracted(found if edges is None else edges.union(found))
        held = held.select("v", "k", "n").join(smallest_seen(edges).toDF("k", "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        sizes = held.groupBy("v", "comp").count().groupBy("v").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"))
        mixed = sizes.where("m * m > own").select("v", "m", ((F.col("m") * F.col("m") - F.col("own")) / (2 * F.col("m"))).alias("share"))
        left = materialize(held.join(mixed, "v"), "left")  # share: pairs of different components in the list, per member
        state = left.agg(F.count("*").alias("rows"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("pairs")).first()
        if state["pairs"] <= 4 * state["rows"] or state["pairs"] > before / 2 or found.isEmpty():
            break
        before = state["pairs"]
    if state["pairs"]:
        few = left.where(F.col("m") <= FEW)
        x = few.select("v", F.col("k").alias("a"), "n", F.col("comp").alias("ca"))
        y = few.select("v", F.col("k").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
        pairs = x.join(y, "v").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _comparable(F.col("n"), F.col("nb"), percent))
        many = left.where(F.col("m") > FEW).groupBy("k", "comp").agg(F.sort_array(F.collect_list(F.struct("v", "m"))).alias("own"))  # at most k
        many = many.join(small, "k").select("k", "comp", "sketch", F.col("own.v").alias("lists"), F.posexplode("own").alias("place", "list"))
        many = many.select("k", "comp", "sketch", "list.*", F.slice("lists", F.lit(1), F.col("place")).alias("earlier"))
        many = many.withColumn("of", F.ceil(F.col("m") / BLOCK)).withColumn("salt", F.pmod(F.xxhash64("k"), "of"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        many = many.select("v", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "k", "comp", "salt", "earlier", "sketch")
        blocks = many.groupBy("v", "i", "j").applyInArrow(_block(k, percent, share), "a long, b long")
        edges = edges.union(verified(near(pairs.select("a", "b").distinct()).union(blocks)))
    labels = components(edges)
    remove(spark, small_path)
    remove(spark, texts_path)
    out = members.join(labels.toDF("rep", "comp"), "rep", "left")
    return out.select("k", "n", F.coalesce("comp", "rep").alias("comp"))


def report(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: its set's size, the smallest id of its component and whether it stands for it.

    Rows are told apart by a stored number, so that neither null nor repeated ids link anything. A component without
    any id has a null one, and its first row stands for it.
    """
    rows = numbered(docs.select("doc_id", "text"))
    labels = groups(rows.select(F.col("number").alias("doc_id"), "row.text"), size, percent)
    ids = rows.select(F.col("number").alias("k"), F.col("row.doc_id").cast("long").alias("doc_id"))
    known = materialize(labels.join(ids, "k"), "labels")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("k").alias("number"))
    first = known.groupBy("comp").agg(F.min(order).alias("first"))
    kept = F.when(F.col("first.last"), F.col("k") == F.col("first.number")).otherwise(F.coalesce(F.col("doc_id") == F.col("first.id"), F.lit(False)))
    return known.join(first, "comp").select("doc_id", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), kept.alias("kept"))


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their group, with the columns they came with.

    Rows are told apart by a stored number; ids only order them: of a group the row with the smallest id stays, null ids last.
    """
    rows = numbered(docs)
    labels = groups(rows.select(F.col("number").alias("doc_id"), "row.text"), size, percent)
    linked = materialize(labels.where("k <> comp").select(F.col("k").alias("number"), "comp"), "linked")
    members = linked.union(linked.select(F.col("comp").alias("number"), "comp").distinct())
    ids = rows.select("number", F.col("row.doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "number")
    members = materialize(members.join(ids, "number").select("comp", "number", order.alias("order")), "members")
    first = members.groupBy("comp").agg(F.min("order").alias("first")).select(F.col("first.number").alias("number"))
    gone = members.select("number").join(first, "number", "left_anti")
    return rows.join(gone, "number", "left_anti").select("row.*")
