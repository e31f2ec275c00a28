"""Prefix trie of conversations by burst tries.

A turn's id is the digest of its role and text, so texts stay where they are. Turn sequences are cut into segments of
``SEGMENT`` turns. A segment hangs under its head, which the digest of all segments before it names, so a conversation of
any length is spread over tasks, and all heads of all levels are worked on at the same time.

1. Containers. Under a head hang the distinct segments (copies are counted, not kept). A container of more than
   ``CONTAINER`` of them bursts: its node becomes a trie node and its suffixes move to containers by the next turn id; turns
   that all of a container's suffixes share are passed in the same round. Rounds go on until no container is too large.
   Nodes that bursting made are aggregated by Spark from the suffixes below them.
2. Sweep. Remaining containers are dealt to tasks, sorted by suffix and swept: a stack of open nodes follows the common
   prefixes of neighbours. A task holds one container.
3. Two sweeps, because sums over a whole subtree cross containers. A conversation owns the nodes whose smallest member it is,
   and these are all its nodes from some depth on. What a node saves in its subtree is, over its members, the bytes between
   the node and the first turn that the member owns; its leaves are the members that own a node without children. The first
   sweep finds these two numbers per conversation; the second adds them up per node.

A node is named by its smallest member and its depth, which is also where its turn is to be read.

Defined cases: a null role or text is empty; rows without a conversation id belong to no conversation; null turns come
first, ties in a turn are ordered by the digest of role and text; repeated rows are turns of their own; a turn may be of any
size; an empty table gives no rows, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotshift.session import materialize

SEGMENT = 256
CONTAINER = 4096
#: Bytes of a turn id.
ID = 16
#: Conversation ids in one packed row of a digest.
PACK = 4096

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end string, merge boolean"


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, token, size), stored in the order of the turns: ``at`` ascends, ``part`` is the sorted range.

    The whole table is sorted by ranges of (conversation, turn), so one conversation's turns are sorted by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", token.alias("token"),
        F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("number"),
    )
    keys = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("token"), F.col("number")]
    turns = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # counts up inside a partition, and from partition to partition
    return materialize(turns.select("conv_id", "token", "size", at.alias("at"), F.shiftright(at, 33).alias("part")), "turns")


def runs(turns: DataFrame) -> DataFrame:
    """(conv_id, part, lo, before, own): per conversation and range its first place, its turns in earlier ranges, and all its turns."""
    held = turns.groupBy("conv_id", "part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    w = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.select("conv_id", "part", "lo", before.alias("before"), F.sum("n").over(w).alias("own"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, token, size): the first turns of another conversation, then the own ones behind as many.

    A row without a token, one deeper than the last turn, ends each conversation.
    """
    parts = materialize(runs(turns), "runs")
    place = F.col("before") + F.col("at") - F.col("lo") + 1
    donors = turns.join(parts.where("before < 8"), ["conv_id", "part"]).withColumn("place", place).where("place <= 8 AND conv_id % 5 = 0")
    heads = donors.groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("place", "token", "size"))).alias("head"))
    convs = parts.where("before = 0").select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"), F.expr("conv_id - conv_id % 5 AS donor")
    )
    lent = F.when(F.col("head").isNull(), F.array()).otherwise(F.slice("head", 1, F.col("h")))
    convs = convs.join(heads, "donor", "left").withColumn("head", lent)
    convs = convs.select("conv_id", "h", "head", F.size("head").cast("long").alias("lent"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"))
    convs = materialize(convs, "convs")
    own = turns.join(parts.join(convs.drop("head", "rest"), "conv_id"), ["conv_id", "part"]).where(place > F.col("h"))
    own = own.select("conv_id", (place - F.col("h") + F.col("lent")).alias("depth"), "token", "size")
    first = convs.select("conv_id", F.posexplode("head").alias("i", "x")).select("conv_id", (F.col("i") + 1).cast("long"), "x.token", "x.size")
    ends = convs.select("conv_id", F.col("lent") + F.col("rest") + 1, F.lit(None).cast("string"), F.lit(0).cast("long"))
    return own.union(first).union(ends)


def node_key(tokens: Column) -> Column:
    """Name of the node that ``tokens`` lead to from the head."""
    return F.md5(F.concat(F.col("head").cast("binary"), tokens))


def segments(rows: DataFrame, segment: int) -> DataFrame:
    """(conv_id, k, head, gid, tokens, sizes, before, total), stored: segment k with the digest and bytes of all before it.

    A segment of fewer than ``segment`` turns is its conversation's last; it may have none.
    """
    held = rows.groupBy("conv_id", F.expr(f"(depth - 1) div {segment} AS k")).agg(F.sort_array(F.collect_list(F.struct("depth", "token", "size"))).alias("x"))
    tokens = F.unhex(F.array_join(F.col("x.token"), ""))  # the end row has none
    sizes = F.transform(F.filter("x", lambda t: t["token"].isNotNull()), lambda t: t["size"])
    held = materialize(held.select("conv_id", "k", tokens.alias("tokens"), sizes.alias("sizes")), "segments")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    long = held.where((F.size("sizes") == segment) | (F.col("k") > 0))
    long = long.select("conv_id", "k", size.alias("b"), *[F.xxhash64(F.lit(i), "k", "tokens").alias(f"h{i}") for i in (1, 2)])
    w = Window.partitionBy("conv_id")
    past = w.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("conv_id", "k", F.sum("b").over(past).alias("before"), F.sum("b").over(w).alias("total"), *[F.bit_xor(f"h{i}").over(past).alias(f"h{i}") for i in (1, 2)])
    whole = held.join(long, ["conv_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    head = F.md5(F.concat_ws(":", "k", zero("h1"), zero("h2")).cast("binary"))
    whole = whole.select("conv_id", "k", "tokens", "sizes", zero("before").alias("before"), F.coalesce("total", size).alias("total"), head.alias("head"))
    return materialize(whole.withColumn("gid", node_key(F.col("tokens"))), "segments")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        steps = [common(a, b) + 1 for a, b in zip(*[batch.column(c).to_pylist() for c in ("least", "most")])]
        yield pa.RecordBatch.from_pydict({"cid": batch.column("cid"), "step": pa.array(steps, pa.int32())})


def common(a: bytes, b: bytes) -> int:
    """Number of leading turn ids that both have."""
    lo, hi = 0, min(len(a), len(b)) // ID
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo * ID : mid * ID] == b[lo * ID : mid * ID] else (lo, mid - 1)
    return lo


def burst(groups: DataFrame, container: int) -> DataFrame:
    """``groups`` with ``cut``, the depth below the head at which its container hangs; one more than its turns if it hangs in none."""
    settled, active = [], groups.withColumn("cut", F.lit(0))
    length = F.size("sizes")
    while True:
        active = active.withColumn("cid", node_key(F.substring("tokens", F.lit(1), ID * F.col("cut"))))
        rest = F.expr(f"substring(tokens, {ID} * cut + 1)")
        big = active.groupBy("cid").agg(F.count("*").alias("n"), F.min(rest).alias("least"), F.max(rest).alias("most")).where(F.col("n") > container)
        big = materialize(big.mapInArrow(_shared, "cid string, step int"), "burst")
        if not big.take(1):
            return reduce(DataFrame.union, [*settled, active.drop("cid")])
        moved = active.join(big, "cid", "left").withColumn("cut", F.least(F.col("cut") + F.coalesce("step", F.lit(0)), length + 1))
        moved = materialize(moved.drop("cid"), "burst")
        again = F.col("step").isNotNull() & (F.col("cut") <= length)
        settled.append(moved.where(~again).drop("step"))
        active = moved.where(again).drop("step")


def _paths(segment: int):
    """Rows of every trie node that a group hangs under, down to its container's, with the group's share of the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("k", "head", "tokens", "sizes", "before", "cut", "n", "rep", "q_rep", "q_sum", "leaves")
        for batch in batches:
            rows = []
            for k, head, tokens, sizes, past, cut, n, rep, q_rep, q_sum, leaves in zip(*[batch.column(c).to_pylist() for c in names]):
                up = None
                for j in range(min(cut, len(sizes)) + 1):
                    node = hashlib.md5(head.encode() + tokens[: ID * j]).hexdigest()
                    past += sizes[j - 2] if j > 1 else 0  # bytes before the node's own turn
                    saved = max(0, q_rep - past) + q_sum - q_rep - (n - 1) * past
                    rows.append((node, up, k * segment + j, j == cut, past, n, rep, leaves, saved))
                    up = node
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(PATH))

    return run


PATH = ("node", "up", "depth", "hangs", "past", "n", "rep", "leaves", "saved")


def upper(placed: DataFrame, segment: int) -> DataFrame:
    """One row per trie node that bursting made, and per container under one (``hangs``)."""
    schema = "node string, up string, depth long, hangs boolean, past long, n long, rep long, leaves long, saved long"
    rows = placed.where("cut > 0").drop("gid").mapInArrow(_paths(segment), schema)
    return rows.groupBy("node").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("hangs").alias("hangs"), F.min("past").alias("past"),
        F.sum("n").alias("n"), F.min("rep").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )


class Sweep:
    """Nodes of one container from its suffixes in order; a stack holds the open ones."""

    def __init__(self, cut: int, past: int, size: int):
        #: parent, depth, past, own bytes, smallest member, members, children, leaves, saved, end
        self.nodes: list[list] = [[-1, cut, past, size, None, 0, 0, 0, 0, None]]
        self.open, self.last = [0], None

    def add(self, gid: str, tokens: bytes, sizes: list[int], before: int, n: int, rep: int, leaves: int, below: int, ended: bool) -> None:
        nodes, open_ = self.nodes, self.open
        shared = nodes[0][1] if self.last is None else max(nodes[0][1], common(self.last, tokens))
        while nodes[open_[-1]][1] > shared:
            self._close()
        self.last = tokens
        past = before + sum(sizes[:shared])
        for depth in range(shared + 1, len(sizes) + 1):
            size = sizes[depth - 1]
            nodes.append([open_[-1], depth, past, size, None, 0, 0, 0, 0, None])
            open_.append(len(nodes) - 1)
            past += size
        node = nodes[open_[-1]]
        node[4] = rep if node[4] is None else min(node[4], rep)
        node[5] += n
        node[7] += leaves
        node[8] += below
        if ended:
            node[9] = gid

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        node[8] += (node[5] - 1) * node[3]
        if self.open:
            up = self.nodes[self.open[-1]]
            up[4] = node[4] if up[4] is None else min(up[4], node[4])
            up[5] += node[5]
            up[6] += 1
            up[7] += node[7]
            up[8] += node[8]

    def end(self) -> list[list]:
        while self.open:
            self._close()
        return self.nodes


def _swept(segment: int, first: bool):
    """Rows of the nodes of a task's containers, which come sorted; ``first`` gives what conversations own instead."""

    def own(k: int, nodes: list[list]) -> list[tuple]:
        rows = []
        for i, (up, _, past, _, rep, _, children, _, _, end) in enumerate(nodes):
            top, leaf = i == 0 or nodes[up][4] != rep, not children and end is not None
            if top or leaf:
                rows.append((rep, past if top else None, int(leaf)))
        return rows

    def whole(k: int, nodes: list[list]) -> list[tuple]:
        rows = []
        for i, (up, depth, _, _, rep, n, children, leaves, saved, end) in enumerate(nodes):
            low, high = depth == 0 and k > 0, depth == segment  # the same node belongs to two levels: each gives what it knows
            rows.append(
                (rep, k * segment + depth, nodes[up][4] if i else None, n, None if high else children, None if low else leaves,
                 None if low else saved, end, i == 0 or high)
            )
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("cid", "gid", "k", "tokens", "sizes", "before", "cut", "n", "rep", "q_rep", "q_sum", "leaves")
        give, last, level, sweep = own if first else whole, None, 0, None
        kinds = (pa.int64(), pa.int64(), pa.int32()) if first else (*[pa.int64()] * 7, pa.string(), pa.bool_())
        labels = ["conv_id", "past", "leaf"] if first else [f.split()[0] for f in NODE.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=labels)
        for batch in batches:
            done = []
            for cid, gid, k, tokens, sizes, before, cut, n, rep, q_rep, q_sum, leaves in zip(*[batch.column(c).to_pylist() for c in names]):
                if cid != last:
                    if sweep:
                        done += give(level, sweep.end())
                    sweep = Sweep(cut, before + sum(sizes[: max(cut - 1, 0)]), sizes[cut - 1] if cut else 0)
                    last, level = cid, k
                behind = before + sum(sizes)
                below = max(0, q_rep - behind) + q_sum - q_rep - (n - 1) * behind if len(sizes) == segment else 0
                sweep.add(gid, tokens, sizes, before, n, rep, leaves, below, len(sizes) < segment)
            yield table(done)
        if sweep:
            yield table(give(level, sweep.end()))

    return run


def swept(placed: DataFrame, segment: int, first: bool) -> DataFrame:
    inside = placed.where(F.col("cut") <= F.size("sizes")).withColumn("cid", node_key(F.substring("tokens", F.lit(1), ID * F.col("cut"))))
    schema = "conv_id long, past long, leaf int" if first else NODE
    return inside.repartition("cid").sortWithinPartitions("cid", "tokens").mapInArrow(_swept(segment, first), schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, last = [], None
        for end, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
            if end != last or len(rows[-1][2]) == PACK:
                rows.append((end, conv, []))
                last = end
            rows[-1][2].append(str(conv))
        yield pa.RecordBatch.from_pydict(
            {"end": pa.array([r[0] for r in rows], pa.string()), "first": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([",".join(r[2]) for r in rows], pa.string())}
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, digest = None, None
    table = lambda rows: pa.RecordBatch.from_pydict({"end": pa.array([r[0] for r in rows], pa.string()), "ends_sha256": pa.array([r[1] for r in rows], pa.string())})
    for batch in batches:
        done = []
        for end, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if end == last:
                digest.update(b"," + ids.encode())
                continue
            if digest:
                done.append((last, digest.hexdigest()))
            last, digest = end, hashlib.sha256(ids.encode())
        yield table(done)
    if digest:
        yield table([(last, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, conv_id): sorted by ranges and packed there, so the sequential digest reads few long rows."""
    ranges = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    packed = ranges.mapInArrow(_packed, "end string, first long, ids string")
    return packed.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_digested, "end string, ends_sha256 string")


def trie(rows: DataFrame, segment: int = SEGMENT, container: int = CONTAINER) -> DataFrame:
    """Nodes of the trie of ``rows`` (see :func:`rebuilt`): one row per distinct sequence of leading turns."""
    held = segments(rows, segment)
    groups = held.groupBy("gid").agg(
        *[F.first(c).alias(c) for c in ("k", "head", "tokens", "sizes", "before")], F.count("*").alias("n"), F.min("conv_id").alias("rep")
    )
    placed = burst(materialize(groups, "groups"), container)

    none = {c: F.lit(0).cast("long") for c in ("q_rep", "q_sum", "leaves")}
    blank = placed.withColumns(none)
    top = upper(blank, segment).select("conv_id", "past", F.lit(0).alias("leaf"))
    owned = swept(blank, segment, True).union(top).groupBy("conv_id").agg(F.min("past").alias("q"), F.max("leaf").cast("long").alias("leaf"))
    owned = materialize(owned, "owned")

    sums = held.join(owned, "conv_id", "left").select("gid", "conv_id", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = sums.groupBy("gid").agg(F.min_by("q", "conv_id").alias("q_rep"), F.sum("q").alias("q_sum"), F.sum("leaf").alias("leaves"))
    full = materialize(placed.join(sums, "gid"), "placed")

    high = materialize(upper(full, segment), "upper")
    children = high.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("children"))
    parents = high.select(F.col("node").alias("up"), F.col("conv_id").alias("parent"))
    trunk = high.where("up IS NOT NULL").join(parents, "up").select("node", "parent")
    high = high.join(children, "node", "left").join(trunk, "node", "left")
    low = (F.col("depth") > 0) & F.col("up").isNull()  # a head's own node; the level above knows its sums
    deep = (F.col("depth") % segment == 0) & F.col("up").isNotNull()
    unless = lambda hide, c: F.when(~F.col("hangs") & ~hide, F.col(c))
    head = high.select(
        "conv_id", "depth", "parent", "n", unless(deep, "children"), unless(low, "leaves"), unless(low, "saved"), unless(deep, "node"),
        F.col("hangs") | (F.col("depth") % segment == 0),
    )
    nodes = materialize(swept(full, segment, False).union(head), "nodes")
    both = nodes.where("merge").groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in nodes.columns if c not in ("conv_id", "depth")])
    nodes = nodes.where("NOT merge").union(both.select(*nodes.columns)).drop("merge")

    empty = F.sha2(F.lit(""), 256)
    digests = end_digests(held.where(F.size("sizes") < segment).select(F.col("gid").alias("end"), "conv_id"))
    named = nodes.where("end IS NOT NULL").join(digests, "end", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return named.drop("end").unionByName(nodes.where("end IS NULL").drop("end").withColumn("ends_sha256", empty))


def report(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie."""
    return trie(rebuilt(ordered(conversations)))
