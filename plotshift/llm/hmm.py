"""Language model scores from a hidden Markov model.

A token is a word or a text's end. A model's states emit token classes: each of the ``HEAD`` most frequent words is a class
of its own, other words share classes by their last two bytes, tokens that training never saw are one class, the end is
one. Within a class a word has its share of the counts plus one, so over the V seen tokens and one unseen the emissions of
a state sum to one, as the base's do.

1. Chunks. A scan writes the words of each few megabytes of text as numbers into the chunk's own sorted word list, and the
   list's hashes with training counts as one row per hash bucket. One tokenisation serves everything after it.
2. Counts. A bucket's rows meet in one task, which adds the counts up and answers each chunk with the counts and classes of
   its words. Chunks and answers meet, and texts become class numbers with the base score and the shares within classes.
3. Baum-Welch. From a start on the first ``WARM_TOKENS`` tokens of ``WARM_TEXTS`` texts, iterations go on until the likelihood
   of all training texts settles (``SETTLED``). Each runs forward and backward over all training texts, in
   stretches of up to ``STRETCH`` tokens; expected counts per class and state are added up across partitions by a shuffle.
4. Scores. The scaled forward recursion over whole texts gives the exact likelihood.

Nothing that grows with the vocabulary or the texts is broadcast or collected: a task gets the head's hashes, one mass per
class and the model. Stored tables cut lineage, so a lost executor costs its tasks.

Defined cases: null and empty texts are the one token end; rows are scored one by one; with no training text every token
is unseen; extra columns are not looked at; null ids count as held in (their remainder is null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.llm import blobs
from plotshift.llm.text import NOT_SPACE, U, mix, slices, split_words
from plotshift.session import materialize

HEAD, TAILS = 8192, 1024
UNSEEN, ENDING = HEAD + TAILS, HEAD + TAILS + 1
CLASSES = HEAD + TAILS + 2
STATES, WARM_TEXTS, WARM_TOKENS, WARM_ITERATIONS = 8, 300, 4000, 15
#: Training ends when an iteration over all texts adds less than this share to the log-likelihood.
SETTLED = 1e-3
STRETCH = 256
#: Weight of the base distribution in a state's emissions, in tokens.
PRIOR = 1000.0
CHUNKS = "chunk long, bucket long, ids array<long>, held array<boolean>, first binary, words binary, counts binary, tails binary"
DOCS = -1
#: A chunk's size: whole texts up to so many bytes and about so many words, whichever is less; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_WORDS = 6 << 20, 1 << 20
#: Groups that the buckets' most frequent words are merged in before the driver merges the rest.
MERGED = 16


def _chunks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch, texts in slices(batches, CHUNK_BYTES, CHUNK_WORDS):
            words = split_words(texts, NOT_SPACE, True)
            distinct, sample, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            held = np.array(batch.column("held").to_pylist(), bool)
            training = np.repeat(~held, np.diff(words.first))
            counts = np.bincount(which[training], minlength=len(distinct)).astype(np.int32)
            del training
            s, e = words.starts[sample], words.ends[sample]
            suffix = words.buf[e - 1].astype(U) | (words.buf[np.maximum(e - 2, s)].astype(U) << U(8))
            tails = (mix(suffix, 40) % U(TAILS)).astype(np.uint16)
            order = np.argsort(distinct % U(n), kind="stable")  # the chunk's words by bucket and hash
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            placed, first = place[which].tobytes(), words.first.astype(np.int64).tobytes()
            del words, which, s, e, suffix
            distinct, counts, tails = distinct[order], counts[order], tails[order]
            starts, sizes = blobs.runs(distinct % U(n))
            rows = [(int(distinct[lo] % U(n)), slice(lo, lo + k)) for lo, k in zip(starts.tolist(), sizes.tolist())]
            empty = [None] * len(rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array(np.full(len(rows) + 1, chunk, np.int64)),
                    "bucket": pa.array([DOCS, *[b for b, _ in rows]], pa.int64()),
                    "ids": pa.array([batch.column("doc_id").to_pylist(), *empty], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist(), *empty], pa.list_(pa.bool_())),
                    "first": pa.array([first, *empty], pa.binary()),
                    "words": pa.array([placed, *[distinct[p].tobytes() for _, p in rows]], pa.binary()),
                    "counts": pa.array([None, *[counts[p].tobytes() for _, p in rows]], pa.binary()),
                    "tails": pa.array([None, *[tails[p].tobytes() for _, p in rows]], pa.binary()),
                }
            )
            chunk += 1

    return run


def _frequent(kind: type):
    """Of one group's rows: a row with the ``HEAD`` most frequent words by exact totals; ties by the word as a signed number."""

    def run(table: pa.Table) -> pa.Table:
        words, counts = blobs.joined(table, "words", np.int64), blobs.joined(table, "counts", kind)
        distinct, which = np.unique(words, return_inverse=True)
        total = np.bincount(which, counts, len(distinct)).astype(np.int64)
        top = np.argsort(-total, kind="stable")[:HEAD]
        top = top[total[top] > 0]
        row = {"bucket": table.column("bucket")[:1], "words": [distinct[top].tobytes()], "counts": [total[top].tobytes()]}
        return pa.table(row, schema=pa.schema({"bucket": pa.int64(), "words": pa.binary(), "counts": pa.binary()}))

    return run


def _answers(head: np.ndarray):
    """Of one bucket: per chunk the counts and classes of its words, and a row (chunk null) of the bucket's totals."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.column("words").to_pylist()
        sizes = [len(x) // 8 for x in rows]
        words = np.frombuffer(b"".join(rows), np.uint64)
        counts = blobs.joined(table, "counts", np.int32)
        tails = blobs.joined(table, "tails", np.uint16)
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(which, counts, len(distinct)).astype(np.int64)
        kind = HEAD + tails[first].astype(np.int64)
        if len(head):
            at = np.minimum(np.searchsorted(head, distinct), len(head) - 1)
            kind = np.where(head[at] == distinct, at, kind)
        kind[total == 0] = UNSEEN
        seen = total > 0
        mass = np.bincount(kind[seen], total[seen] + 1, CLASSES).astype(np.int64)
        own = np.flatnonzero(mass)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        n, k = total.astype(np.int64)[which], kind.astype(np.uint16)[which]
        return pa.table(
            {
                "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
                "bucket": pa.array([*table.column("bucket").to_pylist(), int(seen.sum())], pa.int64()),
                "n": pa.array([*[n[a:b].tobytes() for a, b in zip(edges, edges[1:])], None], pa.binary()),
                "kinds": pa.array([*[k[a:b].tobytes() for a, b in zip(edges, edges[1:])], None], pa.binary()),
                "class": pa.array([*[None] * len(rows), own.tolist()], pa.list_(pa.int64())),
                "mass": pa.array([*[None] * len(rows), mass[own].tolist()], pa.list_(pa.int64())),
            }
        )

    return answer


ANSWERS = "chunk long, bucket long, n binary, kinds binary, class array<long>, mass array<long>"


@dataclass
class Counts:
    """What training gathered: tokens, distinct tokens and the mass (counts plus one each) of every class."""

    tokens: int
    distinct: int
    mass: np.ndarray

    @property
    def all(self) -> int:
        return self.tokens + self.distinct + 1


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, shares double, classes binary"


def _coded(counts: Counts, ends: int):
    def code(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "shares", "classes")}
        order = np.argsort(np.array(answers.column("bucket").to_pylist(), np.int64), kind="stable").tolist()
        n, k = answers.column("n").to_pylist(), answers.column("kinds").to_pylist()
        total = np.frombuffer(b"".join(n[i] for i in order), np.int64)
        kind = np.frombuffer(b"".join(k[i] for i in order), np.uint16)
        base = np.log10((total + 1) / counts.all)
        share = np.where(kind == UNSEEN, 0.0, np.log10((total + 1) / np.maximum(counts.mass[kind], 1)))
        last = math.log10((ends + 1) / counts.all)
        tail = np.array([ENDING if ends else UNSEEN], np.uint16).tobytes()
        for ids, held, first, words in zip(*[docs.column(c).to_pylist() for c in ("ids", "held", "first", "words")]):
            first, words = np.frombuffer(first, np.int64), np.frombuffer(words, np.uint32)
            for i, (doc, out_of) in enumerate(zip(ids, held)):
                own = words[first[i] : first[i + 1]]
                out["doc_id"].append(doc)
                out["held_out"].append(out_of)
                out["n_tokens"].append(len(own) + 1)
                out["n_known"].append(int((total[own] > 0).sum()) + (ends > 0))
                out["base_score"].append(float(base[own].sum()) + last)
                out["shares"].append(float(share[own].sum()))
                out["classes"].append(kind[own].tobytes() + tail)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return code


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray  # class by state


def _layout(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of chains walked side by side: first row of each step, and each token's row."""
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    longest = int(size.max()) if len(size) else 0
    active = np.searchsorted(-size[order], -np.arange(longest), "left")
    row = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
    return row, row[step] + np.repeat(rank, size)


def _forward(model: Model, kinds: np.ndarray, edges: np.ndarray):
    """Scaled forward values in step order, the scales, the rows of steps and each token's row."""
    row, place = _layout(edges)
    emit = np.empty((len(kinds), len(model.start)))
    emit[place] = model.emit[kinds]
    ahead, scale, ones = np.empty_like(emit), np.empty((len(kinds), 1)), np.ones((len(model.start), 1))
    for t in range(len(row) - 1):
        lo, hi, before = row[t], row[t + 1], row[t - 1] if t else 0
        a = emit[lo:hi] * (model.start if t == 0 else ahead[before : before + hi - lo] @ model.moves)
        scale[lo:hi] = c = a @ ones
        np.divide(a, c, out=ahead[lo:hi])
    return emit, ahead, scale, row, place


def log_likelihood(model: Model, kinds: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Base-10 logarithm of each chain's probability."""
    _, _, scale, _, place = _forward(model, kinds, edges)
    return np.add.reduceat(np.log10(scale[place, 0]), edges[:-1]) if len(edges) > 1 else np.empty(0)


def expected(model: Model, kinds: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions (class by state) of the chains, and their log-likelihood."""
    emit, ahead, scale, row, place = _forward(model, kinds, edges)
    onward, back = emit / scale, np.ones_like(emit)
    for t in range(len(row) - 3, -1, -1):
        lo, hi = row[t + 1], row[t + 2]
        onward[lo:hi] *= back[lo:hi]
        np.matmul(onward[lo:hi], model.moves.T, out=back[row[t] : row[t] + hi - lo])
    state = ahead * back
    moves = np.zeros_like(model.moves)
    for t in range(len(row) - 2):
        lo, hi = row[t + 1], row[t + 2]
        moves += ahead[row[t] : row[t] + hi - lo].T @ onward[lo:hi]
    start = state[: row[1]].sum(axis=0) if len(row) > 1 else np.zeros(len(model.start))
    own = state[place]
    by_class = np.stack([np.bincount(kinds, own[:, s], CLASSES) for s in range(own.shape[1])], axis=1)
    return start, moves * model.moves, by_class, float(np.log(scale).sum())


def maximise(counts: Counts, start: np.ndarray, moves: np.ndarray, by_class: np.ndarray) -> Model:
    """Smoothed ratios of expected counts; emissions lean on the base's mass of each class.

    Training holds no unseen token, so every state keeps the base's mass for it.
    """
    prior = counts.mass / counts.all
    emit = (by_class + PRIOR * prior[:, None]) / (by_class.sum(axis=0) + PRIOR)
    emit *= (1 - prior[UNSEEN]) / (1 - emit[UNSEEN])
    emit[UNSEEN] = prior[UNSEEN]
    return Model((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emit)


def _stretches(edges: np.ndarray) -> np.ndarray:
    cuts = [np.arange(lo, hi, STRETCH) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return np.append(np.concatenate(cuts) if cuts else np.empty(0, np.int64), edges[-1])


def _parts(batch: pa.RecordBatch, limit: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``limit`` tokens: the rows, their classes and the edges of texts."""
    data, lo, size = batch.column("classes").to_pylist(), 0, 0
    for i in range(len(data) + 1):
        if i == len(data) or size and size + len(data[i]) // 2 > limit:
            if i > lo:
                kinds = np.frombuffer(b"".join(data[lo:i]), np.uint16)
                yield batch.slice(lo, i - lo), kinds, np.cumsum([0, *[len(x) // 2 for x in data[lo:i]]])
            lo, size = i, 0
        if i < len(data):
            size += len(data[i]) // 2


def _counted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES + STATES + 2, STATES))  # classes, then moves, starts, and the log-likelihood
        for batch in batches:
            for _, kinds, edges in _parts(batch):
                start, moves, by_class, gain = expected(model, kinds, _stretches(edges))
                sums[:-1] += np.concatenate([by_class, moves, start[None]])
                sums[-1, 0] += gain
        own = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": pa.array(own), **{f"s{s}": pa.array(sums[own, s]) for s in range(STATES)}})

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, kinds, edges in _parts(batch):
                score = log_likelihood(model, kinds, edges) + rows.column("shares").to_numpy()
                yield rows.drop_columns(["shares", "classes"]).append_column("score", pa.array(score, pa.float64()))

    return run


def encode(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """Texts as class numbers with their base scores (stored), and the training counts. ``docs``: doc_id, text, held."""
    n = blobs.buckets(docs)
    chunks = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held").mapInArrow(_chunks(n), CHUNKS), "chunks")
    top, schema = chunks.where("bucket >= 0").select("bucket", "words", "counts"), "bucket long, words binary, counts binary"
    top = top.groupBy("bucket").applyInArrow(_frequent(np.int32), schema)
    top = top.groupBy(F.pmod("bucket", F.lit(MERGED))).applyInArrow(_frequent(np.int64), schema).collect()  # MERGED rows
    rows = pa.table({c: pa.array([r[c] for r in top], t) for c, t in (("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()))})
    head = np.sort(blobs.joined(_frequent(np.int64)(rows), "words", np.uint64)) if top else np.empty(0, np.uint64)
    asked = chunks.where("bucket >= 0").select("chunk", "bucket", "words", "counts", "tails")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answers(head), ANSWERS), "answers")
    totals = answers.where("chunk is null")
    mass = np.zeros(CLASSES, np.int64)
    pairs = totals.select(F.explode(F.arrays_zip("class", "mass")).alias("x")).groupBy("x.class").agg(F.sum("x.mass").alias("mass"))
    for r in pairs.collect():  # one row per class
        mass[r["class"]] = r["mass"]
    distinct = totals.agg(F.sum("bucket")).first()[0] or 0
    heads = chunks.where(F.col("bucket") == DOCS)
    ends = heads.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    counts = Counts(int(mass.sum()) - distinct + ends, distinct + (ends > 0), mass)
    mass[ENDING], mass[UNSEEN] = (ends + 1) * (ends > 0), 1
    left = heads.select("chunk", "ids", "held", "first", "words").groupBy("chunk")
    right = answers.where("chunk is not null").select(F.col("chunk").alias("of"), "bucket", "n", "kinds").groupBy("of")
    return materialize(left.cogroup(right).applyInArrow(_coded(counts, ends), CODED), "coded"), counts


def train(coded: DataFrame, counts: Counts) -> Model:
    """Baum-Welch: a start on the beginnings of a few texts, then iterations over all training texts until the likelihood settles."""
    rng = np.random.default_rng(11)
    own = coded.where(~F.col("held_out")).select("classes", "n_tokens", "doc_id")
    begin = F.substring("classes", 1, 2 * WARM_TOKENS).alias("classes")
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(WARM_TEXTS).select(begin).collect()
    noise = rng.gamma(2.0, 1.0, (CLASSES, STATES))
    prior = counts.mass / counts.all
    moves = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    emit = prior[:, None] * noise
    model = Model(np.full(STATES, 1 / STATES), moves, emit / emit.sum(axis=0))
    if sample:
        kinds = np.frombuffer(b"".join(bytes(r["classes"]) for r in sample), np.uint16)
        edges = _stretches(np.cumsum([0, *[len(r["classes"]) // 2 for r in sample]]))
        for _ in range(WARM_ITERATIONS):
            model = maximise(counts, *expected(model, kinds, edges)[:3])
    schema, before = "row long, " + ", ".join(f"s{s} double" for s in range(STATES)), -math.inf
    while sample:
        sums = np.zeros((CLASSES + STATES + 2, STATES))
        counted = own.select("classes").mapInArrow(_counted(model), schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)])
        for r in counted.collect():  # one row per class and state
            sums[r["row"]] = [r[f"s{s}"] for s in range(STATES)]
        likelihood = sums[-1, 0]
        if not likelihood - before > SETTLED * abs(likelihood):
            break
        before = likelihood
        model = maximise(counts, sums[-2], sums[CLASSES:-2], sums[:CLASSES])
    return model


def report(docs: DataFrame) -> DataFrame:
    """One row per document: token counts, the base's score and the model's, both base-10 logarithms."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    coded, counts = encode(docs.select("doc_id", "text", held.alias("held")))
    model = train(coded, counts)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return coded.mapInArrow(_scored(model), schema).withColumn("train_tokens", F.lit(counts.tokens).cast("long"))
