"""Alignment of two tokenizers' outputs by galloping intersection of their token ends.

Both tokenizers cut the same bytes, so a place where tokens of both end cuts both sequences. The ends of a text are two
ascending lists. The shorter drives: its ends, a run at a time, go up the longer one in doubling steps and are then found by
binary search between the last two, so lists of very different lengths cost the shorter's length times a logarithm. The
common indices slice the tokens into groups; the differences of neighbouring indices are the numbers of tokens of either
side in a group. Stored beside the ids is a byte per token that tells whether it ends a group. A link joins the two tokens
that end a group.

``align`` is one pass over the texts without a shuffle. What a pair of ids is linked for in the whole corpus is summed per
task first. The number of different pairs does not grow with the corpus: of two tokens that end together one is a suffix of
the other, so a vocabulary of n tokens of mean length m has at most n * m partners. That table (below a million rows for the
public vocabularies) is broadcast to a second pass over the stored alignment.

Defined cases: a null or empty text, and one whose tokens of either side do not spell a space and the text, has no tokens
and no groups; special tokens' strings inside a text are text; repeated rows, null ids and ties stay rows of their own; a
text of any length is whole (its ids and ends are held in arrays, its digest is built in blocks); an empty table gives no
rows; other columns stay as they are, but for the names of ``COLUMNS``, which replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotshift.llm.packing import Encoder, _byte_letters
from plotshift.llm.text import slices
from plotshift.session import materialize

#: Ids of both sides (little-endian, two bytes each, or four for a vocabulary above 65536), and a byte per id: 1 at a group's end.
COLUMNS = ("a_ids", "b_ids", "a_ends", "b_ends")
#: Groups whose text form is put together at a time.
BLOCK = 1 << 16
#: Ends that go up together.
RUN = 1024
#: Bytes of text that a task encodes at a time, and tokens that it reads at a time, one text at least.
SLICE = 1 << 20


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """Side A: a space and the text by a byte-level vocabulary; strings of special tokens are text."""

    def __init__(self, path: str):
        self.encode = Encoder(path)
        self.encode.tokenizer.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = self.encode.tokenizer.get_vocab()
        self.bytes = np.empty(max(vocabulary.values()) + 1, object)
        self.bytes[:] = b""
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.encode([b" " + t for t in texts])


class Pieces:
    """Side B: the text by a piece vocabulary that puts a space before it and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.empty(self.model.get_piece_size(), object)
        for i in range(len(self.bytes)):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode([t.decode() for t in texts], num_threads=1)]


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both ascending arrays of the values they share.

    A run of ``RUN`` values goes up together: doubling steps until the longer array has passed its last value, then a
    binary search of each value between where the run before ended and there.
    """
    mine, theirs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n, lo = len(long), 0
    for at in range(0, len(short), RUN):
        run = short[at : at + RUN]
        hi, step = lo, len(run)
        while hi < n and long[hi] < run[-1]:  # doubling steps up
            hi += step
            step += step
        between = long[lo : hi + 1]
        place = np.searchsorted(between, run)  # binary search between the last two
        same = np.flatnonzero(between[np.minimum(place, len(between) - 1)] == run) if len(between) else mine[0]
        mine.append(at + same)
        theirs.append(lo + place[same])
        lo += int(place[-1])
    return np.concatenate(mine), np.concatenate(theirs)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and in ``b`` of their common values; the shorter drives."""
    return gallop(a, b) if len(a) <= len(b) else gallop(b, a)[::-1]


def _aligned(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = ByteLevel(first), Pieces(second)
        sizes_of = [np.array([len(x) for x in side.bytes], np.int64) for side in sides]
        for batch, texts in slices(batches, SLICE):
            out: list[list[bytes]] = [[], [], [], []]
            for text, *ids in zip(texts, *(side(texts) for side in sides)):
                spelt = b" " + text
                if not text or any(b"".join(side.bytes[x].tolist()) != spelt for side, x in zip(sides, ids)):
                    ids = [np.empty(0, np.uint32)] * 2
                found = common_ends(*(np.cumsum(n[x]) for n, x in zip(sizes_of, ids)))
                for i, (side, x, last) in enumerate(zip(sides, ids, found)):
                    ends = np.zeros(len(x), np.uint8)
                    ends[last] = 1
                    out[i].append(x.astype("<u2" if len(side.bytes) <= 1 << 16 else "<u4").tobytes())
                    out[i + 2].append(ends.tobytes())
            rest = {n: batch.column(n) for n in batch.schema.names if n not in COLUMNS}
            yield pa.RecordBatch.from_pydict(rest | {n: pa.array(v, pa.binary()) for n, v in zip(COLUMNS, out)})

    return run


def align(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """``docs`` with the ids of both tokenizers and the ends of their groups (``COLUMNS``)."""
    kept = [f for f in docs.schema.fields if f.name not in COLUMNS]
    schema = T.StructType([*kept, *[T.StructField(c, T.BinaryType()) for c in COLUMNS]])
    paths = vocabularies()
    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(_aligned(first or paths[0], second or paths[1]), schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE`` tokens, so that memory does not follow the batch size."""
    sizes = np.cumsum([0, *pc.binary_length(batch.column("a_ends")).to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _side(batch: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, the places among them that end groups, and where each row's ids and groups begin."""
    ids, ends = (b"".join(batch.column(f"{side}_{c}").to_pylist()) for c in ("ids", "ends"))
    first = np.cumsum([0, *pc.binary_length(batch.column(f"{side}_ends")).to_pylist()])
    last = np.flatnonzero(np.frombuffer(ends, np.uint8))
    values = np.frombuffer(ids, f"<u{len(ids) // max(len(ends), 1) or 2}").astype(np.int64)
    return values, last, first, np.searchsorted(last, first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in _slices(batch)):
        a, b = (ids[last] for ids, last, _, _ in (_side(part, s) for s in "ab"))
        pairs, n = np.unique(a << 32 | b, return_counts=True)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(n, pa.int64())})


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in _slices(batch)):
        sides = []
        for ids, last, _, of in (_side(part, s) for s in "ab"):
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(ids, pa.int32()))
            sides.append((lists, of))
        groups = pa.ListArray.from_arrays(pa.array(sides[0][1], pa.int32()), pa.StructArray.from_arrays([x for x, _ in sides], ["a", "b"]))
        rest = {n: part.column(n) for n in part.schema.names if n not in COLUMNS}
        yield pa.RecordBatch.from_pydict(rest | {"groups": groups})


def groups(aligned: DataFrame) -> DataFrame:
    """The result of :func:`align` with a column ``groups`` in place of its packed ones: the ids of both sides per group."""
    kept = [f for f in aligned.schema.fields if f.name not in (*COLUMNS, "groups")]
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField("groups", T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))])
    return aligned.select(*[f"`{f.name}`" for f in kept], *COLUMNS).mapInArrow(_grouped, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair."""
    counts = aligned.select(*COLUMNS).mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "n")


def _spelled(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> str:
    """Digest of ``a1,a2|b1;a3|b2,b3``, in blocks of groups: each id with the mark behind it at its place."""
    digest = hashlib.sha256()
    at_a = at_b = 0
    for lo in range(0, len(n_a), BLOCK):
        here_a, here_b = n_a[lo : lo + BLOCK], n_b[lo : lo + BLOCK]
        end_a, end_b = np.cumsum(here_a), np.cumsum(here_b)
        size_a, size_b = int(end_a[-1]), int(end_b[-1])
        out = np.empty(size_a + size_b, object)
        place_a = np.arange(size_a) + np.repeat(end_b - here_b, here_a)
        place_b = np.arange(size_b) + np.repeat(end_a, here_b)
        out[place_a] = _digits(",", a[at_a : at_a + size_a])
        out[place_b] = _digits(",", b[at_b : at_b + size_b])
        out[place_a[end_a - 1]] = _digits("|", a[at_a + end_a - 1])
        out[place_b[end_b - 1]] = _digits(";", b[at_b + end_b - 1])
        at_a, at_b = at_a + size_a, at_b + size_b
        text = "".join(out.tolist())
        digest.update((text[:-1] if lo + BLOCK >= len(n_a) else text).encode())
    return digest.hexdigest()


_tables: dict[str, np.ndarray] = {}


def _digits(mark: str, ids: np.ndarray) -> np.ndarray:
    """Each id in decimal with a mark behind it."""
    have = _tables.get(mark, np.empty(0, object))
    top = int(ids.max(initial=-1)) + 1
    if top > len(have):
        have = _tables[mark] = np.concatenate([have, np.array([f"{i}{mark}" for i in range(len(have), 2 * top)], object)])
    return have[ids]


def _reported(counts):
    """Columns of the report; ``counts`` is a broadcast of ascending pairs, their counts, and whether they lead their B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, leads = counts.value
        for part in (p for batch in batches for p in _slices(batch)):
            (a, last_a, of_a, first), (b, last_b, of_b, _) = _side(part, "a"), _side(part, "b")
            at = np.searchsorted(pairs, a[last_a] << 32 | b[last_b])
            held, best = (np.append(0, np.cumsum(x[at]))[first] for x in (numbers, leads))
            n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            spelled = [
                _spelled(a[p:q], b[r:s], n_a[lo:hi], n_b[lo:hi]) if hi > lo else ""
                for p, q, r, s, lo, hi in zip(of_a, of_a[1:], of_b, of_b[1:], first, first[1:])
            ]
            numbers_of = {"n_a": of_a, "n_b": of_b, "n_groups": first, "n_links": first, "n_best": best, "count_sum": held}
            columns = {k: pa.array(np.diff(v), pa.int64()) for k, v in numbers_of.items()}
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | columns | {"groups_sha256": pa.array(spelled, pa.string())})

    return run


def report(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """One row per document: tokens, groups, links, how common its links are in the corpus, and a digest of the groups."""
    spark = docs.sparkSession
    aligned = materialize(align(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), first, second).drop("text"), "aligned")
    rows = pair_counts(aligned).toPandas()  # bounded by the vocabularies, see above
    rows = rows.assign(pair=rows["a_id"].astype("int64") * (1 << 32) + rows["b_id"]).sort_values("pair")
    leads = (rows["n"] == rows.groupby("b_id")["n"].transform("max")).astype("int64")
    table = spark.sparkContext.broadcast(tuple(x.to_numpy(np.int64) for x in (rows["pair"], rows["n"], leads)))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.mapInArrow(_reported(table), schema)
