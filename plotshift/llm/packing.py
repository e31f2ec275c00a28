"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

1. Tokens. Each document becomes its ids and an end id; one longer than a sequence is cut into full pieces behind a first
   piece that may be shorter. Pre-tokens of the byte-level vocabulary never see each other, so each distinct one is
   encoded once per task and its ids are looked up afterwards. Pieces (without ids) are stored in the shared folder.
2. Plan. How many pieces there are of each length, at most 2048 numbers, decides everything: bins are filled greedily with
   the longest piece that fits, then a bin's smallest piece is taken out and, where two unpacked pieces fill the larger
   gap more tightly, replaced by the fullest such two. Bins that come out alike are planned together, as often as the
   counts allow, so the plan has a number of patterns that the number of lengths bounds, whatever the number of pieces.
3. Places. A piece's rank among those of its length picks its bin. Ranks come in two levels, within a length and hash
   bucket and over the buckets' counts, so that a length that a third of all pieces has is ranked in many tasks. The slots
   of the plan are joined on length and on ranges of ranks.

Defined cases: null and empty texts are one piece, the end id; repeated rows are packed one by one; ties in rank are
broken by id and piece; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotshift.llm.frames import parts
from plotshift.llm.text import Words, slices
from plotshift.session import materialize

LENGTH = 2048
END = 0
#: Pre-tokens whose ids one task keeps; others are merged again in every part of the text.
CACHE = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = 1 if kind == "L" else 2 if kind == "N" else 3
    # The code points with the property White_Space.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


class Encoder:
    """Ids of texts. Pre-tokens are found with array operations, looked up, and only new ones are encoded.

    A pre-token is a run of letters, of numbers or of other characters with the space before it, or a run of white space
    without the space that belongs to the next one. Texts with an apostrophe (contractions are tokens of their own) or a
    special token are given to the tokenizer whole; so are pre-tokens above ``LONG`` bytes. Others are merged with the same
    vocabulary as ranks.
    """

    LONG = 256

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, ["'", *special]))).search
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False).items()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary if t not in special}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.hashes, self.flat = np.zeros(1, np.uint64), np.empty(0, np.uint32)  # the hash 0 stands for no token
        self.sizes, self.begin = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.classes = _classes()

    def _merged(self, token: bytes) -> list[int]:
        text = token.decode()
        return self.merge(text) if len(token) <= self.LONG else self.tokenizer.encode(text, add_special_tokens=False).ids

    def _look_up(self, words: Words, hashes: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pre-tokens (ascending hashes, one place each): where their ids begin in a flat array, and how many."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        new = [self._merged(words.word(i)) for i in sample[~known].tolist()]
        sizes, begin = self.sizes[at], self.begin[at]
        sizes[~known] = fresh = np.array([len(x) for x in new], np.int64)
        begin[~known] = len(self.flat) + np.cumsum(fresh) - fresh
        flat = np.concatenate([self.flat, np.fromiter((i for x in new for i in x), np.uint32)])
        if new and len(self.hashes) < CACHE:
            all_hashes = np.concatenate([self.hashes, hashes[~known]])
            order = np.argsort(all_hashes)
            self.hashes, self.flat = all_hashes[order], flat
            self.sizes = np.concatenate([self.sizes, fresh])[order]
            self.begin = np.concatenate([self.begin, begin[~known]])[order]
        return flat, begin, sizes

    def _tokens(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """Pre-tokens of texts behind each other, and the index of each text's first one."""
        data = b"".join(texts)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        at = np.zeros(len(points) + 1, np.int64)  # byte offsets
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF), out=at[1:])
        sizes = np.cumsum([0, *map(len, texts)])
        begins = np.zeros(len(points) + 1, bool)
        begins[np.searchsorted(at, sizes)] = True
        edge = begins[:-1].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        last = np.zeros(len(points), bool)  # the last white space before another character of the same text
        last[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~begins[1:-1]
        start = edge | last
        after = np.flatnonzero(last) + 1
        start[after[points[after - 1] == 0x20]] = False  # a space belongs to what follows
        starts = np.flatnonzero(start)
        words = Words(np.frombuffer(data, np.uint8), at[starts], at[np.append(starts[1:], len(points))] if len(starts) else at[starts], sizes)
        return words, np.searchsorted(words.starts, sizes)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        easy = []
        for i, t in enumerate(texts):
            text = t.decode()
            if self.whole(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                easy.append(i)
        words, first = self._tokens([texts[i] for i in easy])
        if len(words.starts):
            hashes, sample, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            flat, begin, sizes = self._look_up(words, hashes, sample)
            n = sizes[which]
            end = np.cumsum(n)
            flat = flat[np.repeat(begin[which] - (end - n), n) + np.arange(end[-1])]
            edges = np.concatenate([[0], end])[first]
            for j, i in enumerate(easy):
                out[i] = flat[edges[j] : edges[j + 1]]
        return out


def _byte_letters() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


def _cut(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch, texts in slices(batches):
            ids, piece, start, size, crc = [], [], [], [], []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                data = np.append(tokens, np.uint32(END)).astype("<u4").tobytes()
                n = len(data) // 4
                edges = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    ids.append(doc)
                    piece.append(i)
                    start.append(lo)
                    size.append(hi - lo)
                    crc.append(zlib.crc32(data[4 * lo : 4 * hi]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return body.mapInArrow(_cut(path or vocabulary(), length), PIECES)


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Patterns as (how often, lengths of the pieces in a bin); together they use up ``counts``."""
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out = []
    while left.any():
        have = left.copy()
        bin_: list[int] = []
        gap = length
        while gap and (fits := np.flatnonzero(have[: gap + 1])).size:  # the longest that fits
            bin_.append(int(fits[-1]))
            have[fits[-1]] -= 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]  # the smallest piece gives way to two
            sizes = np.flatnonzero(have[:room])
            partner = room - sizes
            below = np.searchsorted(sizes, partner, "right") - 1
            best = np.where(below >= 0, sizes + sizes[np.maximum(below, 0)], 0)
            same = (below >= 0) & (sizes[np.maximum(below, 0)] == sizes) & (have[sizes] < 2)
            best[same] = np.where(below[same] > 0, sizes[same] + sizes[np.maximum(below[same] - 1, 0)], 0)
            if sizes.size and best.max() > bin_[-1]:
                first = int(sizes[best.argmax()])
                bin_[-1:] = sorted((first, int(best.max()) - first), reverse=True)
        sizes, used = np.unique(bin_, return_counts=True)
        times = int((left[sizes] // used).min())
        left[sizes] -= times * used
        out.append((times, bin_))
    return out


def _slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lowest rank, bins, first sequence, offset): the bins' pieces of a length take ranks in the plan's order."""
    taken: dict[int, int] = {}
    out, first = [], 0
    for times, bin_ in patterns:
        offset = 0
        for size in bin_:
            lo = taken.get(size, 0)
            out.append((size, lo, times, first, offset))
            taken[size] = lo + times
            offset += size
        first += times
    return out


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    cut = materialize(cut, "pieces")
    cut = cut.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(spark))))
    held = cut.groupBy("length", "dealt").count()
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one per length
    slots = spark.createDataFrame(_slots(plan(counts, length)), "length long, lo long, bins long, first long, offset long")
    before = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "dealt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(held, ["length", "dealt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base", "dealt")
    # the slots of a length follow each other: each rank lies in one range
    ranges = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "bins", "first", "offset"))).alias("slots"))
    at = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["lo"] + s["bins"]))[0]
    placed = ranked.join(F.broadcast(ranges), "length").withColumn("at", at)  # at most one row per length
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.first") + F.col("rank") - F.col("at.lo")).alias("sequence_id"), "at.offset"
    )


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece with its place."""
    return pack(pieces(docs, path))
