"""Language of words and texts by a linear-chain conditional random field.

Words of a line form a chain. A word's features are its first and last one to three bytes, its byte pairs and triples,
itself, and whether a language's lexicon of frequent words has it; features are hashed to weights per language. Transitions
between neighbouring words' languages are learned with them. The forward-backward recursion gives each word's language
distribution, so a text that switches is labelled word by word; a text's language is the one with the most expected words.

The model is fitted on the driver on a sample bounded by ``SAMPLE`` texts, those with the smallest hash of the id, whose
lines are joined in twos and threes across texts so that switches occur. Prediction is one scan over whole texts: features
are computed once per distinct word of a few megabytes, the recursions run over all chains of such a part side by side.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0, as all are if nothing is labelled; ties go to
the first language in order; rows are predicted one by one; extra columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.llm.text import NOT_SPACE, U, Words, mix, slices, split_words

SAMPLE = 1200
BITS = 15
LEXICON = 300
EPOCHS, RATE, PARTS = 4, 0.3, 12
@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # hashed features and one per lexicon, by label
    moves: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]  # sorted word hashes and the label of each


def _chains(words: Words) -> np.ndarray:
    """Place of each chain's first word, and the number of words: a chain ends with its line or text."""
    if not len(words.starts):
        return np.zeros(1, np.int64)
    line = np.cumsum(words.buf == 0x0A)[words.starts]
    new = np.concatenate([[True], line[1:] != line[:-1]])
    new[words.first[:-1][np.diff(words.first) > 0]] = True
    return np.append(np.flatnonzero(new), len(words.starts))


def _features(words: Words, sample: np.ndarray, hashes: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of distinct words, and the place in ``sample`` of each one's word, in its order."""
    s, e = words.starts[sample], words.ends[sample]
    n, buf = e - s, words.buf
    out, of = [mix(hashes, 20)], [np.arange(len(s))]
    for start, step, salt in ((s, 1, 21), (e - 1, -1, 24)):
        code = np.zeros(len(s), U)
        for j in range(3):
            at = np.clip(start + step * j, s, e - 1)
            code = code * U(257) + np.where(n > j, buf[at].astype(U) + U(1), U(0))
            out.append(mix(code, salt + j))
            of.append(np.arange(len(s)))
    for size in (2, 3):
        count = np.maximum(n - size + 1, 0)
        end = np.cumsum(count)
        at = np.repeat(s - (end - count), count) + np.arange(end[-1] if len(end) else 0)
        code = sum((buf[at + j].astype(U) << U(8 * j) for j in range(size)), U(size << 40))
        out.append(mix(code, 27))
        of.append(np.repeat(np.arange(len(s)), count))
    number, of = (np.concatenate(out) >> U(64 - BITS)).astype(np.int64), np.concatenate(of)
    if model is not None and len(model.lexicon[0]):
        known, label = model.lexicon
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = np.flatnonzero(known[at] == hashes)
        number, of = np.append(number, (1 << BITS) + label[at[hit]]), np.append(of, hit)
    return number, of


@cache
def _letters() -> np.ndarray:
    """Of every code point whether its Unicode category is a letter's."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def lettered(words: Words) -> np.ndarray:
    """Whether each word holds a letter."""
    buf = words.buf
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of code points
    lead = buf[at].astype(np.int64)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        code[more] = (code[more] << 6) | (buf[at[more] + j] & 0x3F)
    sums = np.zeros(len(buf) + 1, np.int64)
    sums[at + 1] = _letters()[code]
    np.cumsum(sums, out=sums)
    return sums[words.ends] > sums[words.starts]


def _scores(model: Model, number: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, model.weights[number, k], n) for k in range(len(model.labels))], axis=1)


def _forward_backward(score: np.ndarray, edges: np.ndarray, moves: np.ndarray):
    """Word distributions of all chains at once, and what the gradient of the moves needs.

    Chains are walked side by side, the longest first, so step t works on the first so many rows; values are scaled to
    sum to one at each step.
    """
    size = np.diff(edges)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    longest = int(size.max()) if len(size) else 0
    active = np.searchsorted(-size[order], -np.arange(longest), "left")  # chains longer than t
    row = np.concatenate([[0], np.cumsum(active)])  # rows of step t follow those of the step before
    t_of = np.arange(len(score)) - np.repeat(edges[:-1], size)
    place = row[t_of] + np.repeat(rank, size)
    by_step = np.empty_like(score)
    by_step[place] = np.exp(score - score.max(axis=1, keepdims=True))
    step, ones = np.exp(moves), np.ones((moves.shape[0], 1))
    ahead, scale, back = np.empty_like(by_step), np.ones((len(by_step), 1)), np.ones_like(by_step)
    for t in range(longest):
        lo, hi, before = row[t], row[t + 1], row[t - 1] if t else 0
        a = by_step[lo:hi] if t == 0 else (ahead[before : before + hi - lo] @ step) * by_step[lo:hi]
        scale[lo:hi] = c = a @ ones
        np.divide(a, c, out=ahead[lo:hi])
    onward = by_step / scale
    for t in range(longest - 2, -1, -1):
        lo, hi = row[t + 1], row[t + 2]
        onward[lo:hi] *= back[lo:hi]
        np.matmul(onward[lo:hi], step.T, out=back[row[t] : row[t] + hi - lo])
    if longest:
        onward[: row[1]] *= back[: row[1]]
    gamma = (ahead * back)[place]
    gamma /= gamma.sum(axis=1, keepdims=True)
    alpha, onward = ahead[place], onward[place]  # onward: emission times what follows, scaled
    inner = np.ones(len(score), bool)
    inner[edges[1:] - 1] = False
    i = np.flatnonzero(inner)
    pairs = step * (alpha[i].T @ onward[i + 1])
    return gamma, pairs, i


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Penalty-free AdaGrad on the conditional likelihood of the sample's chains."""
    labels = sorted(set(langs))
    if not labels:
        return None
    words = split_words([t.encode() for t in texts], NOT_SPACE, True)
    hashes = words.hashes()
    label_of = {x: i for i, x in enumerate(labels)}
    y = np.repeat([label_of[x] for x in langs], np.diff(words.first))
    distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(which[y == k], minlength=len(distinct)) for k in range(len(labels))], axis=1)
    best = counts.argmax(axis=1)
    lexicon = np.concatenate([np.argsort(-np.where(best == k, counts[:, k], 0), kind="stable")[:LEXICON] for k in range(len(labels))])
    lexicon = np.unique(lexicon[counts[lexicon].max(axis=1) > 1])
    k = len(labels)
    model = Model(labels, np.zeros(((1 << BITS) + k, k)), np.zeros((k, k)), (distinct[lexicon], best[lexicon]))
    number, of = _features(words, sample, distinct, model)
    order = np.argsort(of, kind="stable")
    number, of = number[order], of[order]
    edges = _chains(words)
    rng = np.random.default_rng(7)
    sums, move_sums = np.full_like(model.weights, 1e-8), np.full_like(model.moves, 1e-8)
    for _ in range(EPOCHS):
        for chains in np.array_split(rng.permutation(len(edges) - 1), PARTS):
            if not len(chains):
                continue
            size = np.diff(edges)[chains]
            end = np.cumsum(size)
            at = np.repeat(edges[:-1][chains] - (end - size), size) + np.arange(end[-1])
            own, local = np.unique(which[at], return_inverse=True)
            lo, hi = np.searchsorted(of, own), np.searchsorted(of, own, "right")
            n = hi - lo
            places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            features, rows = number[places], np.repeat(np.arange(len(own)), n)
            joined = np.unique(np.append(np.concatenate([[0], end])[:: 1 + rng.integers(2, 4) - 1], end[-1]))  # twos or threes
            gamma, pairs, inner = _forward_backward(_scores(model, features, rows, len(own))[local], joined, model.moves)
            target = np.eye(k)[y[at]]
            by_word = np.stack([np.bincount(local, (target - gamma)[:, j], len(own)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(features, by_word[rows, j], len(model.weights)) for j in range(k)], axis=1) / len(chains)
            move = (target[inner].T @ target[inner + 1] - pairs) / len(chains)
            sums += grad**2
            move_sums += move**2
            model.weights += RATE * grad / np.sqrt(sums)
            model.moves += RATE * move / np.sqrt(move_sums)
    return model


def label_words(model: Model, words: Words) -> np.ndarray:
    """Language distribution of every word."""
    hashes = words.hashes()
    distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    number, of = _features(words, sample, distinct, model)
    return _forward_backward(_scores(model, number, of, len(distinct))[which], _chains(words), model.moves)[0]


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            lang, score, mixed = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
            words = split_words(texts, NOT_SPACE, True)
            if model is not None and len(words.starts):
                gamma = label_words(model, words)
                spoken = lettered(words)
                best = gamma.argmax(axis=1)
                gamma = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma * spoken[:, None], axis=0)])
                total = np.diff(gamma[words.first], axis=0)
                for i in np.flatnonzero(total.sum(axis=1) > 0).tolist():
                    k = int(total[i].argmax())
                    lang[i], score[i] = model.labels[k], min(1.0, float(total[i, k] / total[i].sum()))
                    own = slice(words.first[i], words.first[i + 1])
                    mixed[i] = int((spoken[own] & (best[own] != k)).sum())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array(lang),
                    "score": pa.array(score, pa.float64()),
                    "n_other_words": pa.array(mixed, pa.int64()),
                }
            )

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_other_words): the last counts words of another language than the text's."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, n_other_words long")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def train(docs: DataFrame) -> Model | None:
    """A model of at most ``SAMPLE`` labelled texts outside the held-out third."""
    known = docs.where("lang is not null and text is not null").where(_remainder(3) != 1)
    rows = known.select("doc_id", "text", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: whether it is held out, its language and the share of its words that have it."""
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_other_words")
