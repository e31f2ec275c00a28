"""Alignment against a plain version on sets of ends, and galloping against set intersection."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from plotshift.llm import alignment

EDGES = [None, "", " ", "  two  blanks ", "it's <|endoftext|> we'll", "<s> <0x41> <unk>", "x▁y", "a\tb\n\nc", "é😀ﬁ　日本語", "a\0b", "0123 " * 9000, "z" * 3000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    extra = spark.createDataFrame([(None if i % 4 == 3 else 10_000 + i % 5, t) for i, t in enumerate(EDGES)], "doc_id long, text string")
    return real.union(extra).selectExpr("*", "1 AS a_ids", "'q' AS pair").cache()


def _plain(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(alignment._byte_letters())}
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = []
    for text in texts:
        left = right = []
        if text:
            left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (left, right)):
                left = right = []
        ends = []
        for side in (left, right):
            at, n = {}, 0
            for j, (_, x) in enumerate(side):
                n += len(x)
                at[n] = j
            ends.append(at)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(([x for x, _ in left[i:p]], [x for x, _ in right[j:q]]))
            i, j = p, q
        docs.append((len(left), len(right), groups))
    return docs


def test_report(docs):
    rows = docs.select("doc_id", "text").collect()
    want = _plain([r.text for r in rows])
    counts = Counter((a[-1], b[-1]) for _, _, groups in want for a, b in groups)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    expected = []
    for r, (n_a, n_b, groups) in zip(rows, want):
        linked = [counts[a[-1], b[-1]] for a, b in groups]
        best = sum(n == highest[b[-1]] for n, (_, b) in zip(linked, groups))
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        expected.append((r.doc_id, n_a, n_b, len(groups), len(groups), best, sum(linked), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    got = [tuple(r) for r in alignment.report(docs).collect()]
    assert Counter(got) == Counter(expected)
    assert sum(x[1] > 0 for x in expected) > 60 and sum(x[1] == 0 for x in expected) >= 3


def test_groups_spell_the_text(docs):
    sides = alignment.ByteLevel(alignment.vocabularies()[0]), alignment.Pieces(alignment.vocabularies()[1])
    aligned = alignment.align(docs)
    assert aligned.columns == ["doc_id", "text", "pair", *alignment.COLUMNS]
    for r in alignment.groups(aligned).collect():
        whole = {b"".join(side.bytes[i] for g in r.groups for i in g[k]) for k, side in enumerate(sides)}
        assert whole in ({b""}, {(" " + (r.text or "")).encode()})
        assert all(g.a and g.b for g in r.groups)


@pytest.mark.parametrize("run", [1, 7, 1024])
def test_gallop(monkeypatch, run):
    monkeypatch.setattr(alignment, "RUN", run)
    rng = random.Random(3)
    for n, m in ((0, 5), (5, 0), (1, 1000), (40, 1000), (300, 300), (1000, 3)):
        a, b = sorted(rng.sample(range(2000), n)), sorted(rng.sample(range(2000), m))
        both = sorted(set(a) & set(b))
        for find in (alignment.gallop, alignment.common_ends):
            i, j = find(alignment.np.array(a, int), alignment.np.array(b, int))
            assert [a[x] for x in i] == both == [b[x] for x in j]


def test_digest_in_blocks(monkeypatch):
    np = alignment.np
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 4, 50), rng.integers(1, 4, 50)
    a, b = rng.integers(0, 60000, n_a.sum()), rng.integers(0, 60000, n_b.sum())
    whole = alignment._spelled(a, b, n_a, n_b)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    assert alignment._spelled(a, b, n_a, n_b) == whole
    parts = [f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in zip(np.split(a, n_a.cumsum()[:-1]), np.split(b, n_b.cumsum()[:-1]))]
    assert whole == hashlib.sha256(";".join(parts).encode()).hexdigest()


def test_slices(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 5)
    batch = alignment.pa.RecordBatch.from_pydict({"a_ends": alignment.pa.array([b"", b"123", b"12", b"1234567", b"", b"1"])})
    parts = [p.column("a_ends").to_pylist() for p in alignment._slices(batch)]
    assert parts == [[b"", b"123", b"12"], [b"1234567"], [b"", b"1"]]


def test_empty_table(docs):
    assert alignment.report(docs.limit(0)).count() == 0
