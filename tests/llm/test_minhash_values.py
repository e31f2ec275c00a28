"""Counts of retained values through packed buckets, frequent ones as rows, against plain counting; block counts by pairs and by products."""

from collections import Counter

import numpy as np
import pyarrow as pa

from plotshift.llm import minhash


def test_value_counts(spark):
    rng = np.random.default_rng(3)
    sets = {k: sorted({7, *rng.integers(-900, 900, 20).tolist(), *([11, -5] if k % 3 else [])}) for k in range(300)}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "k long, sketch array<long>").repartition(5)
    count = Counter(v for s in sets.values() for v in s)
    want = sorted((k, v, count[v]) for k, s in sets.items() for v in s if count[v] > 1)
    for n in (1, 4, 100):
        assert sorted(tuple(r) for r in minhash.value_counts(df, n).collect()) == want
    assert minhash.value_counts(df.where("false"), 4).count() == 0


def test_common_values_of_rare_and_frequent_kinds():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 60, 20), rng.integers(1000, 1400, 30)])) for _ in range(70)]
    values, row = np.concatenate(sets), np.repeat(np.arange(70), [len(s) for s in sets])
    left, right = np.arange(0, 40), np.arange(40, 70)
    got = minhash._common(values, row, 70, left, right, step=16)
    assert (got == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]).all()


def test_a_sketch_without_values_to_filter_by_is_a_candidate():
    t = pa.table({"k": [1, 2, 3], "comp": [1, 2, 3], "salt": [0, 0, 0], "sketch": pa.array([[1, 2], None, [8, 9]], pa.list_(pa.int32()))})
    out = minhash._block(4, 80, 3)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), t)
    assert sorted(zip(out["a"].to_pylist(), out["b"].to_pylist())) == [(1, 2), (2, 3)]


def test_a_pair_that_shares_many_lists_comes_out_of_one():
    """Members of equal sketches in up to six lists, each list in three block pairs: every pair that meets anywhere, once."""
    rng = np.random.default_rng(6)
    member = rng.random((30, 6)) < 0.5
    sketch = pa.array([[1, 2, 3]] * 30, pa.list_(pa.int32()))
    found = []
    for v in range(6):
        for i, j in ((0, 0), (0, 1), (1, 1)):
            at = np.flatnonzero(member[:, v] & np.isin(np.arange(30) % 2, (i, j)))
            earlier = pa.array([np.flatnonzero(member[x, :v]) for x in at], pa.list_(pa.int64()))
            t = pa.table({"k": at, "comp": at // 2, "salt": at % 2, "earlier": earlier, "sketch": sketch.take(pa.array(at))})
            out = minhash._block(4, 80, 3)((pa.scalar(v), pa.scalar(i), pa.scalar(j)), t)
            found += zip(out["a"].to_pylist(), out["b"].to_pylist())
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if a // 2 != b // 2 and (member[a] & member[b]).any()}
    assert len(found) == len(set(found)) and set(found) == want
