"""Cases in which the hidden Markov model once did less than the whole job."""

import numpy as np
import pyarrow as pa

from plotshift.llm import hmm


def test_long_texts_are_trained_on(spark):
    rows = [(i, " ".join(f"{'ab'[j % 2]}{(i * j) % 7}" for j in range(4200))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "false AS held")
    coded, counts = hmm.encode(docs)
    model, kinds = hmm.train(coded, counts), np.frombuffer(bytes(coded.first().classes), np.uint16)
    edges = np.array([0, len(kinds)])
    base = np.log10(counts.mass[kinds] / counts.all).sum()
    assert hmm.log_likelihood(model, kinds, edges)[0] > base + 1000  # a word's half follows from the word before


def test_head_is_by_exact_totals():
    """A word with a few occurrences in each of many chunks outranks one that one chunk has more often."""
    rows = [([5], [3])] * 10 + [([9, 7], [20, 1])]
    table = pa.table({k: pa.array([np.array(r[i], t).tobytes() for r in rows], pa.binary()) for i, (k, t) in enumerate((("words", np.int64), ("counts", np.int32)))})
    out = hmm._frequent(np.int32)(table.append_column("bucket", pa.array([0] * len(rows), pa.int64()))).to_pylist()
    assert [np.frombuffer(out[0][c], np.int64).tolist() for c in ("words", "counts")] == [[5, 9, 7], [30, 20, 1]]
