"""Many small records of one task as few rows: records are dealt to buckets by hash and packed into arrays.

A word window as a row of its own costs several times its eight bytes in a shuffle. Here a task packs the windows of a
few megabytes of text into one row per bucket: document keys, windows per document, and flat arrays. A row holds at least
one record, so at any size the volume stays in proportion to the records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.llm.frames import parts

#: Bytes of text whose windows one bucket receives.
BUCKET_BYTES = 16 << 20


def buckets(docs: DataFrame) -> int:
    """Number of buckets: one per ``BUCKET_BYTES`` of text, and at least one per shuffle partition."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(parts(docs.sparkSession), -(-size // BUCKET_BYTES))


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def deal(bucket: np.ndarray, keys: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket with its records in their order; ``keys`` (document keys) must be in runs."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    starts, sizes = runs(bucket)
    out: dict[str, list[bytes]] = {k: [] for k in ("keys", "counts", *arrays)}
    for lo, n in zip(starts.tolist(), sizes.tolist()):
        s, c = runs(keys[lo : lo + n])
        out["keys"].append(keys[lo : lo + n][s].tobytes())
        out["counts"].append(c.astype(np.int32).tobytes())
        for k, v in arrays.items():
            out[k].append(v[lo : lo + n].tobytes())
    return pa.RecordBatch.from_pydict(
        {"bucket": pa.array(bucket[starts].astype(np.int64)), **{k: pa.array(v, pa.binary()) for k, v in out.items()}}
    )


def joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The arrays of one column behind each other."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def record_keys(table: pa.Table) -> np.ndarray:
    """The document key of every record."""
    return np.repeat(joined(table, "keys", np.int64), joined(table, "counts", np.int32))


def by_key(keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row per document key with its values; ``keys`` in runs."""
    starts, sizes = runs(keys)
    return pa.table(
        {
            "k": pa.array(keys[starts], pa.int64()),
            "found": pa.array([values[lo : lo + n].tobytes() for lo, n in zip(starts.tolist(), sizes.tolist())], pa.binary()),
        }
    )
