"""Random order and shards of equal row counts by a two-pass external shuffle.

1. Scatter. Rows are numbered and stored once in the shared folder with their size, which pins the numbers whatever task is
   run again. A seeded hash of the number deals each row to one of as many buckets as keep a bucket near ``BUCKET_BYTES``;
   a number, not an id or a text, so equal rows and null ids spread like any others. The buckets' row counts are taken from
   the narrow columns alone, and their running sums (in two levels, so that no task sees all buckets) are where each bucket
   begins in the new order.
2. Shuffle. Each bucket is gathered by one task, brought into the order of its numbers, put through a Fisher-Yates shuffle
   seeded by the seed and the bucket, and given its places. Texts move through the network once.

Every order is equally likely but for the hash: buckets are drawn independently per row, and inside a bucket all orders
are equally likely. Places are cut into shards at ``s * rows / shards``, so counts differ by one at most and a shard is a run
of neighbouring buckets; the slot is the place inside the shard.

Defined cases: null and empty texts are rows like others; repeated rows stay; a text above ``BUCKET_BYTES`` makes its bucket
larger, never others; fewer rows than shards leave shards empty; an empty table gives no rows; every column of the table
stays, and ``shard`` and ``slot`` replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotshift.llm.frames import parts
from plotshift.session import materialize

SHARDS = 40
SEED = 20240611
#: Bytes of text that a bucket holds on average: what one task shuffles in memory.
BUCKET_BYTES = 8 << 20
#: Buckets whose counts one task adds up.
GROUP = 4096


def _fisher_yates(seed: int, shards: int, schema: T.StructType):
    names = [f.name for f in schema.fields if f.name not in ("shard", "slot")]

    def run(key: tuple, rows: pa.Table, at: pa.Table) -> pa.Table:
        rows = rows.sort_by("number_")
        order = np.arange(len(rows))
        np.random.default_rng([seed, key[0].as_py()]).shuffle(order)
        n, first = at.column("rows_")[0].as_py(), at.column("first_")[0].as_py()
        place = first + np.arange(len(rows), dtype=np.int64)
        # the shard of a place is the last whose begin, s * n // shards, is not behind it
        begins = np.array([s * n // shards for s in range(shards + 1)], np.int64)
        shard = np.searchsorted(begins, place, "right") - 1
        shuffled = dict(zip(names, rows.column("row_").take(pa.array(order)).combine_chunks().flatten()))
        return pa.table(shuffled | {"shard": pa.array(shard, pa.int32()), "slot": pa.array(place - begins[shard], pa.int64())})

    return run


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` in random order, as ``shard`` and ``slot`` (from 0, without gaps) beside all its columns."""
    fields = [f for f in docs.schema.fields if f.name not in ("shard", "slot")]
    row = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row_")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("size_")
    stored = materialize(docs.select(F.monotonically_increasing_id().alias("number_"), size, row), "numbered")
    total = stored.agg(F.sum("size_").alias("bytes"), F.count("*").alias("n")).first()
    buckets = max(parts(docs.sparkSession), -(-(total["bytes"] or 0) // bucket_bytes))
    dealt = stored.withColumn("bucket_", F.pmod(F.xxhash64("number_", F.lit(seed)), F.lit(buckets)))

    counts = dealt.groupBy("bucket_").agg(F.count("*").alias("n")).withColumn("group_", F.expr(f"bucket_ div {GROUP}"))
    before = Window.orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4096 buckets
    groups = counts.groupBy("group_").agg(F.sum("n").alias("n")).select("group_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "group_")
    begins = begins.select(F.col("bucket_").alias("at_"), (F.col("base") + F.col("inside")).alias("first_"), F.lit(total["n"]).alias("rows_"))

    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    gathered = dealt.select("bucket_", "number_", "row_").groupBy("bucket_").cogroup(begins.groupBy("at_"))
    return gathered.applyInArrow(_fisher_yates(seed, shards, schema), schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; a file of it holds its slots in ascending order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its size, checksum, shard and slot, under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffled_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shards).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
