"""File-order windows (previous row, running total) without a single-task sort.

Row ids are cut into runs of ``2**bits`` ids. A window inside a run never sees more than that many rows; what
crosses a run (the last row before it, the total before it) comes from one summary row per run. The runs are
summarised again, ``bits`` at a time, for as many levels as the largest id needs, so no group of any level exceeds
``2**bits`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16


def _levels(df: DataFrame, order: str, bits: int) -> int:
    """Summary levels needed: one more for every factor ``2**bits`` in the number of runs. Reads the id column only."""
    widest = df.agg(F.max(F.abs(F.col(order).cast("long")))).first()[0] or 0
    return max(1, -(-((widest >> bits).bit_length()) // bits))


def _before(summary: DataFrame, bits: int, combine, levels: int) -> DataFrame:
    """Per run, the combination of all earlier runs: (run, prior). ``summary`` holds (run, value)."""
    top = levels == 1
    parent = F.lit(0).cast("long") if top else F.shiftright("run", bits)
    order = Window.partitionBy("parent").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.withColumn("parent", parent).withColumn("prior", combine(F.col("value"), order))
    if top:
        return inner.select("run", "prior")
    agg = F.max(F.struct("run", "value"))["value"] if combine is _last else F.sum("value")
    upper = summary.groupBy(F.shiftright("run", bits).alias("run")).agg(agg.alias("value"))
    outer = _before(upper, bits, combine, levels - 1).select(F.col("run").alias("parent"), F.col("prior").alias("carry"))
    joined = inner.join(outer, "parent", "left")
    merged = (
        F.coalesce("prior", "carry")
        if combine is _last
        else F.when(F.col("prior").isNotNull() | F.col("carry").isNotNull(), F.coalesce("prior", F.lit(0.0)) + F.coalesce("carry", F.lit(0.0)))
    )
    return joined.select("run", merged.alias("prior"))


def _last(value: Column, window) -> Column:
    return F.last(value).over(window)


def _total(value: Column, window) -> Column:
    return F.sum(value).over(window)


def row_change(df: DataFrame, column: str, out: str, order: str = "fid", bits: int = BITS) -> DataFrame:
    """``column`` minus its value in the previous row; 0 where either is missing."""
    run = F.shiftright(F.col(order).cast("long"), bits)
    tagged = df.withColumn("run", run)
    # The last row of a run is wrapped in a struct, so that a null value there still counts as a row.
    ends = tagged.groupBy("run").agg(F.max(F.struct(order, F.col(column).alias("v"))).alias("value"))
    before = _before(ends, bits, _last, _levels(df, order, bits))
    w = Window.partitionBy("run").orderBy(order)
    previous = F.when(F.row_number().over(w) > 1, F.lag(column).over(w)).otherwise(F.col("prior")["v"])
    joined = tagged.join(before, "run", "left")
    return joined.withColumn(out, F.coalesce(F.col(column) - previous, F.lit(0.0))).drop("run", "prior")


def running_total(df: DataFrame, column: str, out: str, order: str = "fid", bits: int = BITS) -> DataFrame:
    """Running sum in row order; a missing value stays missing and adds nothing."""
    run = F.shiftright(F.col(order).cast("long"), bits)
    tagged = df.withColumn("run", run)
    totals = tagged.groupBy("run").agg(F.sum(column).alias("value"))
    before = _before(totals, bits, _total, _levels(df, order, bits))
    w = Window.partitionBy("run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(before, "run", "left")
    total = F.sum(column).over(w) + F.coalesce("prior", F.lit(0.0))
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), total)).drop("run", "prior")
