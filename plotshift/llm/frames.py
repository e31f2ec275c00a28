"""Helpers on DataFrames that several operators of this package use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.session import materialize

#: Words of a text as its regular expression is written in Spark SQL: everything but space and the five line and tab controls.
GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> DataFrame:
    """(number, row), stored: every row with a number of its own, its columns as ``row``, so that no name of theirs can clash."""
    whole = F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")
    return materialize(docs.select(F.monotonically_increasing_id().alias("number"), whole), "rows")


def parts(spark: SparkSession) -> int:
    """Number of tasks that a shuffle is dealt to: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: str | Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
