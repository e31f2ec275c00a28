"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotshift.session import materialize


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """Write the narrow table that several passes follow on, instead of measuring every polygon once per pass."""
    return materialize(df.select(*columns), "measures")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, so that engines that add in another order agree."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Nullable integers and flags as DOUBLE, so that a missing value looks the same in every client."""
    return df.withColumns({c: F.col(c).cast("int").cast("double") if t == "boolean" else F.col(c).cast("double") for c, t in df.dtypes if c in columns})
