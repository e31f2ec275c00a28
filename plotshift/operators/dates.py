"""Date operators: parsing, gaps between observation dates, calendar parts. All row-local."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotshift.functions import temporal as T
from plotshift.vocabulary import DATE_COLUMNS


def parse_dates(df: DataFrame, columns: tuple[str, ...] = DATE_COLUMNS, strict: bool = False) -> DataFrame:
    """Turn the date strings that are present into DATE columns, once."""
    present = [c for c in columns if dict(df.dtypes).get(c) == "string"]
    return df.withColumns({c: T.parse_date(c, strict) for c in present})


def with_gaps(df: DataFrame, columns: tuple[str, ...] = DATE_COLUMNS, name: str = "days_between_{i}_{j}") -> DataFrame:
    """Days between consecutive dates. Other namings: ``days_diff_{i}``, ``delta_days_{i}``."""
    return df.withColumns(
        {
            name.format(i=i, j=i + 1): T.days_between(F.col(columns[i + 1]), F.col(columns[i]))
            for i in range(len(columns) - 1)
        }
    )


def with_delta_days(df: DataFrame) -> DataFrame:
    """The variant that starts at ``date1``: ``delta_days_1..3`` and ``total_days`` from date1 to date4."""
    gaps = {f"delta_days_{i}": T.days_between(F.col(f"date{i + 1}"), F.col(f"date{i}")) for i in range(1, 4)}
    return df.withColumns({**gaps, "total_days_from_1": T.days_between(F.col("date4"), F.col("date1"))})


def with_dynamics(df: DataFrame) -> DataFrame:
    """``change_frequency``, ``change_speed``, ``total_days`` and ``change_rate``. Needs :func:`with_gaps`."""
    gaps = [F.col(f"days_between_{i}_{i + 1}") for i in range(4)]
    df = df.withColumns(
        {
            "change_frequency": T.count_present(gaps),
            "change_speed": T.mean_present(gaps),
            "total_days": T.days_between(F.col("date4"), F.col("date0")),
        }
    )
    return df.withColumn("change_rate", T.change_rate(F.col("change_frequency"), F.col("total_days")))


def with_season(df: DataFrame, first: int = 2015, last: int = 2018) -> DataFrame:
    """Month of every date and the flag of an observation inside the busy years."""
    busy = T.in_years(F.col("date0"), first, last) | T.in_years(F.col("date4"), first, last)
    months = {f"month_{c}": F.month(c) for c in DATE_COLUMNS}
    return df.withColumns({f"high_change_{first}_{last}": busy.cast("int"), **months})


def with_parts(df: DataFrame, columns: tuple[str, ...] = DATE_COLUMNS, drop: bool = True) -> DataFrame:
    """``{date}_day``, ``_month``, ``_year``; the date itself is dropped."""
    parts = {}
    for c in columns:
        parts |= {f"{c}_day": F.dayofmonth(c), f"{c}_month": F.month(c), f"{c}_year": F.year(c)}
    df = df.withColumns(parts)
    return df.drop(*columns) if drop else df


def with_epochs(df: DataFrame, columns: tuple[str, ...] = DATE_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_epoch": T.epoch_seconds(F.col(c)) for c in columns})
