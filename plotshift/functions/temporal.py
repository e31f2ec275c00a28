"""Date expressions. Source dates are day-month-year strings with one or two digits per field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotshift.vocabulary import EPS

DAY_FIRST = "d-M-yyyy"


def parse_date(c: Column | str, strict: bool = False) -> Column:
    """String to DATE. A malformed value becomes null, or an error when ``strict``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(c, DAY_FIRST) if strict else F.try_to_date(c, DAY_FIRST)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def count_present(cols: list[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))


def mean_present(cols: list[Column]) -> Column:
    """Mean over the columns that are not null; null when all are."""
    n = count_present(cols)
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.try_divide(total, n)


def std_present(cols: list[Column]) -> Column:
    """Sample standard deviation over the columns that are not null; null below two values."""
    n, m = count_present(cols), mean_present(cols)
    ss = sum((F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def change_rate(frequency: Column, total_days: Column) -> Column:
    return frequency / (total_days + EPS)


def in_years(d: Column, first: int, last: int) -> Column:
    return F.coalesce(F.year(d).between(first, last), F.lit(False))


def epoch_seconds(d: Column) -> Column:
    return F.unix_date(d).cast("long") * 86400
