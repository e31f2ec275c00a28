"""Data-quality profiling: one pass over the table per report, reports come back as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotshift.vocabulary import STATUS_COLUMNS


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Rows per value, nulls left out, most frequent first; ``share`` is added when ``normalize``."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if normalize:
        total = df.agg(F.count(column).alias("total"))
        counts = with_scalar(counts, total).withColumn("share", F.col("n") / F.col("total")).drop("total")
    return counts.orderBy(F.desc("n"), column)


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})


def _as_rows(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over all columns, turned into one row per column: ``measures[column][measure] = aggregate``."""
    agg = [
        F.struct(F.lit(c).alias("column"), *[e.alias(m) for m, e in ms.items()]).alias(f"_{i}")
        for i, (c, ms) in enumerate(measures.items())
    ]
    flat = df.agg(*agg)
    return flat.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(agg))])))


def null_counts(df: DataFrame) -> DataFrame:
    return _as_rows(df, {c: {"missing": F.count_if(F.col(c).isNull())} for c in df.columns})


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percentage, worst first."""
    rows = _as_rows(
        df,
        {
            c: {"missing": F.count_if(F.col(c).isNull()), "percentage": 100 * F.count_if(F.col(c).isNull()) / F.count("*")}
            for c in df.columns
        },
    )
    return rows.where("missing > 0").orderBy(F.desc("percentage"), "column")


def nonpositive_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return _as_rows(df, {c: {"nonpositive": F.count_if(F.col(c) <= 0)} for c in columns})


def nonfinite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return _as_rows(
        df,
        {
            c: {
                "nan": F.count_if(F.isnan(c) | F.col(c).isNull()),
                "inf": F.count_if(F.abs(F.col(c)) == float("inf")),
            }
            for c in columns
        },
    )


def type_report(df: DataFrame) -> DataFrame:
    """Column, Spark type, non-null count and row count."""
    types = dict(df.dtypes)
    return _as_rows(
        df,
        {
            c: {"type": F.first(F.lit(types[c])), "present": F.count(c), "rows": F.count("*")}
            for c in df.columns
        },
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per numeric column."""
    from plotshift.operators.quantiles import quantiles

    columns = columns or numeric_columns(df)
    base = _as_rows(
        df,
        {
            c: {
                "count": F.count(c),
                "mean": F.avg(c),
                "std": F.stddev_samp(c),
                "min": F.min(c).cast("double"),
                "max": F.max(c).cast("double"),
            }
            for c in columns
        },
    )
    q = quantiles(df, columns, (0.25, 0.5, 0.75))
    q = q.groupBy("column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return base.join(F.broadcast(q), "column", "left")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for every distinct non-null value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null").distinct()


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    return _as_rows(df, {c: {"min": F.min(c), "max": F.max(c)} for c in columns})


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between the column's own extremes; the maximum belongs to the last bin."""
    bounds = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = F.col(column)
    df = with_scalar(df.where(v.isNotNull()), bounds)
    at = F.least(F.floor(F.try_divide((v - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return df.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts on a bins x bins grid over the extremes of both columns."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    bounds = df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    df = with_scalar(df, bounds)

    def bin_of(c: str, lo: str, hi: str) -> Column:
        at = F.floor(F.try_divide((F.col(c) - F.col(lo)) * bins, F.col(hi) - F.col(lo)))
        return F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")

    return df.groupBy(*by, bin_of(x, "_x0", "_x1").alias("x_bin"), bin_of(y, "_y0", "_y1").alias("y_bin")).agg(
        F.count("*").alias("n")
    )


def box_stats(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group and column: quartiles, extremes, and the whisker ends (outermost values within 1.5 IQR of the box)."""
    from plotshift.operators.quantiles import long_form, quantiles

    q = quantiles(df, columns, (0.25, 0.5, 0.75), by=(by,))
    q = q.groupBy(by, "column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    rows = long_form(df, columns, (by,)).join(F.broadcast(q), [by, "column"])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("value").between(F.col("q25") - reach, F.col("q75") + reach)
    return rows.groupBy(by, "column", "q25", "q50", "q75").agg(
        F.count("*").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def status_transitions(df: DataFrame, columns: tuple[str, ...] = STATUS_COLUMNS) -> DataFrame:
    """How often one status follows another on consecutive dates."""
    steps = F.array(*[F.struct(F.col(a).alias("from_status"), F.col(b).alias("to_status")) for a, b in zip(columns, columns[1:])])
    pairs = df.select(F.inline(steps)).where("from_status is not null and to_status is not null")
    return pairs.groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


def with_status_changes(df: DataFrame, columns: tuple[str, ...] = STATUS_COLUMNS) -> DataFrame:
    """``n_changes``: consecutive dates whose known statuses differ."""
    changed = [F.coalesce((F.col(a) != F.col(b)).cast("int"), F.lit(0)) for a, b in zip(columns, columns[1:])]
    return df.withColumn("n_changes", sum(changed[1:], changed[0]))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "fid") -> DataFrame:
    """A repeatable sample of ``n`` rows."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(key), F.lit(seed))), key).limit(n)


def head(df: DataFrame, n: int, key: str = "fid") -> DataFrame:
    """The first ``n`` rows by row id."""
    return df.orderBy(key).limit(n)
