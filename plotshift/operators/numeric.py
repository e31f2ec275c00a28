"""Missing values, infinities, scaling and feature selection. Fitted state is a handful of numbers per column."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotshift.operators.profile import _as_rows
from plotshift.operators.quantiles import curve, medians

INF = float("inf")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def fill_constant(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.when(is_missing(_c(c)), F.lit(value)).otherwise(_c(c)) for c in columns})


def fill_median(df: DataFrame, columns: list[str], fit: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """Missing values become the column's median in ``fit`` (by default the frame itself)."""
    values = medians(fit if fit is not None else df, columns, exact)
    return df.withColumns({c: F.when(is_missing(_c(c)), F.lit(values[c])).otherwise(_c(c)) for c in columns if c in values})


def infinite_to(df: DataFrame, columns: list[str], value: float | None) -> DataFrame:
    """Both infinities to one value; ``None`` marks them missing."""
    new = F.lit(value).cast("double")
    return df.withColumns({c: F.when(F.abs(_c(c)) == INF, new).otherwise(_c(c)) for c in columns})


def numbers_only(df: DataFrame, columns: list[str], nan: float = 0.0, high: float = 1e10, low: float = -1e10) -> DataFrame:
    """Missing to ``nan``, +inf to ``high``, -inf to ``low``."""
    return df.withColumns(
        {
            c: F.when(is_missing(_c(c)), F.lit(nan)).when(_c(c) == INF, F.lit(high)).when(_c(c) == -INF, F.lit(low)).otherwise(_c(c))
            for c in columns
        }
    )


def log_features(df: DataFrame, columns: list[str], low: float = 1e-9) -> DataFrame:
    """log(1 + max(x, low)), missing stays missing."""
    return df.withColumns(
        {c: F.log1p(F.when(_c(c).isNotNull(), F.greatest(_c(c).cast("double"), F.lit(low)))) for c in columns}
    )


def standard_scale(fit: DataFrame, apply: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, both from ``fit``; a constant column is only centred."""
    row = fit.agg(
        *[F.avg(_c(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(_c(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return apply.withColumns(
        {
            c: (_c(c) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
            if row[f"m{i}"] is not None
        }
    )


def minmax_scale(fit: DataFrame, apply: DataFrame, columns: list[str], prefix: str = "norm_") -> DataFrame:
    row = fit.agg(
        *[F.min(_c(c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(_c(c)).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    return apply.withColumns(
        {
            f"{prefix}{c}": F.try_divide(_c(c) - row[f"a{i}"], F.lit(row[f"b{i}"] - row[f"a{i}"]).cast("double"))
            for i, c in enumerate(columns)
        }
    )


def quantile_normal(fit: DataFrame, apply: DataFrame, columns: list[str], points: int = 1000) -> DataFrame:
    """Map each column to a normal distribution through its own quantile curve, clipped at the 1e-7 tails.

    The curve has ``points`` exact knots (never more than rows), a fixed-size state whatever the table holds. Values at or
    beyond the ends of the curve land on the clipped tails; a column without a number stays missing.
    """
    points = max(2, min(points, fit.count()))
    probs = [k / (points - 1) for k in range(points)]
    found: dict[str, list[float]] = {}
    for r in curve(fit, columns, points).orderBy("column", "k").collect():
        found.setdefault(r["column"], []).append(r["value"])
    grid = np.asarray(probs)
    tail = 1e-7
    normal = NormalDist()
    knots = {c: np.asarray(found.get(c, [np.nan] * points)) for c in columns}

    def to_normal(batches):
        for batch in batches:
            for c in columns:
                at = batch.schema.get_field_index(c)
                v = batch.column(at).to_numpy(zero_copy_only=False).astype(float)
                # Ties in the curve: the middle of the lower and the upper reading.
                up = np.interp(v, knots[c], grid)
                down = -np.interp(-v, -knots[c][::-1], -grid[::-1])
                mid = np.where(v <= knots[c][0], 0.0, np.where(v >= knots[c][-1], 1.0, (up + down) / 2))
                ranks, back = np.unique(np.clip(mid, tail, 1 - tail), return_inverse=True)
                out = np.array([normal.inv_cdf(p) if p == p else np.nan for p in ranks])[back]
                batch = batch.set_column(at, c, pa.array(out, pa.float64(), from_pandas=True))
            yield batch

    apply = apply.withColumns({c: _c(c).cast("double") for c in columns})
    return apply.mapInArrow(to_normal, apply.schema)


def anova_scores(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, f): between-class over within-class variance of each column.

    Mean and spread per class come from one aggregate over all columns. Spread is taken around the class mean, not as a
    difference of large squares.
    """
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(_c(c)).alias("n"),
                F.avg(_c(c)).alias("m"),
                F.var_pop(_c(c)).alias("v"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    stats = per_class.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))]))).where("n > 0")
    total = stats.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("classes"),  # one entry per class
    )
    between = F.aggregate(
        "classes", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))
    )
    f = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return total.select("column", f.alias("f"))


def select_k_best(df: DataFrame, columns: list[str], label: str, k: int) -> list[str]:
    """The ``k`` columns with the largest F score, in their original order; a constant column scores last."""
    top = anova_scores(df, columns, label).orderBy(F.desc_nulls_last("f"), "column").limit(min(k, len(columns))).collect()
    chosen = {r["column"] for r in top}
    return [c for c in columns if c in chosen]


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raise when any value is missing or infinite; otherwise return the frame unchanged."""
    bad = _as_rows(df, {c: {"bad": F.count_if(is_missing(_c(c)) | (F.abs(_c(c)) == INF))} for c in columns})
    wrong = [(r["column"], r["bad"]) for r in bad.where("bad > 0").collect()]
    if wrong:
        raise ValueError(f"missing or infinite values: {wrong}")
    return df


def assert_rows(df: DataFrame, expected: int) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, got {n}")
    return df
