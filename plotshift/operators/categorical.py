"""Categorical encoders. Fitted ones take ``(fit, apply)`` frames, so nothing leaks from rows that must stay unseen."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotshift.operators.profile import with_scalar
from plotshift.vocabulary import CHANGE_TYPES, STATUS_COLUMNS

# One column per level is only sensible for small vocabularies; larger ones belong in a sparse vector.
MAX_LEVELS = 2_000
MISSING = "None"


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def with_interaction(df: DataFrame, a: str = "urban_type", b: str = "geography_type", out: str = "urban_geo_interaction") -> DataFrame:
    """``a_b``; missing when either part is."""
    return df.withColumn(out, F.concat(F.col(a), F.lit("_"), F.col(b)))


def missing_as_category(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(MISSING)) for c in columns})


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values; null is its own level and sorts last. Refuses to become wider than ``MAX_LEVELS``."""
    levels = df.select(F.col(column).alias("v")).distinct().limit(MAX_LEVELS + 1).collect()
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels, use one_hot_vector")
    known = sorted(r["v"] for r in levels if r["v"] is not None)
    return known + [None] * (len(known) < len(levels))


def one_hot(df: DataFrame, column: str, levels: list[str], prefix: str | None = None) -> DataFrame:
    """A 0/1 column per level, named ``{prefix}_{level}``. A value outside ``levels`` gives zeros everywhere."""
    prefix = column if prefix is None else prefix
    return df.withColumns(
        {
            f"{prefix}_{MISSING if v is None else v}": F.col(column).eqNullSafe(F.lit(v)).cast("int")
            for v in levels
        }
    )


def one_hot_union(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary from both frames, null included."""
    levels = vocabulary(train.select(column).unionByName(test.select(column)), column)
    return one_hot(train, column, levels), one_hot(test, column, levels)


def one_hot_train(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary from the training frame; unknown test values become all zeros."""
    levels = vocabulary(train, column)
    return one_hot(train, column, levels), one_hot(test, column, levels)


def one_hot_vector(fit: DataFrame, column: str, out: str):
    """Sparse-vector alternative for wide vocabularies: a fitted pipeline of indexer and encoder."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = StringIndexer(inputCol=column, outputCol=f"{out}_index", handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCol=f"{out}_index", outputCol=out, dropLast=False)
    return Pipeline(stages=[index, encode]).fit(fit)


def dummies(df: DataFrame, column: str) -> DataFrame:
    """One-hot with the frame's own vocabulary; null gets no column."""
    return one_hot(df, column, [v for v in vocabulary(df, column) if v is not None])


def align_outer(a: DataFrame, b: DataFrame, key: str = "fid") -> tuple[DataFrame, DataFrame]:
    """Give both frames the union of their columns, in name order, new ones filled with 0."""
    names = sorted((set(a.columns) | set(b.columns)) - {key})

    def fill(df: DataFrame) -> DataFrame:
        return df.select(key, *[named(c) if c in df.columns else F.lit(0).alias(c) for c in names])

    return fill(a), fill(b)


def align_left(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with exactly the training columns: missing ones 0, extra ones dropped."""
    return test.select(*[named(c) if c in test.columns else F.lit(0).alias(c) for c in train.columns])


def split_labels(column: str, fill: str | None = "Unknown", trim: bool = False) -> Column:
    """Comma-joined labels to an array. ``fill=None`` leaves null null."""
    c = F.col(column) if fill is None else F.coalesce(F.col(column), F.lit(fill))
    parts = F.split(c, ",")
    return F.transform(parts, F.trim) if trim else parts


def multilabel(
    fit: DataFrame, apply: DataFrame, column: str, prefix: str, fill: str | None = "Unknown", trim: bool = False, whole: bool = False
) -> DataFrame:
    """A 0/1 column per label seen in ``fit``; names are stripped, labels differing only in blanks share the name's column.

    ``whole`` takes the entire value as a single label.
    """
    labels = (lambda: F.array(F.col(column))) if whole else (lambda: split_labels(column, fill, trim))
    exploded = fit.select(F.explode(labels()).alias("label"))
    groups: dict[str, list[str]] = {}
    for v in vocabulary(exploded, "label"):
        if v is not None:
            groups.setdefault(v.strip(), []).append(v)
    df = apply.withColumn("_labels", labels())
    out = {
        f"{prefix}_{name}": F.coalesce(
            F.arrays_overlap("_labels", F.array(*[F.lit(v) for v in vs])), F.lit(False)
        ).cast("int")
        for name, vs in groups.items()
    }
    return df.withColumns(out).drop("_labels")


def frequency_encode(fit: DataFrame, apply: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Share of each value among the non-null values of ``fit``; unseen values stay null."""
    counts = fit.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    shares = with_scalar(counts, fit.agg(F.count(column).alias("_total"))).select(
        column, (F.col("_n") / F.col("_total")).alias(out or f"{column}_freq")
    )
    return apply.join(shares, column, "left")


def target_encode(
    fit: DataFrame,
    apply: DataFrame,
    column: str,
    target: str,
    out: str | None = None,
    min_leaf: float = 20.0,
    smoothing: float = 10.0,
    additive: bool = False,
) -> DataFrame:
    """Mean class code per category, pulled towards the overall mean where a category is rare; unseen gives the mean.

    The weight of a category with n rows is 1/(1+exp(-(n-min_leaf)/smoothing)), or n/(n+smoothing) when ``additive``.
    """
    key = F.coalesce(F.col(column), F.lit(MISSING))
    prior = fit.agg(F.avg(target).alias("_prior"))
    stats = fit.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.avg(target).alias("_mean"))
    n = F.col("_n")
    weight = n / (n + smoothing) if additive else 1 / (1 + F.exp(-(n - min_leaf) / smoothing))
    stats = with_scalar(stats, prior).select(
        "_key", (weight * F.col("_mean") + (1 - weight) * F.col("_prior")).alias("_code")
    )
    joined = with_scalar(apply.withColumn("_key", key).join(stats, "_key", "left"), prior)
    return joined.withColumn(out or f"{column}_te", F.coalesce("_code", "_prior")).drop("_key", "_code", "_prior")


def status_codes(frames: list[DataFrame], columns: tuple[str, ...] = STATUS_COLUMNS) -> DataFrame:
    """(value, code): every status of any column and frame, numbered in alphabetical order."""
    union = None
    for df in frames:
        values = df.select(F.explode(F.array(*columns)).alias("value"))
        union = values if union is None else union.unionByName(values)
    distinct = union.where("value is not null").distinct()
    # The vocabulary of statuses is tiny, so numbering it in one task is fine.
    return distinct.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("code"))


def encode_statuses(df: DataFrame, codes: DataFrame, columns: tuple[str, ...] = STATUS_COLUMNS) -> DataFrame:
    """Replace statuses by their codes. The codes become one map literal, so that five columns need no join."""
    mapping = {r["value"]: r["code"] for r in codes.limit(MAX_LEVELS + 1).collect()}
    if len(mapping) > MAX_LEVELS:
        raise ValueError("too many statuses for a literal map")
    lookup = literal_map(mapping)
    return df.withColumns({c: F.try_element_at(lookup, F.col(c)) for c in columns})


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def label_code(column: str = "change_type", strict: bool = False, mapping: dict = CHANGE_TYPES) -> Column:
    """Class name to code; an unknown name gives null, or an error when ``strict``."""
    code = F.try_element_at(literal_map(mapping), F.col(column))
    if not strict:
        return code
    return F.when(code.isNotNull(), code).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column), F.lit("null")))).cast("int")
    )


def label_encode(fit: DataFrame, column: str = "change_type", out: str = "label"):
    """Alphabetical codes; returns the fitted model and the transformer that turns codes back into names."""
    from pyspark.ml.feature import IndexToString, StringIndexer

    model = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc").fit(fit)
    return model, IndexToString(inputCol=out, outputCol=f"{out}_name", labels=model.labels)


def label_one_hot(column: str, classes: int = 6) -> Column:
    return F.array(*[(F.col(column) == c).cast("double") for c in range(classes)])


def with_absent(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add only those derived columns that the frame lacks."""
    return df.withColumns({name: value for name, value in columns.items() if name not in df.columns})


def plain_names(df: DataFrame) -> DataFrame:
    """Column names stripped, with anything but letters, digits and underscores replaced; clashes get a number."""
    names: list[str] = []
    for c in df.columns:
        base = name = re.sub(r"\W", "_", str(c).strip())
        n = 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return df.toDF(*names)
