"""Folds, class weights, probability ensembles and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotshift.operators.profile import with_scalar
from plotshift.session import materialize
from plotshift.vocabulary import FOLDS, SEED


def with_class_rank(df: DataFrame, label: str, key: str = "fid", seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """``class_rank`` (0-based, shuffled order or row order) and ``class_size`` within the row's class.

    A class may hold most of the table, so it is never sorted as one group. Rows are ranked inside buckets, and each
    bucket adds the size of those before. Buckets are the first digits of the shuffled order's hash, or ranges of
    row ids that a sample of the ids sets, so that ids may lie anywhere in their type; the ranges are stored with their
    rows, and their number is that of the shuffle's partitions.
    """
    if shuffle:
        token = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)))
        tagged = df.withColumns({"_token": token, "_bucket": F.substring(token, 1, 3)})
    else:
        ranged = df.repartitionByRange(key).withColumns({"_token": F.lit(""), "_bucket": F.spark_partition_id()})
        tagged = materialize(ranged, "ranges")
    sizes = tagged.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(label).alias("_label"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(label)).alias("class_size"),
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_token", key)
    ranked = tagged.withColumn("_at", F.row_number().over(inside) - 1)
    joined = ranked.join(sizes, ranked[label].eqNullSafe(sizes["_label"]) & (ranked["_bucket"] == sizes["_b"]), "left")
    return joined.withColumn("class_rank", F.col("_at") + F.col("_before")).drop(
        "_token", "_bucket", "_label", "_b", "_at", "_before"
    )


def stratified_folds(df: DataFrame, label: str, k: int = FOLDS, seed: int = SEED, shuffle: bool = True, key: str = "fid") -> DataFrame:
    """``fold`` 0..k-1; the sizes of a class in any two folds differ by at most one row."""
    df = with_class_rank(df, label, key, seed, shuffle)
    return df.withColumn("fold", (F.col("class_rank") % k).cast("int")).drop("class_rank", "class_size")


def stratified_split(df: DataFrame, label: str, share: float = 0.8, seed: int = SEED, key: str = "fid") -> DataFrame:
    """``is_train`` for the first ``share`` of every class in shuffled order."""
    df = with_class_rank(df, label, key, seed)
    return df.withColumn("is_train", F.col("class_rank") < F.ceil(F.col("class_size") * share)).drop("class_rank", "class_size")


def tail_split(df: DataFrame, share: float = 0.8, key: str = "fid") -> DataFrame:
    """Unshuffled variant: the last rows in row order validate."""
    return stratified_tail(df.withColumn("_all", F.lit(1)), share, key)


def stratified_tail(df: DataFrame, share: float, key: str) -> DataFrame:
    ranked = with_class_rank(df, "_all", key, shuffle=False)
    return ranked.withColumn("is_train", F.col("class_rank") < F.ceil(F.col("class_size") * share)).drop(
        "class_rank", "class_size", "_all"
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    over_all = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    return with_scalar(counts, over_all).select(label, "n", (F.col("_total") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_sample_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """The balanced weight of each row's class; the lookup table has one row per class."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(weights), label, "left")


def fold_average(probs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fid, model, class, p): mean over folds of a long probability table."""
    return probs.groupBy("fid", "model", "class").agg((F.sum("p") / folds).alias("p"))


def blend(probs: DataFrame, weights: list[float], models: list | None = None) -> DataFrame:
    """(fid, class, p): weighted sum of the models' probabilities. One weight per model is required."""
    models = list(range(len(weights))) if models is None else models
    if len(models) != len(weights):
        raise ValueError(f"{len(weights)} weights for {len(models)} models")
    w = F.lit(0.0)
    for m, v in zip(models, weights):
        w = F.when(F.col("model") == m, F.lit(float(v))).otherwise(w)
    return probs.groupBy("fid", "class").agg(F.sum(w * F.col("p")).alias("p"))


def _coded(column: str, classes: int) -> Column:
    """A class code that must be one of ``classes``; nothing else is dropped silently."""
    c = F.col(column)
    return F.when((c >= 0) & (c < classes), c).otherwise(F.raise_error(F.lit(f"{column} must be a code from 0 to {classes - 1}")).cast("int"))


def argmax_long(probs: DataFrame, digits: int | None = None, keys: tuple[str, ...] = ("fid",), classes: int | None = None) -> DataFrame:
    """(keys..., pred): the most probable class, the lowest one on ties. ``digits`` settles ties up to rounding.

    With ``classes`` all codes are 0 to classes - 1 (any other is an error), and a group is a row of numbers that a hash
    aggregation updates in place; otherwise the long rows are sorted.
    """
    settled = lambda p: F.round(p, digits) if digits is not None else p
    if classes is None:
        return probs.groupBy(*keys).agg(F.max_by("class", F.struct(settled(F.col("p")), -F.col("class"))).alias("pred"))
    best = [F.max(F.when(F.col("_class") == c, F.col("p"))).alias(f"_p{c}") for c in range(classes)]
    groups = probs.withColumn("_class", _coded("class", classes)).groupBy(*keys).agg(*best, F.min("_class").alias("_least"))
    first = argmax_array(F.array(*[settled(F.col(f"_p{c}")) for c in range(classes)]))
    return groups.select(*keys, F.coalesce(first, "_least").cast(probs.schema["class"].dataType).alias("pred"))


def argmax_array(p: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def blend_arrays(columns: list[Column], weights: list[float], classes: int = 6) -> Column:
    """Weighted sum of probability arrays of one row: the blend without a shuffle."""
    if len(columns) != len(weights):
        raise ValueError(f"{len(weights)} weights for {len(columns)} models")
    cell = lambda c: sum((w * F.get(p, F.lit(c)) for p, w in zip(columns[1:], weights[1:])), weights[0] * F.get(columns[0], F.lit(c)))
    return F.array(*[cell(c) for c in range(classes)])


def majority_vote(preds: DataFrame, classes: int | None = None) -> DataFrame:
    """(fid, pred): the class predicted most often, the lowest on ties. ``classes`` as in :func:`argmax_long`; null is no vote."""
    if classes is None:
        return preds.groupBy("fid").agg(F.mode("pred", True).alias("pred"))
    code = F.when(F.col("pred").isNotNull(), _coded("pred", classes))
    votes = preds.withColumn("_pred", code).groupBy("fid").agg(*[F.count_if(F.col("_pred") == c).alias(f"_n{c}") for c in range(classes)])
    n = F.array(*[F.col(f"_n{c}") for c in range(classes)])
    return votes.select("fid", F.when(F.array_max(n) > 0, argmax_array(n)).cast(preds.schema["pred"].dataType).alias("pred"))


def per_class_counts(df: DataFrame, label: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., class, tp, predicted, support) from one confusion count."""
    confusion = df.groupBy(*by, F.col(label).cast("int").alias("_l"), F.col(pred).cast("int").alias("_p")).agg(
        F.count("*").alias("_n")
    )
    hit = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("_l").alias("class"), hit.cast("long").alias("tp"), zero.alias("predicted"), F.col("_n").alias("support")),
        F.struct(F.col("_p").alias("class"), zero.alias("tp"), F.col("_n").alias("predicted"), zero.alias("support")),
    )
    return (
        confusion.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    )


def class_report(df: DataFrame, label: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = per_class_counts(df, label, pred, by)
    return c.select(
        *by,
        "class",
        zero(F.col("tp"), F.col("predicted")).alias("precision"),
        zero(F.col("tp"), F.col("support")).alias("recall"),
        zero(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def scores(df: DataFrame, label: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., accuracy, macro_f1, weighted_f1, n). Macro F1 averages over classes seen as label or prediction."""
    report = class_report(df, label, pred, by)
    return report.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("n"),
    )


def cv_summary(results: DataFrame) -> DataFrame:
    """Mean and population deviation of F1 and accuracy per model over its folds."""
    return results.groupBy("model").agg(
        F.avg("macro_f1").alias("mean_f1"),
        F.stddev_pop("macro_f1").alias("std_f1"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.count("*").alias("folds"),
    )


def best_model(summary: DataFrame, digits: int = 9) -> DataFrame:
    """The model with the best mean F1, the first name on ties."""
    return summary.orderBy(F.desc(F.round("mean_f1", digits)), "model").limit(1)
