"""Registered queries over fitted and aggregating operators: profiling, encoders, scaling, folds, ensembles, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.operators import bands, categorical, dates, evaluate, numeric, profile, shapes
from plotshift.plans.common import as_doubles, rounded, stored
from plotshift.sources.parcels import model_probabilities, parcels
from plotshift.vocabulary import CHANGE_TYPES, STATUS_COLUMNS

BLEND_WEIGHTS = [0.4, 0.3, 0.3]
CLASSES = len(CHANGE_TYPES)
MEASURES = ["area", "perimeter", "bounding_width", "bounding_height"]


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter, box sides and band/date numbers per parcel: the numeric table the fitted operators work on."""
    df = shapes.with_bounds(shapes.with_core(parcels(spark, sf_dir)))
    df = dates.with_gaps(dates.parse_dates(df))
    gaps = [f"days_between_{i}_{i + 1}" for i in range(4)]
    df = df.withColumns({c: F.col(c).cast("double") for c in gaps})
    return df.select(
        "fid", "split", "lab", "change_type", *MEASURES, *gaps, "img_red_mean_date1", "img_green_std_date2"
    )


NUMBERS = [*MEASURES, *[f"days_between_{i}_{i + 1}" for i in range(4)], "img_red_mean_date1", "img_green_std_date2"]


def frames(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False)
    return df.where("split = 'train'"), df.where("split = 'test'")


def profile_nulls(spark, sf_dir):
    return rounded(profile.missing_report(parcels(spark, sf_dir).drop("lab", "split")))


def profile_null_counts(spark, sf_dir):
    return profile.null_counts(parcels(spark, sf_dir).drop("lab", "split"))


def profile_numbers(spark, sf_dir):
    df = measured(spark, sf_dir)
    a = profile.nonpositive_counts(df, MEASURES)
    b = profile.nonfinite_counts(df, NUMBERS)
    return as_doubles(b.join(a, "column", "left").select("column", "nan", "inf", "nonpositive"), "nonpositive")


def profile_describe(spark, sf_dir):
    return rounded(profile.describe(stored(measured(spark, sf_dir), *NUMBERS), NUMBERS))


def describe_lineitem(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(profile.describe(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def profile_types(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", "change_type", "urban_type", "date0", "img_red_mean_date1")
    return profile.type_report(df)


def profile_distinct(spark, sf_dir):
    return profile.distinct_values(parcels(spark, sf_dir, geometry=False), ["change_type", "urban_type", "geography_type", *STATUS_COLUMNS])


def value_shares(spark, sf_dir):
    return rounded(profile.value_counts(parcels(spark, sf_dir, geometry=False), "change_type", normalize=True))


def min_max_columns(spark, sf_dir):
    return rounded(profile.min_max(measured(spark, sf_dir), NUMBERS))


def class_weights(spark, sf_dir):
    return rounded(evaluate.class_weights(parcels(spark, sf_dir, "train", geometry=False), "change_type"))


def sample_weights(spark, sf_dir):
    df = evaluate.with_sample_weights(parcels(spark, sf_dir, "train", geometry=False).select("fid", "change_type"), "change_type")
    return rounded(df.select("fid", "weight"))


def shape_measures(spark, sf_dir):
    df = shapes.with_hull(shapes.with_shape(shapes.with_core(parcels(spark, sf_dir).select("fid", "lab", "rings"))))
    return df.withColumns({"log_area": F.log1p("area"), "log_perimeter": F.log1p("perimeter")}).drop("rings")


def box_stats(spark, sf_dir):
    columns = ["log_area", "log_perimeter", "convexity", "solidity"]
    df = stored(shape_measures(spark, sf_dir), "lab", *columns)
    return rounded(profile.box_stats(df, "lab", columns))


def hist_hull_ratio(spark, sf_dir):
    df = stored(shape_measures(spark, sf_dir).withColumn("solidity", F.round("solidity", 9)), "solidity")
    return profile.histogram(df, "solidity")


def hist2d_shape(spark, sf_dir):
    df = shape_measures(spark, sf_dir).withColumns(
        {"elongation_shape": F.round("elongation_shape", 9), "compactness": F.round("compactness", 9)}
    )
    df = stored(df, "lab", "elongation_shape", "compactness")
    return profile.histogram_2d(df, "elongation_shape", "compactness", by=("lab",))


def preview_sample(spark, sf_dir):
    """Three repeatable rows and the first hundred."""
    df = parcels(spark, sf_dir, geometry=False).select("fid", "urban_type", "date0")
    picked = profile.sample_rows(df, 3).withColumn("part", F.lit("sample"))
    return picked.unionByName(profile.head(df, 100).withColumn("part", F.lit("head")))


def cat_interaction(spark, sf_dir):
    df = categorical.with_interaction(parcels(spark, sf_dir, geometry=False))
    return df.select("fid", "urban_geo_interaction")


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def cat_onehot_union(spark, sf_dir):
    train, test = (categorical.with_interaction(f).select("fid", "urban_geo_interaction") for f in frames(spark, sf_dir))
    return _both(*categorical.one_hot_union(train, test, "urban_geo_interaction")).drop("urban_geo_interaction")


def cat_onehot_train(spark, sf_dir):
    train, test = (categorical.missing_as_category(f.select("fid", "geography_type"), ["geography_type"]) for f in frames(spark, sf_dir))
    return _both(*categorical.one_hot_train(train, test, "geography_type")).drop("geography_type")


def cat_dummies_aligned(spark, sf_dir):
    train, test = (categorical.dummies(f.select("fid", "urban_type"), "urban_type").drop("urban_type") for f in frames(spark, sf_dir))
    return _both(*categorical.align_outer(train, test))


def cat_dummies_filled(spark, sf_dir):
    train, test = (
        categorical.dummies(f.select("fid", "change_status_date0"), "change_status_date0").drop("change_status_date0")
        for f in frames(spark, sf_dir)
    )
    return _both(train, categorical.align_left(train, test))


def cat_multilabel(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", "split", "urban_type", "geography_type")
    train = df.where("split = 'train'")
    df = categorical.multilabel(train, df, "urban_type", "urban")
    df = categorical.multilabel(train, df, "geography_type", "geo")
    return df.drop("split", "urban_type", "geography_type")


def cat_multilabel_whole(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", "split", "urban_type", "geography_type")
    train = df.where("split = 'train'")
    df = categorical.multilabel(train, df, "urban_type", "urban", whole=True)
    df = categorical.multilabel(train, df, "geography_type", "geo", fill=None)
    return df.drop("split", "urban_type", "geography_type")


def cat_frequency(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", "split", "urban_type", "geography_type")
    train = df.where("split = 'train'")
    out = categorical.frequency_encode(train, df, "urban_type")
    out = categorical.frequency_encode(train, out, "geography_type")
    return rounded(out.select("fid", "urban_type_freq", "geography_type_freq"))


def cat_target(spark, sf_dir):
    df = categorical.with_interaction(parcels(spark, sf_dir, geometry=False)).select(
        "fid", "split", "urban_geo_interaction", categorical.label_code().alias("code")
    )
    train = df.where("split = 'train'")
    out = categorical.target_encode(train, df, "urban_geo_interaction", "code", "te")
    out = categorical.target_encode(train, out, "urban_geo_interaction", "code", "te_additive", additive=True)
    return rounded(out.select("fid", "te", "te_additive"))


def cat_target_customer(spark, sf_dir):
    """Order price per customer, smoothed: an encoding with as many levels as customers."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("fid"), F.col("o_custkey").cast("string").alias("cust"), "o_totalprice"
    )
    return rounded(categorical.target_encode(df, df, "cust", "o_totalprice", "te").select("fid", "te"), 2)


def cat_status_codes(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", "split", *STATUS_COLUMNS)
    codes = categorical.status_codes([df.where("split = 'train'"), df.where("split = 'test'")])
    return as_doubles(categorical.encode_statuses(df, codes).drop("split"), *STATUS_COLUMNS)


def label_map(spark, sf_dir):
    df = parcels(spark, sf_dir, "train", geometry=False)
    return df.select("fid", categorical.label_code(strict=True).alias("code"))


def label_alpha(spark, sf_dir):
    df = parcels(spark, sf_dir, "train", geometry=False).select("fid", "change_type")
    model, back = categorical.label_encode(df)
    return back.transform(model.transform(df)).select("fid", F.col("label").cast("int").alias("label"), "label_name")


def label_onehot(spark, sf_dir):
    df = parcels(spark, sf_dir, geometry=False).select("fid", categorical.label_one_hot("lab").alias("h"))
    back = evaluate.argmax_array(F.col("h")).alias("label")
    return df.select("fid", *[F.get("h", F.lit(c)).cast("int").alias(f"class_{c}") for c in range(6)], back)


def fill_median(spark, sf_dir):
    df = stored(measured(spark, sf_dir), "fid", "split", *NUMBERS)
    train = df.where("split = 'train'")
    own = numeric.fill_median(df, NUMBERS).select("fid", *NUMBERS)
    fitted = numeric.fill_median(df, ["area", "days_between_0_1"], fit=train)
    fitted = fitted.select("fid", F.col("area").alias("area_train"), F.col("days_between_0_1").alias("gap_train"))
    return rounded(own.join(fitted, "fid"))


def fill_const_inf(spark, sf_dir):
    """Raw w/h and its inverse with infinities from zero sides, treated in each of the three ways."""
    df = shapes.with_bounds(parcels(spark, sf_dir).select("fid", "rings")).select(
        "fid",
        F.when(F.col("bounding_width") % 7 == 0, float("inf")).otherwise(F.col("bounding_width")).alias("a"),
        F.when(F.col("bounding_height") % 5 == 0, float("-inf")).otherwise(F.col("bounding_height")).alias("b"),
    )
    df = stored(df, "fid", "a", "b")
    cols = ["a", "b"]
    zero = numeric.fill_constant(numeric.infinite_to(df, cols, 0.0), cols)
    median = numeric.fill_median(numeric.infinite_to(df, cols, None), cols)
    clamp = numeric.numbers_only(df, cols)
    out = zero.join(median.select("fid", F.col("a").alias("a_median"), F.col("b").alias("b_median")), "fid")
    return rounded(out.join(clamp.select("fid", F.col("a").alias("a_clamped"), F.col("b").alias("b_clamped")), "fid"))


def scale_std(spark, sf_dir):
    df = stored(measured(spark, sf_dir), "fid", "split", *NUMBERS)
    return rounded(numeric.standard_scale(df.where("split = 'train'"), df, NUMBERS).select("fid", *NUMBERS))


def scale_minmax(spark, sf_dir):
    df = measured(spark, sf_dir)
    out = numeric.minmax_scale(df, df, ["area", "perimeter"])
    return rounded(out.select("fid", "norm_area", "norm_perimeter"))


def scale_quantile(spark, sf_dir):
    df = stored(measured(spark, sf_dir), "fid", "area", "days_between_0_1")
    return rounded(numeric.quantile_normal(df, df, ["area", "days_between_0_1"]))


def log_features(spark, sf_dir):
    return rounded(numeric.log_features(measured(spark, sf_dir).select("fid", *MEASURES), MEASURES))


def select_anova(spark, sf_dir):
    df = stored(measured(spark, sf_dir).where("split = 'train'"), "lab", *NUMBERS)
    scores = numeric.anova_scores(df, NUMBERS, "lab")
    best = numeric.select_k_best(df, NUMBERS, "lab", 5)
    return rounded(scores.select("column", "f", F.col("column").isin(best).cast("int").alias("selected")), 4)


def anova_lineitem(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(numeric.anova_scores(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag"), 4)


def folds_stratified(spark, sf_dir):
    df = parcels(spark, sf_dir, "train", geometry=False).select("fid", "lab")
    return evaluate.stratified_folds(df, "lab").select("fid", "fold")


def folds_in_order(spark, sf_dir):
    df = parcels(spark, sf_dir, "train", geometry=False).select("fid", "lab")
    return evaluate.stratified_folds(df, "lab", shuffle=False).select("fid", "fold")


def folds_sparse_ids(spark, sf_dir):
    """Folds in the order of ids that lie all over the BIGINT range."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "((l_orderkey * 8 + l_linenumber) * 1000003 % 4294967291 - 2147483645) * 4294967296 AS id", "l_returnflag"
    )
    return evaluate.stratified_folds(df, "l_returnflag", shuffle=False, key="id").select("id", "fold")


def folds_lineitem(spark, sf_dir):
    """Fold sizes per return flag."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), "l_returnflag"
    )
    folds = evaluate.stratified_folds(df, "l_returnflag")
    return folds.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n"))


def split_stratified(spark, sf_dir):
    df = parcels(spark, sf_dir, "train", geometry=False).select("fid", "lab")
    a = evaluate.stratified_split(df, "lab").select("fid", "is_train")
    b = evaluate.tail_split(df).select("fid", F.col("is_train").alias("is_train_tail"))
    return a.join(b, "fid")


def fold_average(spark, sf_dir):
    return rounded(evaluate.fold_average(model_probabilities(spark, sf_dir)))


def blend_argmax(spark, sf_dir):
    average = evaluate.fold_average(model_probabilities(spark, sf_dir))
    return evaluate.argmax_long(evaluate.blend(average, BLEND_WEIGHTS), digits=9, classes=CLASSES)


def fold_argmax(spark, sf_dir):
    """Most probable class per model and fold."""
    return evaluate.argmax_long(model_probabilities(spark, sf_dir), 9, ("fid", "model", "fold"), CLASSES)


def majority_vote(spark, sf_dir):
    preds = evaluate.argmax_long(model_probabilities(spark, sf_dir), 9, ("fid", "model", "fold"), CLASSES)
    return evaluate.majority_vote(preds, CLASSES)


def _predicted(spark, sf_dir):
    return evaluate.argmax_long(model_probabilities(spark, sf_dir), 9, ("fid", "lab", "model", "fold"), CLASSES)


def metrics_report(spark, sf_dir):
    return rounded(evaluate.class_report(_predicted(spark, sf_dir), "lab", "pred", ("model",)))


def metrics_scores(spark, sf_dir):
    return rounded(evaluate.scores(_predicted(spark, sf_dir), "lab", "pred", ("model", "fold")))


def cv_summary(spark, sf_dir):
    results = evaluate.scores(_predicted(spark, sf_dir), "lab", "pred", ("model", "fold"))
    summary = evaluate.cv_summary(results)
    best = evaluate.best_model(summary).select(F.col("model").alias("_best"))
    return rounded(
        summary.join(F.broadcast(best), F.col("model") == F.col("_best"), "left").select(
            "model", "mean_f1", "std_f1", "mean_accuracy", "folds", F.col("_best").isNotNull().cast("int").alias("best")
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        profile_nulls, profile_null_counts, profile_numbers, profile_describe, describe_lineitem, profile_types,
        profile_distinct, value_shares, min_max_columns, class_weights, sample_weights, box_stats, hist_hull_ratio,
        hist2d_shape, preview_sample, cat_interaction, cat_onehot_union, cat_onehot_train, cat_dummies_aligned,
        cat_dummies_filled, cat_multilabel, cat_multilabel_whole, cat_frequency, cat_target, cat_target_customer,
        cat_status_codes, label_map, label_alpha, label_onehot, fill_median, fill_const_inf, scale_std, scale_minmax,
        scale_quantile, log_features, select_anova, anova_lineitem, folds_stratified, folds_in_order, folds_sparse_ids, folds_lineitem,
        split_stratified, fold_average, blend_argmax, fold_argmax, majority_vote, metrics_report, metrics_scores, cv_summary,
    )
}
