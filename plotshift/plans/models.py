"""Registered queries that train: classifiers, projections, pipelines, and the file formats around them."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotshift.operators import boosting, categorical, dates, evaluate, numeric, shapes, train
from plotshift.operators.boosting import HistogramBoosting
from plotshift.operators.network import Network
from plotshift.plans import pipelines
from plotshift.plans.common import rounded
from plotshift.plans.tables import MEASURES, NUMBERS, blend_argmax, measured
from plotshift.session import materialize, shared_dir
from plotshift.sources import geojson
from plotshift.sources.parcels import parcels
from plotshift.sources.submission import submission, write_submission
from plotshift.vocabulary import BANDS


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled measures of the training parcels, split 80/20 within each class, with balanced weights."""
    df = measured(spark, sf_dir).where("split = 'train'")
    df = materialize(df.select("fid", F.col("lab").alias("label"), *NUMBERS), "measures")
    df = numeric.fill_median(df, NUMBERS)
    df = train.assemble(numeric.standard_scale(df, df, NUMBERS), NUMBERS)
    df = evaluate.with_sample_weights(evaluate.stratified_split(df, "label"), "label")
    return materialize(df.select("fid", "label", "features", "weight", "is_train", *NUMBERS), "matrix")


def _validated(spec, df: DataFrame) -> DataFrame:
    model = spec.fit(df.where("is_train"))
    return rounded(evaluate.scores(model.transform(df.where("NOT is_train"))))


def wide_columns() -> list[str]:
    bands_of = [f"img_{b}_{m}_date{d}" for b in BANDS for m in ("mean", "std") for d in range(1, 6)]
    return [*MEASURES, *[f"days_between_{i}_{i + 1}" for i in range(4)], *bands_of]


def wide_matrix(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    """All numbers of the training parcels, medians for what is missing; ``held`` marks a fifth of each class."""
    names = wide_columns()
    df = dates.with_gaps(dates.parse_dates(shapes.with_bounds(shapes.with_core(parcels(spark, sf_dir, "train")))))
    df = materialize(df.select("fid", F.col("lab").alias("label"), *[F.col(c).cast("double").alias(c) for c in names]), "measures")
    df = numeric.fill_median(df, names)
    df = train.assemble(numeric.standard_scale(df, df, names) if scaled else df, names).select("fid", "label", "features")
    df = evaluate.with_sample_weights(evaluate.stratified_split(df, "label"), "label").withColumn("held", ~F.col("is_train"))
    return materialize(df.drop("is_train"), "matrix")


def _boosted(spec, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the held rows, with the rounds that were run and the best of them."""
    df = wide_matrix(spark, sf_dir)
    model = replace(spec, validation="held").fit(df)
    run = evaluate.scores(model.transform(df.where("held")))
    return rounded(run.withColumns({"rounds": F.lit(len(model.curve) - 1), "best_round": F.lit(model.best_round)}))


def train_gbt(spark, sf_dir):
    return _boosted(HistogramBoosting(rounds=25, depth=4, rate=0.1), spark, sf_dir)


def train_gbt_early_stop(spark, sf_dir):
    """A thousand rounds allowed; fifty that lower the held rows' loss by less than 0.01 end it."""
    return _boosted(HistogramBoosting(rounds=1000, depth=4, rate=0.8, patience=50, tolerance=0.01), spark, sf_dir)


def train_gbt_leafy(spark, sf_dir):
    """Leaf by leaf up to 63 leaves, finer bins, class weights: the whole preset, which stops after fifty rounds without a lower loss."""
    return _boosted(boosting.LEAFY, spark, sf_dir)


def train_gbt_columns(spark, sf_dir):
    """Draws 80 % of the rows and columns per round, with both penalties; a hundred rounds of a larger rate."""
    return _boosted(replace(boosting.REGULARIZED, rounds=100, depth=6, rate=0.1), spark, sf_dir)


def train_gbt_ordered(spark, sf_dir):
    """Symmetric trees: the preset's first hundred rounds."""
    return _boosted(replace(boosting.ORDERED, rounds=100), spark, sf_dir)


def boost_histograms(spark, sf_dir):
    """What the first split is chosen from: sums of gradients and curvatures per class, column and bin of width 20."""
    names = [f"days_between_{i}_{i + 1}" for i in range(4)] + ["img_red_mean_date1", "img_blue_std_date5"]
    df = dates.with_gaps(dates.parse_dates(parcels(spark, sf_dir, "train", geometry=False)))
    df = df.select(F.col("lab").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names])
    df = df.select("label", array_to_vector(F.array(*names)).alias("features"))
    edges = [np.arange(20.0, 321.0, 20.0)] * len(names)
    return rounded(boosting.root_histograms(df, names, edges), 3)


def cv_early_stop(spark, sf_dir):
    """Five folds, each stopped by its own held-out loss."""
    df = evaluate.stratified_folds(wide_matrix(spark, sf_dir), "label", 5)
    spec = HistogramBoosting(rounds=1000, depth=4, rate=0.8, patience=10, tolerance=0.01)
    return rounded(evaluate.cv_summary(train.cross_validate(materialize(df, "folds"), {"boosting": spec}, folds=5)[0]))


def train_rf(spark, sf_dir):
    return _validated(train.Forest(), matrix(spark, sf_dir))


def train_logreg(spark, sf_dir):
    return _validated(train.Logistic(), matrix(spark, sf_dir))


def train_svm_rff(spark, sf_dir):
    return _validated(train.FourierSVM(), matrix(spark, sf_dir))


def _netted(spec: Network, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the held rows, with the epochs that were run and the best of them."""
    df = wide_matrix(spark, sf_dir, scaled=True)
    model = replace(spec, validation="held").fit(df)
    run = evaluate.scores(model.transform(df.where("held")))
    return rounded(run.withColumns({"epochs": F.lit(len(model.curve)), "best_epoch": F.lit(model.best_epoch)}), 4)


def train_mlp(spark, sf_dir):
    """Three normalised layers with dropout and class weights; ten epochs without a better loss end it."""
    return _netted(Network(), spark, sf_dir)


def train_mlp_two_blocks(spark, sf_dir):
    """A branch over gaps and bands, which change with the dates, and one over the shape, joined in front of the trunk."""
    names = wide_columns()
    shape = tuple(i for i, c in enumerate(names) if c in MEASURES)
    dated = tuple(i for i, c in enumerate(names) if c not in MEASURES)
    spec = Network(
        columns=(dated, shape), branch=(128,), trunk=(256,), dropout=(0.3,), activation="swish", trunk_norm=False, l2=0.0, decay=1.0, epochs=100
    )
    return _netted(spec, spark, sf_dir)


def train_adaboost(spark, sf_dir):
    return _validated(train.AdaBoost(), matrix(spark, sf_dir))


def train_neighbors(spark, sf_dir):
    return _validated(train.Neighbors(("area", "perimeter", "bounding_width"), radius=1.0), matrix(spark, sf_dir))


def importances_top10(spark, sf_dir):
    df = matrix(spark, sf_dir)
    model = train.Forest().fit(df)
    return rounded(train.top_features(spark, model.importances(), NUMBERS))


def training_curve(spark, sf_dir):
    """Losses before each boosting round until it stops by itself, and the weighted error of each adaptive round."""
    df = wide_matrix(spark, sf_dir)
    boosted = HistogramBoosting(rounds=1000, depth=4, rate=0.8, patience=20, tolerance=0.01, validation="held").fit(df)
    adaptive = train.AdaBoost(rounds=50, depth=3).fit(df.where("NOT held"))
    rows = [(kind, turn, float(v)) for turn, fit, held in boosted.curve for kind, v in (("learned", fit), ("held", held))]
    rows += [("adaptive", i, float(v)) for i, v in enumerate(adaptive.errors)]
    return rounded(spark.createDataFrame(rows, "model string, round int, value double"))


def cv_compare(spark, sf_dir):
    """Three-fold macro F1 and accuracy of two models, summarised."""
    df = evaluate.stratified_folds(matrix(spark, sf_dir), "label", 3)
    models = {"forest": train.Forest(trees=10, depth=6), "logistic": train.Logistic(rounds=30)}
    results, _ = train.cross_validate(materialize(df, "folds"), models, folds=3)
    return rounded(evaluate.cv_summary(results))


def pca_fixed(spark, sf_dir):
    """Ten components of the one-hot block; signs are arbitrary, so magnitudes are returned."""
    df = categorical.with_interaction(parcels(spark, sf_dir, geometry=False)).select("fid", "split", "urban_geo_interaction")
    levels = categorical.vocabulary(df, "urban_geo_interaction")
    df = categorical.one_hot(df, "urban_geo_interaction", levels)
    hot = [c for c in df.columns if c.startswith("urban_geo_interaction_")]
    df = materialize(train.assemble(df, hot).select("fid", "split", "features"), "hot")
    out, _ = train.pca(df.where("split = 'train'"), df, k=10)
    return rounded(out.select("fid", *[F.abs(F.get("pca", F.lit(i))).alias(f"pc{i}") for i in range(10)]), 5)


def pca_var95(spark, sf_dir):
    """Components explaining more than 95 % of the variance, and what each explains."""
    df = matrix(spark, sf_dir)
    out, variance = train.pca(df, df, share=0.95)
    spread = out.agg(*[F.var_samp(F.get("pca", F.lit(i))).alias(f"v{i}") for i in range(len(variance))])
    rows = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(v).alias("share"), F.col(f"v{i}").alias("variance")) for i, v in enumerate(variance)])
    return rounded(spread.select(F.inline(rows)), 5)


def pca_embeddings(spark, sf_dir):
    """Embeddings centred and projected; variance per component over the whole table."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("fid"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    out, variance = train.pca(df, df, k=10)
    return rounded(out.select("fid", *[F.abs(F.get("pca", F.lit(i))).alias(f"pc{i}") for i in range(len(variance))]), 5)


def pipeline_ensemble(spark, sf_dir):
    models = {"forest": train.Forest(trees=8, depth=6), "logistic": train.Logistic(rounds=20)}
    _, scored = pipelines.run_ensemble(spark, parcels(spark, sf_dir), models, [0.6, 0.4])
    return submission(scored)


def pipeline_boosting(spark, sf_dir):
    scored = pipelines.run_boosting(spark, parcels(spark, sf_dir), train.Boosting(rounds=4, depth=4, rate=0.1))
    return rounded(evaluate.scores(scored, "lab", "pred", ("split",)))


def pipeline_selection(spark, sf_dir):
    models = {"forest": train.Forest(trees=10, depth=6), "boosting": train.Boosting(rounds=2, depth=3, rate=0.1)}
    return pipelines.run_selection(spark, parcels(spark, sf_dir), models)[1]


def submission_csv(spark, sf_dir):
    """The blended ensemble prediction of every parcel, written as CSV and read back."""
    preds = blend_argmax(spark, sf_dir)
    folder = f"{shared_dir(spark)}/submission-{uuid.uuid4().hex}"
    written = write_submission(submission(preds), folder, "blend", run="once")
    return spark.read.schema("Id bigint, change_type int").option("header", True).csv(written)


def submission_names(spark, sf_dir):
    test = parcels(spark, sf_dir, "test", geometry=False).select("fid", F.col("lab").alias("pred"))
    return submission(test, names=True)


def geojson_scan(spark, sf_dir):
    """Parcels written as GeoJSON features and scanned back."""
    folder = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    geojson.write_geojson_lines(parcels(spark, sf_dir), folder, ["fid", "change_type", "urban_type", "date0"])
    df = geojson.read_geojson_lines(spark, folder, "fid bigint, change_type string, urban_type string, date0 string")
    return rounded(shapes.with_core(df).select("fid", "geometry_type", "change_type", "urban_type", "date0", "area", "perimeter"))


def geojson_collection(spark, sf_dir):
    """Parcels as feature collections and back: notes full of quotes, brackets and escapes, and some polygons in two parts."""
    note = F.format_string('}{"[\\%d\n]', "fid")
    twice = F.when(F.expr("fid % 5 = 0"), F.concat("rings", "rings")).otherwise(F.col("rings"))
    df = parcels(spark, sf_dir).withColumns({"parcel": F.col("fid"), "note": note, "rings": twice})
    folder = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    geojson.write_geojson(df, folder, ["parcel", "note", "change_type", "date0"])
    back = geojson.read_geojson(spark, folder, "parcel bigint, note string, change_type string, date0 string")
    columns = ["parcel", "geometry_type", "note", "change_type", "date0", "outlines", "area"]
    outlines = F.size(F.filter("rings", lambda r: ~r["hole"])).cast("double")
    return rounded(shapes.with_core(back).withColumn("outlines", outlines).select(*columns))


QUERIES = {
    f.__name__: f
    for f in (
        train_gbt, train_gbt_early_stop, train_gbt_leafy, train_gbt_columns, train_gbt_ordered, boost_histograms, cv_early_stop, train_rf, train_logreg, train_svm_rff, train_mlp,
        train_mlp_two_blocks, train_adaboost, train_neighbors, importances_top10, training_curve, cv_compare, pca_fixed,
        pca_var95, pca_embeddings, pipeline_ensemble, pipeline_boosting, pipeline_selection, submission_csv,
        submission_names, geojson_scan, geojson_collection,
    )
}
