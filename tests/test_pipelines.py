"""From two GeoJSON documents to a submission file, the way a user runs it."""

import json

import pytest
from pyspark.sql import functions as F

from plotshift.operators import categorical, train
from plotshift.plans import pipelines
from plotshift.sources import geojson, submission
from plotshift.sources.parcels import parcels
from plotshift.vocabulary import BANDS

TEXT = ["urban_type", "geography_type", *[f"date{i}" for i in range(5)], *[f"change_status_date{i}" for i in range(5)]]
NUMBERS = [f"img_{b}_{s}_date{d}" for b in BANDS for s in ("mean", "std") for d in range(1, 6)]


@pytest.fixture(scope="module")
def documents(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("geojson")
    for split in ("train", "test"):
        labels = ["change_type"] if split == "train" else []
        rows = parcels(spark, sf, split).orderBy("fid").select("rings", *labels, *TEXT, *NUMBERS).collect()
        features = [
            {
                "type": "Feature",
                "geometry": None
                if r["rings"] is None
                else {"type": "Polygon", "coordinates": [[[p["x"], p["y"]] for p in ring["pts"]] for ring in r["rings"]]},
                "properties": {c: r[c] for c in labels + TEXT + NUMBERS},
            }
            for r in rows
        ]
        (folder / f"{split}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    text = ", ".join(f"{c} string" for c in TEXT) + ", " + ", ".join(f"{c} double" for c in NUMBERS)
    read = lambda split, more="": geojson.read_geojson(spark, str(folder / f"{split}.geojson"), more + text)
    return read("train", "change_type string, "), read("test")


def test_documents_to_submission(spark, documents, tmp_path):
    df = pipelines.combine(*documents)
    assert df.select("fid").distinct().count() == df.count() == 1500
    results, scored = pipelines.run_ensemble(spark, df, {"logistic": train.Logistic(rounds=10)}, [1.0], folds=2, test_rows=273)
    assert results.agg(F.min("macro_f1")).first()[0] > 0.3
    out = submission.submission(scored)
    folder = submission.write_submission(out, str(tmp_path), "ensemble", rows=273)
    back = spark.read.option("header", True).schema("Id bigint, change_type int").csv(folder)
    assert sorted(r["Id"] for r in back.collect()) == list(range(273))


def test_contracts(spark, documents):
    df = pipelines.combine(*documents)
    with pytest.raises(ValueError, match="expected 120526 rows"):
        pipelines.run_ensemble(spark, df, {"logistic": train.Logistic()}, [1.0], test_rows=120526)
    with pytest.raises(ValueError, match="3 weights for 1 models"):
        pipelines.run_ensemble(spark, df, {"logistic": train.Logistic()}, [0.4, 0.3, 0.3])
    results, features = pipelines.run_ensemble(spark, documents[1].withColumn("split", F.lit("test")), {}, [])
    assert results is None and {"area", "days_between_0_1", "spectral_mean_1_red"} <= set(features.columns)


def test_own_median_variant(spark, documents):
    matrix, names = pipelines.prepare_ensemble(spark, pipelines.combine(*documents), fit_on_train=False)
    assert matrix.count() == 1500 and len(matrix.first()["features"]) == len(names)


def test_spatial_selection(spark, documents):
    models = {"logistic": train.Logistic(rounds=5), "forest": train.Forest(trees=5, depth=5)}
    results, out = pipelines.run_selection(spark, pipelines.combine(*documents), models, folds=2)
    assert results.count() == 4
    assert {r[0] for r in out.select("change_type").distinct().collect()} <= set(categorical.CHANGE_TYPES)


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a b", "a,b", " c "])
    assert categorical.plain_names(df).columns == ["a_b", "a_b_2", "c"]
    assert categorical.with_absent(df, {"a b": F.lit(0), "d": F.lit(4)}).first().asDict() == {"a b": 1, "a,b": 2, " c ": 3, "d": 4}
