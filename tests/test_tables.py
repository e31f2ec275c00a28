import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plotshift.functions import temporal
from plotshift.operators import categorical as C
from plotshift.operators import dates, evaluate, numeric, profile, windows
from plotshift.operators.quantiles import curve, quantiles
from plotshift.session import shared_dir
from plotshift.sources import geojson, submission
from plotshift.sources.parcels import parcels


def test_dates(spark):
    df = spark.createDataFrame([("05-01-2015",), ("5-1-2015",), ("31-13-2015",), (None,)], "date0 string")
    got = [r[0] for r in df.select(temporal.parse_date("date0")).collect()]
    assert got[0] == got[1] and str(got[0]) == "2015-01-05" and got[2] is None and got[3] is None
    with pytest.raises(PySparkException):
        df.select(temporal.parse_date("date0", strict=True)).collect()
    assert dates.parse_dates(df, ("date0",)).schema["date0"].dataType.typeName() == "date"


def test_windows_across_runs(spark):
    rng = np.random.default_rng(0)
    ids = np.sort(rng.choice(5000, 800, replace=False)) * 7
    v = rng.normal(size=800)
    v[rng.random(800) < 0.2] = np.nan
    rows = [(int(i), None if np.isnan(x) else float(x)) for i, x in zip(ids, v)]
    df = spark.createDataFrame(rows, "fid bigint, v double").repartition(5)
    for bits in (8, 16):
        out = windows.running_total(windows.row_change(df, "v", "step", bits=bits), "v", "total", bits=bits)
        got = out.toPandas().set_index("fid").sort_index()
        s = pd.Series(v)
        np.testing.assert_allclose(got.step, s.diff().fillna(0))
        np.testing.assert_allclose(got.total.to_numpy(float), s.cumsum().to_numpy())


@pytest.mark.parametrize("ties", [False, True])
def test_bracketed_quantiles(spark, ties):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 5, 4000).astype(float) if ties else rng.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(4000) % 3, "v": v}))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    for keep, grid in ((20_000, 1000), (200, 1000), (60, 12), (40, 10)):  # no sketch, a sketch alone, several narrowings
        got = quantiles(df, ["v"], probs, by=("g",), keep=keep, grid=grid).toPandas()
        for g in range(3):
            mine = got[got.g == g].sort_values("p").value
            np.testing.assert_allclose(mine, np.quantile(v[np.arange(4000) % 3 == g], probs))


@pytest.mark.parametrize("n,points", [(1, 2), (2, 5), (7, 1000), (500, 11), (500, 500), (333, 77)])
def test_curve(spark, n, points):
    rng = np.random.default_rng(n)
    v, w = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w)] + [(None, float("nan"))], "v double, w double").repartition(5)
    got = curve(df, ["v", "w"], points).toPandas().sort_values("k")
    for name, x in (("v", v), ("w", w)):
        mine = got[got["column"] == name]
        assert list(mine.k) == list(range(points))
        np.testing.assert_allclose(mine.value, np.quantile(x, np.linspace(0, 1, points)), atol=1e-12)


def test_encoders(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "fid bigint, c string")
    test = spark.createDataFrame([(4, "z"), (5, "a")], "fid bigint, c string")
    a, b = C.one_hot_union(train, test, "c")
    assert a.columns == ["fid", "c", "c_a", "c_b", "c_z", "c_None"] == b.columns
    _, b = C.one_hot_train(train, test, "c")
    assert [tuple(r)[2:] for r in b.orderBy("fid").collect()] == [(0, 0, 0), (1, 0, 0)]
    x, y = C.align_outer(C.dummies(train, "c").drop("c"), C.dummies(test, "c").drop("c"))
    assert x.columns == y.columns == ["fid", "c_a", "c_b", "c_z"]
    left = C.align_left(C.dummies(train, "c").drop("c"), C.dummies(test, "c").drop("c"))
    assert left.columns == ["fid", "c_a", "c_b"]
    freq = {r["fid"]: r["c_freq"] for r in C.frequency_encode(train, test, "c").collect()}
    assert freq == {4: None, 5: 0.5}
    labels = spark.createDataFrame([(1, "A, B"), (2, "B"), (3, None)], "fid bigint, c string")
    got = C.multilabel(labels, labels, "c", "m").orderBy("fid").drop("c").collect()
    assert [r.asDict() for r in got][0] == {"fid": 1, "m_A": 1, "m_B": 1, "m_Unknown": 0}
    model = C.one_hot_vector(train.fillna("x"), "c", "v")
    assert model.transform(train.fillna("x")).first()["v"].size == 4


def test_target_encoding(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b", i % 2) for i in range(40)], "fid bigint, c string, y int")
    new = spark.createDataFrame([(100, "new")], "fid bigint, c string")
    prior, w = 0.5, 1 / (1 + math.exp(-(30 - 20) / 10))
    got = {r["c"]: r["t"] for r in C.target_encode(df, df, "c", "y", "t").collect()}
    assert got["a"] == pytest.approx(w * 0.5 + (1 - w) * prior)
    assert C.target_encode(df, new, "c", "y", "t").first()["t"] == prior


def test_labels(spark):
    df = spark.createDataFrame([("Road",), ("Nowhere",)], "change_type string")
    assert [r[0] for r in df.select(C.label_code()).collect()] == [1, None]
    with pytest.raises(PySparkException, match="unknown label"):
        df.select(C.label_code(strict=True)).collect()


def test_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (nan,), (inf,), (-inf,)], "v double")
    assert [r[0] for r in numeric.numbers_only(df, ["v"]).collect()] == [1, 3, 0, 0, 1e10, -1e10]
    clean = numeric.fill_median(numeric.infinite_to(df, ["v"], None), ["v"])
    assert [r[0] for r in clean.collect()] == [1, 3, 2, 2, 2, 2]
    with pytest.raises(ValueError):
        numeric.assert_finite(df, ["v"])
    with pytest.raises(ValueError):
        numeric.assert_rows(df, 5)
    rows = {r["column"]: r for r in profile.nonfinite_counts(df, ["v"]).collect()}
    assert (rows["v"]["nan"], rows["v"]["inf"]) == (2, 2)


def test_scaling(spark):
    v = np.random.default_rng(0).normal(5, 3, 500)
    df = spark.createDataFrame(pd.DataFrame({"fid": np.arange(500), "v": v, "k": 7.0}))
    got = numeric.standard_scale(df, df, ["v", "k"]).toPandas()
    assert got.v.mean() == pytest.approx(0, abs=1e-12) and got.v.std(ddof=0) == pytest.approx(1) and (got.k == 0).all()
    q = numeric.quantile_normal(df, df, ["v"]).toPandas().sort_values("fid").v
    assert abs(q.median()) < 0.02 and q.max() == pytest.approx(5.1993, abs=1e-3)
    assert (np.argsort(q.to_numpy()) == np.argsort(v)).mean() > 0.99


def test_folds(spark):
    df = spark.createDataFrame([(i, 0 if i % 3 else i % 4) for i in range(1000)], "fid bigint, y int").repartition(7)
    sizes = evaluate.stratified_folds(df, "y").groupBy("y", "fold").count().toPandas()
    assert sizes["count"].sum() == 1000
    assert (sizes.groupby("y")["count"].agg(lambda c: c.max() - c.min()) <= 1).all()
    split = evaluate.stratified_split(df, "y").groupBy("y").agg(F.avg(F.col("is_train").cast("int"))).collect()
    assert all(0.8 <= r[1] < 0.83 for r in split)
    tail = evaluate.tail_split(df).where("is_train").agg(F.max("fid"), F.count("*")).first()
    assert tuple(tail) == (799, 800)


def test_blend(spark):
    rows = [(1, m, c, p) for m, ps in enumerate([(0.2, 0.8), (0.9, 0.1)]) for c, p in enumerate(ps)]
    probs = spark.createDataFrame(rows, "fid bigint, model int, class int, p double")
    assert evaluate.argmax_long(evaluate.blend(probs, [1.0, 0.0])).first()["pred"] == 1
    assert evaluate.argmax_long(evaluate.blend(probs, [0.5, 0.5])).first()["pred"] == 0
    with pytest.raises(ValueError):
        evaluate.blend(probs, [0.4, 0.3, 0.3], models=[0, 1])
    votes = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (2, 5), (2, 4)], "fid bigint, pred int")
    assert {r[0]: r[1] for r in evaluate.majority_vote(votes).collect()} == {1: 3, 2: 4}


def test_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, pred int")
    got = evaluate.scores(df).first()
    f = [0.5, 2 / 3, 0.0]
    assert got["accuracy"] == 0.5 and got["macro_f1"] == pytest.approx(sum(f) / 3)
    assert got["weighted_f1"] == pytest.approx((2 * f[0] + f[1] + f[2]) / 4)


def test_geojson_document(spark, tmp_path):
    path = tmp_path / "train.geojson"
    path.write_text(
        """{"type": "FeatureCollection", "name": "x", "features": [
        {"type": "Feature", "properties": {"change_type": "Road", "date0": "01-02-2013"},
         "geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]], [[1,1],[2,1],[2,2],[1,2],[1,1]]]}},
        {"type": "Feature", "properties": {"change_type": null, "date0": null}, "geometry": null},
        {"type": "Feature", "properties": {"change_type": "Demolition"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]], [[[5,5],[7,5],[7,7],[5,7],[5,5]]]]}}]}"""
    )
    from plotshift.operators.shapes import with_core

    df = with_core(geojson.read_geojson(spark, str(path), "change_type string, date0 string")).orderBy("fid").collect()
    assert [r["fid"] for r in df] == [0, 1, 2]
    assert [r["area"] for r in df] == [15, None, 4.5]
    assert df[2]["geometry_type"] == "MultiPolygon" and df[0]["date0"] == "01-02-2013"


def test_submission_file(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 6) for i in range(10)], "fid bigint, pred int")
    out = submission.submission(df)
    folder = submission.write_submission(out, str(tmp_path), "m", fold=1, rows=10, single_file=True)
    files = [f for f in __import__("os").listdir(folder) if f.endswith(".csv")]
    assert len(files) == 1 and open(f"{folder}/{files[0]}").readline().strip() == "Id,change_type"
    with pytest.raises(ValueError):
        submission.write_submission(out, str(tmp_path), "m", rows=11)


def test_shared_folder_comes_from_the_session():
    class Context:
        master, folder = "spark://cluster", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, **conf):
            self.conf, self.sparkContext = conf, Context()

    named = Session(**{"spark.checkpoint.dir": "hdfs://shared/x"})
    assert shared_dir(named) == named.sparkContext.folder == "hdfs://shared/x"
    # A cluster without the setting must not fall back to one machine's disk.
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_parcels_scan_only_two_columns(spark, sf):
    plan = parcels(spark, sf).groupBy("urban_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_coded_groups_match_sorted_ones(spark):
    nan = float("nan")
    rows = [(1, 0, 0.5), (1, 4, 0.5), (1, 2, None), (2, 5, None), (2, 3, None), (3, 1, 0.1), (3, 1, 0.9), (3, 0, 0.8), (4, 2, nan), (4, 1, 1.0)]
    rows += [(None, 3, 0.2), (None, 1, 0.2000000001), (5, 5, -0.0), (5, 4, 0.0), (6, 2, -1.0)]
    probs = spark.createDataFrame(rows, "fid bigint, class int, p double")
    best = lambda **how: sorted(evaluate.argmax_long(probs, 9, **how).collect(), key=str)
    assert best(classes=6) == best()
    votes = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (2, 5), (2, 4), (3, None), (4, None), (4, 0)], "fid bigint, pred int")
    assert sorted(evaluate.majority_vote(votes, 6).collect()) == sorted(evaluate.majority_vote(votes).collect())
    with pytest.raises(Exception, match="must be a code"):
        evaluate.majority_vote(votes, 5).collect()


def test_ensembles_neither_sort_nor_shuffle_long_rows(spark, sf):
    """The long table is dealt by id once, before it grows; what groups it hashes in place."""
    from plotshift.plans import tables

    for query in (tables.fold_argmax, tables.majority_vote, tables.metrics_scores, tables.blend_argmax, tables.fold_average):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        below = plan[: plan.index("Generate posexplode")]
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, query.__name__
        assert "hashpartitioning(fid" not in below and "Sort [" not in below, query.__name__


def test_histograms_measure_every_polygon_once(spark, sf):
    """Bounds, filter and bins follow on a stored column; otherwise the hull is written out in the filter many times over."""
    from plotshift.plans import tables

    for query in (tables.hist_hull_ratio, tables.hist2d_shape):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan and "lambda" not in plan, query.__name__
