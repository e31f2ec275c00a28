import numpy as np
import pandas as pd
import pytest

from plotshift.operators import evaluate, train


@pytest.fixture(scope="module")
def blobs(spark):
    """Four well-separated classes of very different sizes."""
    rng = np.random.default_rng(0)
    sizes, centres = [300, 150, 60, 30], [(0, 0, 0), (6, 0, 0), (0, 6, 0), (0, 0, 6)]
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for n, c in zip(sizes, centres)])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=np.repeat(range(4), sizes), fid=np.arange(len(x)))
    df = train.assemble(spark.createDataFrame(pdf), ["a", "b", "c"])
    return evaluate.with_sample_weights(df, "label").select("fid", "label", "features", "weight", "a", "b", "c").persist()


@pytest.mark.parametrize(
    "spec",
    [
        train.Boosting(rounds=3, depth=3, rate=0.3, classes=4),
        train.Forest(trees=5, depth=4),
        train.Logistic(rounds=30, weight="weight"),
        train.Perceptron(hidden=(8,), rounds=40, classes=4),
        train.FourierSVM(components=32, rounds=10, classes=4),
        train.AdaBoost(rounds=6, depth=2, classes=4, checkpoint_every=2),
        train.Neighbors(("a", "b", "c"), radius=1.0, classes=4),
        train.Neighbors(("a", "b", "c"), radius=None, k=5, classes=4),
    ],
    ids=lambda s: type(s).__name__,
)
def test_learns_blobs(blobs, spec):
    scored = spec.fit(blobs).transform(blobs)
    shares = np.array([r[0] for r in scored.select("probability").collect()])
    assert shares.shape[0] == 540
    np.testing.assert_allclose(shares.sum(1), 1, atol=1e-9)
    assert evaluate.scores(scored).first()["macro_f1"] > 0.85


def test_pca_is_centred(blobs):
    out, variance = train.pca(blobs, blobs, k=2)
    p = np.array([r[0] for r in out.select("pca").collect()])
    assert p.shape[1] == 2 and abs(p.mean(0)).max() < 1e-9 and sum(variance) < 1
    _, variance = train.pca(blobs, blobs, share=0.95)
    assert sum(variance) > 0.95


def test_balanced_copies_keep_every_row(blobs):
    copies = train.balanced_copies(blobs, "label")
    counts = {r["label"]: r["count"] for r in copies.groupBy("label").count().collect()}
    assert counts[0] == 300 and counts[3] == 300
    assert copies.select("fid").distinct().count() == 540


def test_cross_validation_averages_folds(blobs):
    df = evaluate.stratified_folds(blobs, "label", 3).persist()
    results, scored = train.cross_validate(df, {"logistic": train.Logistic(rounds=5)}, folds=3, keep=blobs)
    assert results.count() == 3
    p = np.array([r[0] for r in scored.select("p_logistic").collect()])
    np.testing.assert_allclose(p.sum(1), 1, atol=1e-9)


def test_sigmoids_are_the_likeliest_and_reliable(spark):
    """Margins of rows whose classes were drawn with known chances: the fit finds the chances, and its gradient is zero."""
    rng = np.random.default_rng(4)
    m = rng.normal(0, 2, (6000, 3))
    chance = 1 / (1 + np.exp(-(1.7 * m[:, 0] - 0.6)))
    label = np.where(rng.random(6000) < chance, 0, 1)
    df = spark.createDataFrame([(int(y), [float(v) for v in x]) for y, x in zip(label, m)], "label int, margins array<double>")
    (a, b), (c, d), (e, f) = train.fit_sigmoids(df, "label", 3)
    assert abs(a - 1.7) < 0.15 and abs(b + 0.6) < 0.15 and abs(c) < 0.1 and e == 0 and f < -8
    p = 1 / (1 + np.exp(-(a * m[:, 0] + b)))
    t = np.where(label == 0, ((label == 0).sum() + 1) / ((label == 0).sum() + 2), 1 / ((label != 0).sum() + 2))
    assert abs((p - t).sum()) < 1e-3 and abs(((p - t) * m[:, 0]).sum()) < 1e-3
    for lo in np.arange(0, 1, 0.2):
        inside = (p >= lo) & (p < lo + 0.2)
        assert abs(p[inside].mean() - (label[inside] == 0).mean()) < 0.05
    # separable margins keep a finite slope
    apart = spark.createDataFrame([(i % 2, [1.0 if i % 2 == 0 else -1.0] * 2) for i in range(40)], "label int, margins array<double>")
    assert all(abs(v) < 50 for pair in train.fit_sigmoids(apart, "label", 2) for v in pair)


def test_kernel_machine_probabilities_are_reliable(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 3000)
    x = rng.normal(0, 1, (3000, 2)) + label[:, None] * 1.0
    df = train.assemble(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(label=label, fid=np.arange(3000))), ["a", "b"])
    fitted, fresh = df.where("fid < 2000"), df.where("fid >= 2000")
    rows = train.FourierSVM(components=64, rounds=20, classes=2).fit(fitted).transform(fresh).select("probability", "label").collect()
    p, y = np.array([r[0][1] for r in rows]), np.array([r[1] for r in rows])
    for lo in (0, 0.25, 0.5, 0.75):
        inside = (p >= lo) & (p < lo + 0.25)
        assert inside.sum() > 50 and abs(p[inside].mean() - y[inside].mean()) < 0.12


def test_kernel_machine_keeps_features_not_components(spark, monkeypatch):
    """Only the narrow rows are kept between fits; every fit lifts them anew."""
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(80).selectExpr("CAST(id % 2 AS INT) AS label", "array(id % 7 - 3.0D, id % 2 + id % 5 * 0.1D) AS x")
    rows = rows.select("label", array_to_vector("x").alias("features"))
    kept, real = [], train.one_vs_rest

    def watched(df, *args, **how):
        plan = df._jdf.queryExecution().withCachedData().toString()
        kept.append(plan[plan.index("InMemoryRelation [") :].split("]")[0])
        return real(df, *args, **how)

    monkeypatch.setattr(train, "one_vs_rest", watched)
    model = train.FourierSVM(components=8, rounds=2, classes=2, folds=2).fit(rows)
    assert len(kept) == 3 and all("features" in k and "_lifted" not in k for k in kept)
    assert model.transform(rows).count() == 80


def trainable(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (600, 3))
    df = pd.DataFrame(x, columns=list("abc")).assign(fid=[None if i % 50 == 0 else i // 2 for i in range(600)], label=(x[:, 0] > 0).astype(int) + (x[:, 1] > 0))
    return train.assemble(spark.createDataFrame(df), list("abc")).select("fid", "label", "features")


def test_trainer_rows_come_in_bounded_tasks(spark, monkeypatch):
    """Rows of a scan's few tasks are dealt to more, all of them; fewer rows stay where they are."""
    df = trainable(spark).coalesce(1)
    assert train.dealt(df, "fid", "label", "features").rdd.getNumPartitions() == 1
    monkeypatch.setattr(train, "ROWS_AT_ONCE", 100)
    got = train.dealt(df, "fid", "label", "features")
    assert got.columns == df.columns and got.rdd.getNumPartitions() == 8
    assert max(len(p) for p in got.rdd.glom().collect()) < 150
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()


def test_boosting_reads_bounded_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(train, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(train.OneVsRestModel, "__init__", lambda self, models, scale: None)

    class Trainer:
        setLabelCol = lambda self, name: self
        fit = lambda self, df: seen.append(df.rdd.getNumPartitions())

    train.one_vs_rest(trainable(spark).coalesce(1), Trainer, "label", 2, 1.0)
    assert seen == [8, 8]


def test_components_leave_python_as_arrow_arrays(spark, monkeypatch):
    """Equal to the formula, and no row becomes an object of its own."""
    from pyspark.sql import functions

    monkeypatch.setattr(functions, "pandas_udf", None)
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(0, 1, (50, 3)), rng.normal(0, 1, (3, 8)), rng.uniform(0, 6, 8)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "fid int, a double, b double, c double")
    out = train._fourier(train.assemble(df.repartition(3), ["a", "b", "c"]), w, b).orderBy("fid").collect()
    np.testing.assert_allclose([r["_lifted"].toArray() for r in out], 0.5 * np.cos(x @ w + b), atol=1e-12)
