"""Neighbour, radius, density and imputation joins against brute force, on data where one place holds a third of the rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from plotshift.operators import density, neighbors as N


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    n = 3000
    x = np.concatenate(
        [rng.normal(0, 1, (n // 3, 2)), np.tile([[5.0, 5.0]], (n // 3, 1)), rng.uniform(-1000, 1000, (n - 2 * (n // 3), 2))]
    )
    pdf = pd.DataFrame({"fid": np.arange(n), "x": x[:, 0], "y": x[:, 1], "lab": rng.integers(0, 6, n)})
    df = spark.createDataFrame(pdf).repartition(4).persist()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return df, pdf, x, d, np.arange(n) % 3 == 0


@pytest.fixture(params=[None, 64])
def small_blocks(request, monkeypatch):
    """Run once with ordinary blocks and once with many small ones, so that queries must visit other blocks."""
    if request.param:
        monkeypatch.setattr(N, "block_rows", lambda n, dims: request.param)


def by_id(df):
    return df.toPandas().set_index("id").sort_index()


def test_self_and_cross(cloud, small_blocks):
    df, _, x, d, test = cloud
    got = by_id(N.neighbor_distances(N.points(df, ["x", "y"]), None))
    near = np.sort(d, 1)
    assert len(got) == len(x)
    np.testing.assert_allclose(got.nearest_neighbor_dist, near[:, 1])
    np.testing.assert_allclose(got.avg_distance_to_neighbors, near[:, :5].mean(1))
    train, asking = df.where("fid % 3 <> 0"), df.where("fid % 3 = 0")
    got = by_id(N.neighbor_distances(N.points(train, ["x", "y"]), N.points(asking, ["x", "y"])))
    near = np.sort(d[test][:, ~test], 1)
    np.testing.assert_allclose(got.nearest_neighbor_dist, near[:, 0])
    np.testing.assert_allclose(got.avg_distance_to_neighbors, near[:, :5].mean(1))


def test_negative_ids_and_too_few_points(spark):
    df = spark.createDataFrame([(-1, 0.0, 0.0), (-2, 3.0, 4.0)], "fid bigint, x double, y double")
    got = by_id(N.nearest(N.points(df, ["x", "y"]), None, 5, 2))
    assert [[(e["d"], e["id"]) for e in v] for v in got.neighbors] == [[(0, -2), (5, -1)], [(0, -1), (5, -2)]]


def test_queries_far_from_all_data(spark, small_blocks):
    rng = np.random.default_rng(1)
    data, asking = rng.normal(0, 1, (400, 2)), rng.normal(500, 0.1, (300, 2))
    frame = lambda a: spark.createDataFrame(pd.DataFrame(a, columns=["x", "y"]).assign(fid=np.arange(len(a))))
    got = by_id(N.nearest(N.points(frame(data), ["x", "y"]), N.points(frame(asking), ["x", "y"]), 4, 2))
    d = np.sqrt(((asking[:, None] - data[None]) ** 2).sum(2))
    assert [[e["id"] for e in v] for v in got.neighbors] == np.argsort(d, 1)[:, :4].tolist()


def test_radius_vote(cloud, small_blocks):
    df, pdf, _, d, test = cloud
    train, asking = df.where("fid % 3 <> 0"), df.where("fid % 3 = 0")
    got = by_id(N.radius_probabilities(N.points(train, ["x", "y"], value="lab"), N.points(asking, ["x", "y"]), 1.0, 6, 2))
    labels = pdf.lab.to_numpy()[~test]
    want = []
    for row in d[test][:, ~test]:
        near = row <= 1
        if near.any():
            w = (row[near] == 0).astype(float) if (row[near] == 0).any() else 1 / row[near]
            votes = np.bincount(labels[near], w, 6)
        else:
            votes = np.eye(6)[np.bincount(labels).argmax()]
        want.append(votes / votes.sum())
    np.testing.assert_allclose(np.array(got.probability.tolist()), np.array(want), atol=1e-12)


def test_high_dimension(spark, small_blocks):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 20))
    cols = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(fid=np.arange(900)))
    got = by_id(N.nearest(N.points(df.where("fid >= 300"), cols), N.points(df.where("fid < 300"), cols), 5, 20))
    d = np.sqrt(((x[:300, None] - x[None, 300:]) ** 2).sum(2))
    assert [[e["id"] for e in v] for v in got.neighbors] == (np.argsort(d, 1)[:, :5] + 300).tolist()


def test_copies_decide_alone_in_many_columns(spark, small_blocks):
    """Far from the origin a matrix product cannot tell a copy from a near point; differences can."""
    rng = np.random.default_rng(9)
    x = 1e4 + rng.normal(size=(400, 20))
    x[300:] = x[:100]
    x[350:] += 1e-4
    labels = np.arange(400) % 6
    cols = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(fid=np.arange(400), lab=labels))
    train, asking = df.where("fid < 300"), df.where("fid >= 300")
    got = by_id(N.radius_probabilities(N.points(train, cols, value="lab"), N.points(asking, cols), 5.0, 6, 20))
    want = []
    for row in np.sqrt(((x[300:, None] - x[None, :300]) ** 2).sum(2)):
        near = row <= 5
        w = (row[near] == 0).astype(float) if (row == 0).any() else 1 / row[near]
        votes = np.bincount(labels[:300][near], w, 6)
        want.append(votes / votes.sum())
    np.testing.assert_allclose(np.array(got.probability.tolist()), np.array(want), atol=1e-9)
    assert all(got.probability[i][labels[i - 300]] == 1 for i in range(300, 350))


def test_gaps_in_many_columns(spark):
    rng = np.random.default_rng(13)
    q, d = 1e4 + rng.integers(0, 3, (40, 12)).astype(float), 1e4 + rng.integers(0, 3, (90, 12)).astype(float)
    for a in (q, d):
        a[rng.random(a.shape) < 0.4] = np.nan
    d[7] = np.nan
    ids = rng.permutation(90)
    pick, best = N.nearest_of(q, d, ids, 6, True)
    sq = N.squared(q, d, True)
    order = np.array([np.lexsort((ids, r))[:6] for r in sq])
    np.testing.assert_array_equal(pick, order)
    np.testing.assert_allclose(best, np.take_along_axis(sq, order, 1))


def test_density(cloud):
    df, _, x, _, _ = cloud
    got = by_id(density.kernel_density(df, "x", "y"))
    n = len(x)
    c = np.cov(x.T) * n ** (-1 / 3)
    gap = x[:, None] - x[None]
    want = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", gap, np.linalg.inv(c), gap)).sum(1) / (2 * np.pi * np.sqrt(np.linalg.det(c)) * n)
    np.testing.assert_allclose(got.density, want, rtol=1e-7)


def test_imputation(spark, small_blocks):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    x[rng.random((500, 3)) < 0.2] = np.nan
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(fid=np.arange(500)))
    got = N.knn_impute(df, df, cols).toPandas().set_index("fid").sort_index()[cols].to_numpy()
    want = x.copy()
    for i in range(500):
        for f in np.nonzero(np.isnan(x[i]))[0]:
            donors = np.nonzero(~np.isnan(x[:, f]))[0]
            gap = x[donors] - x[i]
            shared = (~np.isnan(gap)).sum(1)
            dist = np.where(shared > 0, np.nansum(gap**2, 1) * 3 / np.maximum(shared, 1), np.inf)
            best = donors[np.lexsort((donors, dist))[:5]]
            want[i, f] = x[best, f].mean() if np.isfinite(dist).any() else np.nanmean(x[:, f])
    np.testing.assert_allclose(got, want)


def test_density_over_many_tiles(spark):
    """Cells whose reach crosses several of them, on both sides of zero, and cells nobody is near."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal(0, 60, (400, 2)), [[4000.0, -4000.0]]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["x", "y"]).assign(fid=np.arange(len(x))))
    white = density.whitened(df, "x", "y", "fid", None)
    u = white.orderBy("id").toPandas()[["u", "v"]].to_numpy()
    tiles = {tuple(t) for t in np.floor(np.floor(u / density.SIDE) / density.TILE).astype(int).tolist()}
    assert len(tiles) > 4 and min(min(t) for t in tiles) < 0
    want = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / 2).sum(1)
    got = by_id(density.kernel_density(df, "x", "y"))
    factor = white.orderBy("id").toPandas()["factor"].to_numpy()
    np.testing.assert_allclose(got.density, want * factor, rtol=1e-9)


def test_density_of_flat_classes(spark):
    """One row, one place, one line: no density; others are as without them."""
    rng = np.random.default_rng(3)
    good = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(50, 2)))]
    flat = [(100, 1, 1.0, 2.0)] + [(200 + i, 2, 3.0, 3.0) for i in range(4)] + [(300 + i, 3, float(i), 2.0) for i in range(4)]
    schema = "fid long, c int, x double, y double"
    got = {r.id: r.density for r in density.kernel_density(spark.createDataFrame(good + flat, schema), "x", "y", by="c").collect()}
    alone = {r.id: r.density for r in density.kernel_density(spark.createDataFrame(good, schema), "x", "y", by="c").collect()}
    assert len(got) == 59 and all(got[k] is None for k in got if k >= 100)
    assert all(got[k] == pytest.approx(alone[k], rel=1e-9) for k in alone)


def test_imputation_visits_only_blocks_that_may_matter(spark, monkeypatch):
    """Rows that lack a coordinate are searched in those they have, not sent to every block."""
    monkeypatch.setattr(N, "block_rows", lambda n, dims: 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 3))
    x[::10, 0] = np.nan
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(fid=np.arange(3000)))
    written, keep = {}, N.materialize

    def materialize(frame, name):
        written[name] = keep(frame, name)
        return written[name]

    monkeypatch.setattr(N, "materialize", materialize)
    N.knn_impute(df, df, cols).count()
    asked = written["visits"].where("target IS NOT NULL").selectExpr("sum(size(qids)) AS n").first()["n"] or 0
    blocks = written["blocks"].where("n > 0").count()
    assert blocks > 20 and asked < 300 * blocks / 4


def test_nothing_within_reach_is_not_returned():
    """A block that is visited returns only what can still be among the nearest."""
    one = lambda v: pa.array([np.asarray(v).ravel().tolist()])
    batch = pa.RecordBatch.from_arrays(
        [one([7, 8]), one([0.0, 0.0, 5.0, 0.0]), one([1.0, 1.0]), one([1, 2, 3]), one([5.0, 0.5, 5.0, 2.0, 9.0, 9.0]), one([1.0, 2.0, 3.0]), one([1.0] * 3)],
        names=["qids", "qxs", "reach", "ids", "xs", "values", "weights"],
    )
    out = pa.Table.from_batches(N._answer(N.Nearest(2, 2), 2)(iter([batch]))).to_pydict()
    assert out["qids"] == [[8]]
    assert out["acc"][0][0][:2] == [0.5, float("inf")] and out["nid"][0][0][0] == 1


def test_many_columns_need_bounded_memory():
    """A block pair with many equal distances is measured in steps, not as one table of some hundred megabytes."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 64))[rng.integers(0, 6, 4096)]
    tracemalloc.start()
    acc, nid, _ = N.Nearest(6, 64).run(x[:1024], x, np.arange(4096), np.zeros(4096), np.zeros(4096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6 and not acc[:, :6].any()
    for i in range(0, 1024, 97):
        assert nid[i].tolist() == np.nonzero((x == x[i]).all(1))[0][:6].tolist()
