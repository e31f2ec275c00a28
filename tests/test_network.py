"""Nets: gradients against finite differences, sums over blocks against one array, branches, stopping, folders."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plotshift.operators import evaluate, network
from plotshift.operators.network import Network
from plotshift.session import shared_dir

SPECS = {
    "plain": Network(trunk=(7, 5), dropout=(), trunk_norm=False, classes=3),
    "normed": Network(trunk=(7, 5), dropout=(0.4, 0.2), classes=3),
    "two": Network(columns=((0, 2), (1, 3, 4)), branch=(6, 4), trunk=(5,), dropout=(0.3,), activation="swish", trunk_norm=False, classes=3),
}


@pytest.mark.parametrize("name", SPECS)
def test_gradients_equal_finite_differences(name):
    rng = np.random.default_rng(1)
    net = SPECS[name].net(5)
    params = net.start(3)
    for p in params:
        for k in p:
            p[k] = p[k] + rng.normal(0, 0.2, p[k].shape)
    x, y, w = rng.normal(0, 1, (40, 5)), rng.integers(0, 3, 40), rng.choice([0.5, 1, 3.0], 40)
    loss = lambda: net.gradients(params, x, y, w, np.random.default_rng(9))[0]
    _, grads, _ = net.gradients(params, x, y, w, np.random.default_rng(9))
    for p, g in zip(params, grads):
        assert set(p) == set(g)
        for k in p:
            for at in [tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(6)]:
                old, e = p[k][at], 1e-6
                p[k][at] = old + e
                up = loss()
                p[k][at] = old - e
                down = loss()
                p[k][at] = old
                assert abs((up - down) / (2 * e) - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def test_branches_are_apart():
    """A branch's first layer never sees the other's columns."""
    net = SPECS["two"].net(5)
    assert [layer.inputs for layer in net.layers] == [2, 6, 3, 6, 8]
    params = net.start(0)
    x = np.random.default_rng(0).normal(0, 1, (10, 5))
    other = x.copy()
    other[:, [1, 3, 4]] += 5
    running = [{"mean": np.zeros(s.units), "var": np.ones(s.units)} if s.norm else {} for s in net.layers]
    a, b = (net.forward(params, v, running)[1] for v in (x, other))
    assert (a[1]["z"] == b[1]["z"]).all() and (a[3]["z"] != b[3]["z"]).any()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, 1500)
    x = rng.normal(0, 1, (1500, 5))
    x[:, 0] += 3 * (label == 0)
    x[:, 1] += 3 * (label == 1)
    df = pd.DataFrame(x, columns=list("abcde")).assign(label=label, fid=np.arange(1500), held=rng.random(1500) < 0.2, weight=np.where(label == 2, 2.0, 1.0))
    return spark.createDataFrame(df).select("fid", "label", "held", "weight", array_to_vector(F.array(*"abcde")).alias("features")).persist()


def test_sums_do_not_depend_on_tasks(rows):
    """One full-batch epoch of a net without normalisation: blocks' sums are the table's."""
    spec = Network(trunk=(6,), dropout=(), trunk_norm=False, batch=10_000, epochs=1, classes=3)
    a, b = spec.fit(rows), spec.fit(rows.repartition(7, "fid"))
    for p, q in zip(a.params, b.params):
        for k in p:
            np.testing.assert_allclose(p[k], q[k], atol=1e-9)
    assert abs(a.curve[0][1] - b.curve[0][1]) < 1e-9


@pytest.mark.parametrize("name", ["normed", "two"])
def test_learns_and_stops(spark, rows, name):
    from dataclasses import replace

    spec = replace(SPECS[name], epochs=60, rate=0.01, batch=100, patience=4, validation="held")
    model = spec.fit(rows)
    held = [v for _, _, v in model.curve]
    assert model.best_epoch == int(np.argmin(held)) and (len(held) == 60 or len(held) - 1 == model.best_epoch + 4)
    scored = model.transform(rows.where("held"))
    p = np.array([r[0] for r in scored.select("probability").collect()])
    y, w = np.array([r[0] for r in scored.select("label").collect()]), np.array([r[0] for r in scored.select("weight").collect()])
    np.testing.assert_allclose(p.sum(1), 1, atol=1e-9)
    assert abs((-np.log(p[np.arange(len(y)), y]) * w).sum() / w.sum() - min(held)) < 1e-9
    assert evaluate.scores(scored).first()["macro_f1"] > 0.85
    assert not [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("slices-")]


def test_needs_rows(rows):
    with pytest.raises(ValueError, match="no row"):
        Network(classes=3).fit(rows.limit(0))


def test_slices_hold_every_row_once(rows):
    rng = np.random.default_rng(0)
    batch = network.pa.RecordBatch.from_pydict(
        {"block": [5] * 50, "x": [[float(i)] for i in range(50)], "label": [0] * 50, "weight": [1.0] * 50, "held": rng.random(50) < 0.2}
    )
    out = next(network._dealt(4)(iter([batch]))).to_pylist()
    assert sorted(v for r in out for v in np.frombuffer(r["x"])) == list(range(50))
    assert sorted({r["slice"] for r in out}) == [-1, 0, 1, 2, 3]


def test_a_slice_is_several_tasks_and_stored_apart(spark, rows, monkeypatch):
    """While cores are free a slice is more than one task, and no task passes over the rows of other slices."""
    seen = {}

    def kept(self, net, kept, slices):
        folder = shared_dir(spark).removeprefix("file:")
        (at,) = [f for f in os.listdir(folder) if f.startswith("slices-")]
        seen.update(folders=sorted(f for f in os.listdir(f"{folder}/{at}") if f.startswith("slice=")), tasks=[kept[s].getNumPartitions() for s in range(slices)])
        seen["rows"] = sum(len(np.frombuffer(r["label"], np.int32)) for s in range(slices) for r in kept[s].collect())

    monkeypatch.setattr(Network, "_train", kept)
    Network(batch=700, classes=3).fit(rows.repartition(8, "fid"))
    assert seen["folders"] == ["slice=0", "slice=1"] and min(seen["tasks"]) > 1 and seen["rows"] == 1500


@pytest.mark.parametrize("name", ["normed", "two"])
def test_few_rows_take_an_epoch_in_one_task(rows, monkeypatch, name):
    """The same steps as with a job for each, in one job an epoch."""
    from dataclasses import replace

    spec, jobs, real = replace(SPECS[name], epochs=3, batch=100, validation="held"), [], network._summed
    monkeypatch.setattr(network, "_summed", lambda *a: jobs.append(1) or real(*a))
    alone = spec.fit(rows)
    assert not jobs  # steps are taken in the task
    monkeypatch.setattr(network, "ALONE", 0, raising=False)
    stepped = spec.fit(rows)
    assert len(jobs) == 3 * (rows.where("NOT held").count() // 100) and alone.best_epoch == stepped.best_epoch
    np.testing.assert_allclose(alone.curve, stepped.curve, atol=1e-9)
    for p, q in zip([*alone.params, *alone.running], [*stepped.params, *stepped.running]):
        for k in p:
            np.testing.assert_allclose(p[k], q[k], atol=1e-9)
