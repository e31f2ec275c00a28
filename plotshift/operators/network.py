"""Dense nets with branches, trained by gradient sums over stored partitions.

Branches read columns of their own and are joined in front of a trunk; a layer is dense, activated, then (optionally)
normalised over its batch and thinned by dropout. Rows are dealt once into at most ``SLICES`` slices of every stored block.
A step is one job over one slice: each block goes forward and back through the net, tasks add up gradients of the weighted
loss, and the driver, which holds the parameters and nothing of the data, takes an Adam step. So an epoch reads every row
once, and a step has as many tasks as its slice has blocks. Where all rows are few (``ALONE`` a slice), a job for each step
costs more than its work: one task then takes an epoch's steps itself, in the same order. After an epoch the loss of the held rows is summed; ``patience``
epochs without a better one end the training, and the best epoch's parameters are kept.

Normalisation uses the mean and variance of a block's rows of the slice, and running means of them when predicting, so no
step waits for a second exchange; with small blocks it is the noisier for it. Dropout masks are drawn from the seed, step
and block, so a task that runs again gives the same sums.

Defined cases: rows without a label are left out; rows whose ``validation`` flag is true are never learned from; a missing
value is an error of the caller (fill it before); an empty training set is an error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plotshift.session import remove, shared_dir
from plotshift.vocabulary import SEED

CLASSES = 6
#: Rows of a stored block, slices of the rows at most, and rows of a slice that are worth a task while cores are free.
BLOCK, SLICES, TASK = 1 << 14, 64, 1 << 9
#: Mean rows of a slice up to which one task takes all steps of an epoch, and tasks whose sums the driver adds up itself.
ALONE, STRAIGHT = 1 << 11, 64
HELD, ALL = -1, -2
ROWS = "slice int, block long, x binary, label binary, weight binary"
#: Usual constants of batch normalisation and Adam.
EPS, MOMENTUM, BETA1, BETA2, TINY = 1e-3, 0.9, 0.9, 0.999, 1e-7


def _sigmoid(z):
    s = np.clip(z, -500, 500)
    np.exp(np.negative(s, out=s), out=s)
    s += 1
    return np.reciprocal(s, out=s)


def _swish(z):
    s = _sigmoid(z)
    return z * s, lambda: s * (1 + z * (1 - s))


#: Output, and its slope when it is asked for.
ACTIVATIONS = {"relu": lambda z: (np.maximum(z, 0), lambda: z > 0), "swish": _swish}


@dataclass(frozen=True)
class Layer:
    inputs: int
    units: int
    activation: str
    norm: bool
    dropout: float

    def start(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        span = math.sqrt(6 / (self.inputs + self.units))
        out = {"w": rng.uniform(-span, span, (self.inputs, self.units)), "b": np.zeros(self.units)}
        return out | ({"gamma": np.ones(self.units), "beta": np.zeros(self.units)} if self.norm else {})

    def forward(self, p: dict, x: np.ndarray, running: dict | None, rng: np.random.Generator | None) -> tuple[np.ndarray, dict]:
        """Output and what the way back needs; without ``rng`` the net predicts: running means, no dropout."""
        z = x @ p["w"] + p["b"]
        a, slope = ACTIVATIONS[self.activation](z)
        cache = {"x": x, "z": z, "slope": slope}
        if self.norm:
            mean = a.mean(axis=0) if rng is not None else running["mean"]
            hat = a - mean
            var = np.einsum("ij,ij->j", hat, hat) / len(a) if rng is not None else running["var"]
            cache |= {"mean": mean, "var": var, "scale": 1 / np.sqrt(var + EPS), "hat": hat}
            hat *= cache["scale"]
            a = cache["hat"] * p["gamma"] + p["beta"]
        if self.dropout and rng is not None:
            cache["mask"] = np.where(rng.random(a.shape) >= self.dropout, 1 / (1 - self.dropout), 0.0)
            a = a * cache["mask"]
        return a, cache

    def back(self, p: dict, cache: dict, d: np.ndarray, first: bool = False) -> tuple[np.ndarray | None, dict]:
        """Gradients with respect to the input (not asked of a ``first`` layer) and the parameters, from that with respect to the output."""
        out = {}
        if "mask" in cache:
            d = d * cache["mask"]
        if self.norm:
            # gamma is one number per unit, so the means of the scaled gradients follow from the two sums
            out |= {"gamma": np.einsum("ij,ij->j", d, cache["hat"]), "beta": d.sum(axis=0)}
            d = d - out["beta"] / len(d)
            d -= cache["hat"] * (out["gamma"] / len(d))
            d *= cache["scale"] * p["gamma"]
        d = d * cache["slope"]()
        return None if first else d @ p["w"].T, out | {"w": cache["x"].T @ d, "b": d.sum(axis=0)}


@dataclass(frozen=True)
class Net:
    """Layers of the branches, of the trunk, and the output's size; parameters are a dictionary per layer, in that order."""

    columns: tuple[tuple[int, ...], ...]
    branches: tuple[tuple[Layer, ...], ...]
    trunk: tuple[Layer, ...]
    classes: int

    @property
    def layers(self) -> list[Layer]:
        return [*(layer for b in self.branches for layer in b), *self.trunk]

    def start(self, seed: int) -> list[dict[str, np.ndarray]]:
        rng = np.random.default_rng([SEED, seed])
        last = self.trunk[-1].units if self.trunk else self._joined()
        span = math.sqrt(6 / (last + self.classes))
        out = {"w": rng.uniform(-span, span, (last, self.classes)), "b": np.zeros(self.classes)}
        return [*(layer.start(rng) for layer in self.layers), out]

    def _joined(self) -> int:
        return sum(b[-1].units if b else len(c) for b, c in zip(self.branches, self.columns))

    def forward(self, params: list[dict], x: np.ndarray, running: list[dict] | None = None, rng=None) -> tuple[np.ndarray, list[dict], np.ndarray]:
        """Class shares, the layers' caches, and what the output layer got."""
        caches, joined, at = [], [], 0
        for columns, branch in zip(self.columns, self.branches):
            h = x[:, columns]
            for layer in branch:
                h, cache = layer.forward(params[at], h, running and running[at], rng)
                caches.append(cache)
                at += 1
            joined.append(h)
        h = np.concatenate(joined, axis=1)
        for layer in self.trunk:
            h, cache = layer.forward(params[at], h, running and running[at], rng)
            caches.append(cache)
            at += 1
        z = h @ params[at]["w"] + params[at]["b"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), caches, h

    def gradients(self, params: list[dict], x: np.ndarray, label: np.ndarray, weight: np.ndarray, rng) -> tuple[float, list[dict], list[dict]]:
        """Sum of the weighted losses, its gradient, and the means and variances that the layers saw."""
        shares, caches, h = self.forward(params, x, None, rng)
        rows = np.arange(len(label))
        loss = float((-np.log(np.maximum(shares[rows, label], 1e-300)) * weight).sum())
        d = shares.copy()
        d[rows, label] -= 1
        d *= weight[:, None]
        grads = [{}] * len(caches) + [{"w": h.T @ d, "b": d.sum(axis=0)}]
        d = d @ params[-1]["w"].T
        at = len(caches)
        lowest = sum(map(len, self.branches))
        for layer in reversed(self.trunk):
            at -= 1
            d, grads[at] = layer.back(params[at], caches[at], d, at == lowest == 0)
        if not lowest:
            return loss, grads, _statistics(caches)
        ends = np.cumsum([b[-1].units if b else len(c) for b, c in zip(self.branches, self.columns)])
        for branch, part in zip(reversed(self.branches), reversed(np.split(d, ends[:-1], axis=1))):
            for i, layer in reversed(list(enumerate(branch))):
                at -= 1
                part, grads[at] = layer.back(params[at], caches[at], part, i == 0)
        return loss, grads, _statistics(caches)


def _statistics(caches: list[dict]) -> list[dict]:
    return [{k: c[k] for k in ("mean", "var") if k in c} for c in caches]


def _summed(net: Net, params: list[dict], step: int):
    """(loss, weight, rows, gradients, rows x statistics) of a task's blocks."""

    def run(rows: Iterator[Row]) -> Iterator[tuple]:
        total = None
        for row in rows:
            label, weight = np.frombuffer(row["label"], np.int32), np.frombuffer(row["weight"])
            x = np.frombuffer(row["x"]).reshape(len(label), -1)
            loss, grads, seen = net.gradients(params, x, label, weight, np.random.default_rng([SEED, step, row["block"]]))
            part = (loss, float(weight.sum()), len(label), grads, [{k: v * len(label) for k, v in s.items()} for s in seen])
            total = part if total is None else _added(total, part)
        if total is not None:
            yield total

    return run


def _added(a, b):
    if isinstance(a, dict):
        return {k: v + b[k] for k, v in a.items()}
    if isinstance(a, (list, tuple)):
        return type(a)(_added(x, y) for x, y in zip(a, b))
    return a + b


def _total(parts: RDD):
    """Sum over all tasks: by the driver, or in a tree where they are many."""
    return parts.reduce(_added) if parts.getNumPartitions() <= STRAIGHT else parts.treeReduce(_added)


def _order(epoch: int, slices: int) -> list[int]:
    return np.random.default_rng([SEED, epoch]).permutation(slices).tolist()


@dataclass
class _State:
    """Parameters, running statistics, and Adam's moments after ``step`` steps."""

    params: list[dict]
    running: list[dict]
    first: list[dict]
    second: list[dict]
    step: int = 0

    @classmethod
    def start(cls, net: Net, seed: int) -> _State:
        params = net.start(seed)
        running = [{"mean": np.zeros(layer.units), "var": np.ones(layer.units)} if layer.norm else {} for layer in net.layers]
        return cls(params, running, *([{k: np.zeros_like(v) for k, v in p.items()} for p in params] for _ in range(2)))

    def take(self, spec: Network, layers: int, sums: tuple) -> None:
        """A step by the sums of a slice; arrays are replaced, not changed, so earlier ones stay as they are."""
        _, weight, n, grads, seen = sums
        self.step += 1
        rate = spec.rate * spec.decay ** (self.step / spec.decay_steps) * math.sqrt(1 - BETA2**self.step) / (1 - BETA1**self.step)
        self.params = [dict(p) for p in self.params]
        for i, (p, g, m, v) in enumerate(zip(self.params, grads, self.first, self.second)):
            for k in p:
                d = g[k] / weight + (2 * spec.l2 * p[k] if k == "w" and i < layers else 0)
                m[k] = BETA1 * m[k] + (1 - BETA1) * d
                v[k] = BETA2 * v[k] + (1 - BETA2) * d * d
                p[k] = p[k] - rate * m[k] / (np.sqrt(v[k]) + TINY)
        self.running = [{k: MOMENTUM * r[k] + (1 - MOMENTUM) * x[k] / n for k in r} for r, x in zip(self.running, seen)]


def _epoch(spec: Network, net: Net, state: _State, epoch: int, slices: int):
    """All steps of an epoch over the slices' rows in one task: (state after them, losses, weights)."""

    def run(rows: Iterator[Row]) -> Iterator[tuple[_State, float, float]]:
        parts = {}
        for row in rows:
            parts.setdefault(row["slice"], []).append(row)
        losses = weights = 0.0
        for s in _order(epoch, slices):
            for sums in _summed(net, state.params, state.step)(iter(sorted(parts.get(s, []), key=lambda r: r["block"]))):
                losses, weights = losses + sums[0], weights + sums[1]
                state.take(spec, len(net.layers), sums)
        yield state, losses, weights

    return run


def _judged(net: Net, params: list[dict], running: list[dict]):
    def run(rows: Iterator[Row]) -> Iterator[tuple[float, float]]:
        loss = total = 0.0
        for row in rows:
            label, weight = np.frombuffer(row["label"], np.int32), np.frombuffer(row["weight"])
            shares = net.forward(params, np.frombuffer(row["x"]).reshape(len(label), -1), running)[0]
            loss += float((-np.log(np.maximum(shares[np.arange(len(label)), label], 1e-300)) * weight).sum())
            total += float(weight.sum())
        yield loss, total

    return run


def _dealt(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                n, block = part.num_rows, part.column("block")[0].as_py()
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                label, weight = part.column("label").to_numpy().astype(np.int32), part.column("weight").to_numpy().astype(np.float64)
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                dealt = np.where(held, HELD, np.random.default_rng([SEED, block]).permutation(n) % slices)
                out = [(s, block, *(v[dealt == s].tobytes() for v in (x, label, weight))) for s in np.unique(dealt).tolist()]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in ROWS.split(", ")])

    return run


@dataclass(frozen=True)
class Network:
    """Parameters; ``fit`` gives a :class:`NetworkModel`. ``columns`` lists the features of each branch (none: one branch of all)."""

    columns: tuple[tuple[int, ...], ...] | None = None
    branch: tuple[int, ...] = ()
    trunk: tuple[int, ...] = (128, 64, 32)
    dropout: tuple[float, ...] = (0.3, 0.3, 0.2)
    activation: str = "relu"
    branch_norm: bool = True
    trunk_norm: bool = True
    l2: float = 5e-4
    rate: float = 1e-3
    decay: float = 0.95
    decay_steps: int = 1000
    batch: int = 512
    epochs: int = 50
    patience: int | None = 10
    weight: str | None = "weight"
    validation: str | None = None
    classes: int = CLASSES

    def net(self, width: int) -> Net:
        columns = self.columns or (tuple(range(width)),)
        make = lambda sizes, inputs, norm, drop: tuple(
            Layer(i, u, self.activation, norm, d) for i, u, d in zip([inputs, *sizes], sizes, [*drop, *[0.0] * len(sizes)])
        )
        branches = tuple(make(self.branch, len(c), self.branch_norm, ()) for c in columns)
        joined = sum(b[-1].units if b else len(c) for b, c in zip(branches, columns))
        return Net(columns, branches, make(self.trunk, joined, self.trunk_norm, self.dropout), self.classes)

    def fit(self, df: DataFrame, label: str = "label") -> NetworkModel:
        held = F.coalesce(F.col(self.validation), F.lit(False)) if self.validation else F.lit(False)
        rows = df.where(F.col(label).isNotNull()).select(
            F.monotonically_increasing_id().alias("block"), vector_to_array("features").alias("x"), F.col(label).cast("int").alias("label"),
            (F.col(self.weight) if self.weight else F.lit(1.0)).cast("double").alias("weight"), held.alias("held"),
        )
        n = rows.where("NOT held").count()
        if not n:
            raise ValueError("no row to learn from")
        width = len(df.select("features").first()[0])
        slices = max(1, min(SLICES, n // self.batch))
        cores = df.sparkSession.sparkContext.defaultParallelism
        tasks = max(-(-n // (slices * BLOCK)), min(cores, -(-n // (slices * TASK))))
        # A folder per slice: its rows are read without passing over the others'.
        part = F.pmod(F.xxhash64("block"), F.lit(tasks))
        dealt = rows.mapInArrow(_dealt(slices), ROWS).repartition(max(4 * cores, -(-n // BLOCK)), "slice", part)
        path = f"{shared_dir(df.sparkSession).rstrip('/')}/slices-{uuid.uuid4().hex}"
        dealt.sortWithinPartitions("slice", "block").write.partitionBy("slice").parquet(path)
        blocks = df.sparkSession.read.schema(dealt.schema).parquet(path)
        kept = _Kept(lambda s: _kept(blocks.where(F.col("slice") == s), max(tasks, cores if s == HELD else 1)))
        if n <= slices * ALONE:
            kept[ALL] = _kept(blocks.where(F.col("slice") != HELD), 1)
        try:
            return self._train(self.net(width), kept, slices)
        finally:
            for r in kept.values():
                r.unpersist()
            remove(df.sparkSession, path)

    def _train(self, net: Net, kept: dict[int, RDD], slices: int) -> NetworkModel:
        state, best = _State.start(net, self.epochs), (math.inf, -1)
        model = NetworkModel(net, state.params, state.running)
        for epoch in range(self.epochs):
            losses = weights = 0.0
            if ALL in kept:
                state, losses, weights = kept[ALL].mapPartitions(_epoch(self, net, state, epoch, slices)).collect()[0]
            else:
                for s in _order(epoch, slices):
                    sums = _total(kept[s].mapPartitions(_summed(net, state.params, state.step)))
                    losses, weights = losses + sums[0], weights + sums[1]
                    state.take(self, len(net.layers), sums)
            held = math.nan
            if self.validation:
                loss, total = _total(kept[HELD].mapPartitions(_judged(net, state.params, state.running)))
                held = loss / total if total else math.nan
            model.curve.append((epoch, losses / weights, held))
            if not self.validation or held < best[0]:
                best, model.params, model.running, model.best_epoch = (held, epoch), state.params, state.running, epoch
            elif self.patience and epoch - best[1] >= self.patience:
                break
        return model


class _Kept(dict):
    """Rows of the slices, each read when it is first asked for."""

    def __init__(self, read):
        self.read = read

    def __missing__(self, s: int) -> RDD:
        self[s] = self.read(s)
        return self[s]


def _kept(blocks: DataFrame, tasks: int) -> RDD:
    rows = blocks.rdd
    return (rows.coalesce(tasks) if rows.getNumPartitions() > tasks else rows).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class NetworkModel:
    """``curve``: (epoch, mean loss while learning, loss of the held rows)."""

    net: Net
    params: list[dict]
    running: list[dict]
    curve: list[tuple[int, float, float]] = field(default_factory=list)
    best_epoch: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        from plotshift.operators.train import _with_prediction

        net, params, running = self.net, self.params, self.running

        @F.pandas_udf(ArrayType(DoubleType()))
        def shares(x: pd.Series) -> pd.Series:
            return pd.Series(list(net.forward(params, np.vstack(x.to_numpy()), running)[0])) if len(x) else x

        return _with_prediction(df.drop("probability"), shares(vector_to_array("features")))
