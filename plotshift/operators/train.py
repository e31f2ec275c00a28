"""Distributed classifiers on Spark ML behind one interface: ``fit(...)`` gives a model whose ``transform`` adds
``probability`` (array of one share per class) and ``pred`` (the largest, lowest class on ties)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plotshift.operators.evaluate import argmax_array, scores, with_sample_weights
from plotshift.session import materialize, materialize_at, remove
from plotshift.vocabulary import SEED

CLASSES = 6
#: Mean rows of a trainer's task at most.
ROWS_AT_ONCE = 1 << 18


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Columns to one vector; a missing value is an error."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` (``features`` among them) of a trainer's rows, in even tasks of at most ``ROWS_AT_ONCE`` rows on average.

    Splits of a scan are cut by bytes, so a well compressed table of any number of rows may come in a few tasks, each of
    which a trainer keeps and reads again for every level. Tables with few rows a task stay as they are. Rows of a task
    are in the order of their ids, so draws by position come out the same each time.
    """
    df, key = df.select(*columns), "fid" if "fid" in columns else next(c for c in columns if c != "features")
    n = df.count()
    if n <= ROWS_AT_ONCE * df.rdd.getNumPartitions():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * -(-n // (cores * ROWS_AT_ONCE))
    return df.repartition(tasks, key, F.xxhash64(vector_to_array("features"))).sortWithinPartitions(key)


def _with_prediction(df: DataFrame, probability: Column) -> DataFrame:
    df = df.withColumn("probability", probability)
    return df.withColumn("pred", argmax_array(F.col("probability")))


class NativeModel:
    """A Spark ML model that already yields one probability per class."""

    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df.drop("probability", "rawPrediction", "prediction"))
        return _with_prediction(out, vector_to_array("probability")).drop("rawPrediction", "prediction")

    def importances(self) -> np.ndarray:
        return self.model.featureImportances.toArray()

    def curve(self) -> list[float]:
        return list(self.model.summary.objectiveHistory)


class OneVsRestModel:
    """One binary model per class; class shares by softmax over their margins."""

    def __init__(self, models: list, scale: float):
        self.models, self.scale = models, scale

    def margins(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with one margin per class, as array ``out``."""
        k = len(self.models)
        for c, m in enumerate(self.models):
            m = m.copy().setRawPredictionCol(f"_raw{c}").setPredictionCol("")
            if m.hasParam("probabilityCol"):
                m = m.setProbabilityCol("")
            df = m.transform(df)
        margins = F.array(*[F.get(vector_to_array(f"_raw{c}"), F.lit(1)) * self.scale for c in range(k)])
        return df.withColumn(out, margins).drop(*[f"_raw{c}" for c in range(k)])

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.margins(df.drop("probability"), "_m")
        out = out.withColumn("_e", F.expr("transform(_m, v -> exp(v - array_max(_m)))"))
        share = F.expr("transform(_e, v -> v / aggregate(_e, 0D, (s, x) -> s + x))")
        return _with_prediction(out, share).drop("_m", "_e")

    def importances(self) -> np.ndarray:
        return np.mean([m.featureImportances.toArray() for m in self.models], axis=0)

    def curve(self, df: DataFrame, label: str = "label") -> list[float]:
        """Mean binary loss over the classes after each boosting round."""
        rounds = [
            m.evaluateEachIteration(df.withColumn("_y", (F.col(label) == c).cast("double")))
            for c, m in enumerate(self.models)
        ]
        n = min(len(r) for r in rounds)
        return [float(np.mean([r[i] for r in rounds])) for i in range(n)]


def one_vs_rest(df: DataFrame, make: Callable, label: str, classes: int, scale: float, parallelism: int = 3, keep: bool = True) -> OneVsRestModel:
    """Fit one binary model per class, a few at a time, all on the same cached rows.

    ``keep=False`` leaves wide rows that are cheap to derive to the trainer, which keeps them as its own blocks anyway.
    """
    cached_here = keep and not df.is_cached
    if cached_here:
        df = dealt(df, *df.columns).persist()
    try:
        fit = lambda c: make().setLabelCol("_y").fit(df.withColumn("_y", (F.col(label) == c).cast("double")))
        with ThreadPool(parallelism) as pool:
            models = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(classes))
    finally:
        if cached_here:
            df.unpersist()
    return OneVsRestModel(models, scale)


@dataclass(frozen=True)
class Boosting:
    """Gradient-boosted trees. ``validation`` names a boolean column whose true rows stop the boosting early."""

    rounds: int = 25
    depth: int = 4
    rate: float = 0.05
    subsample: float = 0.75
    features_share: str = "all"
    bins: int = 32
    min_rows: int = 1
    min_gain: float = 0.0
    weight: str | None = None
    validation: str | None = None
    classes: int = CLASSES

    def fit(self, df: DataFrame, label: str = "label") -> OneVsRestModel:
        def make():
            g = GBTClassifier(
                maxIter=self.rounds,
                maxDepth=self.depth,
                stepSize=self.rate,
                subsamplingRate=self.subsample,
                featureSubsetStrategy=self.features_share,
                maxBins=self.bins,
                minInstancesPerNode=self.min_rows,
                minInfoGain=self.min_gain,
                seed=SEED,
                cacheNodeIds=True,
            )
            if self.weight:
                g = g.setWeightCol(self.weight)
            if self.validation:
                g = g.setValidationIndicatorCol(self.validation)
            return g

        return one_vs_rest(df, make, label, self.classes, scale=2.0)


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    depth: int = 10
    weight: str | None = "weight"

    def fit(self, df: DataFrame, label: str = "label") -> NativeModel:
        rf = RandomForestClassifier(labelCol=label, numTrees=self.trees, maxDepth=self.depth, seed=SEED)
        return NativeModel((rf.setWeightCol(self.weight) if self.weight else rf).fit(df))


@dataclass(frozen=True)
class Logistic:
    rounds: int = 500
    weight: str | None = None

    def fit(self, df: DataFrame, label: str = "label") -> NativeModel:
        lr = LogisticRegression(labelCol=label, maxIter=self.rounds, family="multinomial", regParam=1e-4)
        return NativeModel((lr.setWeightCol(self.weight) if self.weight else lr).fit(df))


@dataclass(frozen=True)
class Perceptron:
    """Dense net; classes are balanced by copying rows of rare ones."""

    hidden: tuple[int, ...] = (128, 64, 32)
    rounds: int = 100
    classes: int = CLASSES

    def fit(self, df: DataFrame, label: str = "label") -> NativeModel:
        rows = balanced_copies(df, label)
        width = len(df.select("features").first()[0])
        net = MultilayerPerceptronClassifier(
            labelCol=label, layers=[width, *self.hidden, self.classes], maxIter=self.rounds, seed=SEED, blockSize=128
        )
        return NativeModel(net.fit(rows))


def balanced_copies(df: DataFrame, label: str, key: str = "fid") -> DataFrame:
    """Repeat rows in proportion to their class weight; the largest class keeps one copy of each."""
    weighted = with_sample_weights(df, label, "_w")
    least = weighted.agg(F.min("_w")).first()[0]
    w = F.col("_w") / least
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 20)) / (1 << 20)
    copies = (F.floor(w) + (draw < w - F.floor(w)).cast("int")).cast("int")
    return weighted.withColumn("_n", F.explode(F.sequence(F.lit(1), copies))).drop("_n", "_w")


@dataclass(frozen=True)
class FourierSVM:
    """Kernel machine with a Gaussian kernel, approximated by random cosine features and linear machines.

    Margins become probabilities by one sigmoid per class, fitted on margins of rows that the machine behind them has not
    seen (``folds`` parts, equal feature vectors in one part), and divided by their sum.
    """

    components: int = 256
    rounds: int = 50
    penalty: float = 1e-3
    folds: int = 3
    classes: int = CLASSES

    def fit(self, df: DataFrame, label: str = "label") -> "FourierModel":
        width = len(df.select("features").first()[0])
        rng = np.random.default_rng(SEED)
        # Kernel width 1/features, the usual choice for scaled columns.
        w = rng.normal(0, math.sqrt(2 / width), (width, self.components))
        b = rng.uniform(0, 2 * math.pi, self.components)
        lift = lambda rows: _fourier(rows, w, b)  # derived anew for every fit: the features are kept, not their components
        make = lambda: LinearSVC(featuresCol="_lifted", maxIter=self.rounds, regParam=self.penalty)
        part = F.pmod(F.xxhash64(vector_to_array("features")), F.lit(self.folds)).cast("int")
        rows = df.select("features", label).withColumn("_part", part).persist()
        try:
            fit = lambda some: one_vs_rest(lift(some), make, label, self.classes, scale=1.0, parallelism=1, keep=False)
            unseen = None
            for k in range(self.folds):
                held = fit(rows.where(F.col("_part") != k)).margins(lift(rows.where(F.col("_part") == k)), "margins").select(label, "margins")
                unseen = held if unseen is None else unseen.unionByName(held)
            stored, path = materialize_at(unseen, "margins")
            sigmoids = fit_sigmoids(stored, label, self.classes)
            remove(df.sparkSession, path)
            return FourierModel(fit(rows), lift, sigmoids)
        finally:
            rows.unpersist()


def fit_sigmoids(df: DataFrame, label: str, classes: int, column: str = "margins", steps: int = 50) -> list[tuple[float, float]]:
    """(slope, offset) of each class's sigmoid over its margin, by Newton steps; one aggregate over ``df`` a step, all classes at once.

    Targets are a little inside 0 and 1 by the classes' sizes, so separable classes keep a finite slope. A class without
    rows, or with all of them, has slope 0.
    """
    y = [(F.col(label) == c).cast("double") for c in range(classes)]
    counts = df.agg(F.count("*").alias("n"), *[F.sum(y[c]).alias(f"y{c}") for c in range(classes)]).first()
    n, own = counts["n"], [counts[f"y{c}"] or 0.0 for c in range(classes)]
    target = [F.when(y[c] == 1, F.lit((own[c] + 1) / (own[c] + 2))).otherwise(F.lit(1 / (n - own[c] + 2))) for c in range(classes)]
    now = [(0.0, math.log((own[c] + 1) / (n - own[c] + 1))) for c in range(classes)]
    last, move, best = [math.inf] * classes, [np.zeros(2)] * classes, list(now)
    for _ in range(steps):
        sums = []
        for c, (slope, offset) in enumerate(now):
            m = F.get(column, F.lit(c))
            z = m * slope + offset
            p = 1 / (1 + F.exp(-z))
            # loss as log(1 + exp(-|z|)) + max(z, 0) - t z
            loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - target[c] * z
            d, h = p - target[c], p * (1 - p)
            sums += [F.sum(v).alias(f"{k}{c}") for k, v in (("l", loss), ("gm", d * m), ("g", d), ("hmm", h * m * m), ("hm", h * m), ("h", h))]
        row, moving = df.agg(*sums).first(), False
        for c in range(classes):
            if not 0 < own[c] < n:
                continue
            loss = row[f"l{c}"]
            if loss > last[c] + 1e-9 * abs(last[c]):  # too far: half the way back
                move[c] = move[c] / 2
                now[c] = tuple(np.array(best[c]) - move[c])
                moving = moving or np.abs(move[c]).max() > 1e-9
                continue
            best[c], done = now[c], last[c] - loss < 1e-10 * max(1.0, abs(loss))
            last[c] = loss
            if not done:
                h = np.array([[row[f"hmm{c}"], row[f"hm{c}"]], [row[f"hm{c}"], row[f"h{c}"]]]) + 1e-9 * np.eye(2)
                move[c] = np.linalg.solve(h, [row[f"gm{c}"], row[f"g{c}"]])
                now[c], moving = tuple(np.array(now[c]) - move[c]), True
        if not moving:
            break
    return [(float(a), float(b)) for a, b in best]


class FourierModel:
    def __init__(self, inner: OneVsRestModel, lift: Callable, sigmoids: list[tuple[float, float]]):
        self.inner, self.lift, self.sigmoids = inner, lift, sigmoids

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.margins(self.lift(df.drop("probability")), "_m").drop("_lifted")
        shares = [1 / (1 + F.exp(-(F.get("_m", F.lit(c)) * a + b))) for c, (a, b) in enumerate(self.sigmoids)]
        out = out.withColumn("_p", F.array(*shares))
        return _with_prediction(out, F.expr("transform(_p, v -> v / aggregate(_p, 0D, (s, x) -> s + x))")).drop("_m", "_p")


def _fourier(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    factor = math.sqrt(2 / w.shape[1])

    @F.arrow_udf(ArrayType(DoubleType()))
    def cosines(x: pa.Array) -> pa.Array:
        z = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) @ w if len(x) else np.empty((0, w.shape[1]))
        z += b
        np.cos(z, out=z)
        z *= factor
        return pa.ListArray.from_arrays(np.arange(0, z.size + 1, w.shape[1], dtype=np.int32), z.ravel())

    return df.withColumn("_lifted", array_to_vector(cosines(vector_to_array("features"))))


@dataclass(frozen=True)
class AdaBoost:
    """Multi-class adaptive boosting (SAMME) of small trees, starting from balanced row weights."""

    rounds: int = 50
    depth: int = 3
    rate: float = 0.1
    classes: int = CLASSES
    checkpoint_every: int = 5

    def fit(self, df: DataFrame, label: str = "label") -> "AdaModel":
        rows = with_sample_weights(df.drop("weight", "_w"), label, "_w").select("fid", "features", label, "_w")
        rows = materialize(rows, "boost")
        members, errors = [], []
        for r in range(self.rounds):
            tree = DecisionTreeClassifier(
                labelCol=label, weightCol="_w", maxDepth=self.depth, seed=SEED, predictionCol="_p",
                rawPredictionCol="", probabilityCol="",
            ).fit(rows)
            judged = tree.transform(rows).withColumn("_miss", (F.col("_p") != F.col(label)).cast("double"))
            total, wrong = judged.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_miss"))).first()
            error = wrong / total
            if error >= 1 - 1 / self.classes:
                break
            alpha = self.rate * (math.log((1 - error) / max(error, 1e-12)) + math.log(self.classes - 1))
            members.append((alpha, tree))
            errors.append(error)
            if error <= 0:
                break
            # Weights are kept at a mean of one, so that they neither overflow nor vanish.
            scale = 1 / (total + wrong * (math.exp(alpha) - 1))
            new = F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) * F.lit(scale * total)
            rows = judged.withColumn("_w", new).drop("_p", "_miss")
            if (r + 1) % self.checkpoint_every == 0:
                rows = materialize(rows, "boost")
        return AdaModel(members, errors, self.classes)


class AdaModel:
    def __init__(self, members, errors, classes):
        self.members, self.errors, self.classes = members, errors, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop("probability")
        for i, (_, tree) in enumerate(self.members):
            out = tree.copy().setPredictionCol(f"_p{i}").setRawPredictionCol("").setProbabilityCol("").transform(out)
        total = sum(a for a, _ in self.members)
        share = lambda c: sum((F.lit(a / total) * (F.col(f"_p{i}") == c).cast("double") for i, (a, _) in enumerate(self.members)), F.lit(0.0))
        out = _with_prediction(out, F.array(*[share(c) for c in range(self.classes)]))
        return out.drop(*[f"_p{i}" for i in range(len(self.members))])


@dataclass(frozen=True)
class Neighbors:
    """Nearest-neighbour vote: within ``radius``, or of the ``k`` nearest when no radius is given."""

    columns: tuple[str, ...]
    radius: float | None = 1.0
    k: int = 5
    weights: str = "distance"
    classes: int = CLASSES

    def fit(self, df: DataFrame, label: str = "label") -> "NeighborsModel":
        return NeighborsModel(self, df.select("fid", label, *self.columns), label)


class NeighborsModel:
    def __init__(self, spec: Neighbors, rows: DataFrame, label: str):
        self.spec, self.rows, self.label = spec, rows, label

    def transform(self, df: DataFrame) -> DataFrame:
        from plotshift.operators import neighbors as N

        cols, spec = list(self.spec.columns), self.spec
        data, asking = N.points(self.rows, cols, value=self.label), N.points(df, cols)
        if spec.radius is not None:
            votes = N.radius_probabilities(data, asking, spec.radius, spec.classes, len(cols))
        else:
            votes = N.knn_probabilities(data, asking, spec.k, spec.classes, len(cols), spec.weights)
        out = df.drop("probability").join(votes.withColumnRenamed("id", "fid"), "fid")
        return _with_prediction(out, F.col("probability"))


def cross_validate(df: DataFrame, models: dict[str, object], label: str = "label", folds: int = 5, keep: DataFrame | None = None):
    """(scores per model and fold, scored ``keep`` rows).

    ``df`` carries a ``fold`` column. The rows of ``keep`` get ``p_{model}``, the mean probability over the folds; the
    folds are averaged inside each row, so no table of probabilities is shuffled. A model with ``patience`` stops by the
    loss of the fold that is held out.
    """
    results, scored = None, keep
    for name, spec in models.items():
        parts = []
        for f in range(folds):
            if getattr(spec, "patience", None):
                model = replace(spec, validation="_held").fit(df.withColumn("_held", F.col("fold") == f), label)
            else:
                model = spec.fit(df.where(F.col("fold") != f), label)
            held = model.transform(df.where(F.col("fold") == f)).select(
                F.lit(name).alias("model"), F.lit(f).alias("fold"), F.col(label).cast("int").alias("label"), "pred"
            )
            results = held if results is None else results.unionByName(held)
            if scored is not None:
                part = f"_{name}_{f}"
                scored = model.transform(scored).withColumnRenamed("probability", part).drop("pred")
                parts.append(part)
        if scored is not None:
            mean = lambda c: sum((F.get(p, c) for p in parts[1:]), F.get(parts[0], c)) / folds
            scored = scored.withColumn(f"p_{name}", F.transform(parts[0], lambda _, c: mean(c))).drop(*parts)
    return scores(results, "label", "pred", ("model", "fold")), scored


def pca(fit: DataFrame, apply: DataFrame, k: int | None = None, share: float | None = None, column: str = "features", out: str = "pca"):
    """Project centred vectors on ``k`` components, or on the fewest that explain more than ``share`` of the variance.

    Returns the projected frame and the explained-variance shares of the components kept.
    """
    centre = StandardScaler(inputCol=column, outputCol="_centred", withMean=True, withStd=False).fit(fit)
    width = len(fit.select(column).first()[0])
    model = PCA(k=k or width, inputCol="_centred", outputCol=out).fit(centre.transform(fit))
    variance = [float(v) for v in model.explainedVariance]
    keep = k or next((i + 1 for i, v in enumerate(np.cumsum(variance)) if v > share), width)
    projected = model.transform(centre.transform(apply)).withColumn(out, F.slice(vector_to_array(out), 1, keep))
    return projected.drop("_centred"), variance[:keep]


def top_features(spark, importances: np.ndarray, names: list[str], n: int = 10) -> DataFrame:
    """(feature, importance), largest first."""
    rows = spark.createDataFrame(list(zip(names, map(float, importances))), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(n)
