"""Effects of features on the predictions of trees, and boosting that stops early.

Effects are interventional Shapley values: a feature that is not yet known has a background row's value. A leaf
is met by a mixture of a row and a background row if each feature on its path lets through the one that the mixture
takes it from. So features that both pass don't matter, a feature that neither passes closes the leaf, and with u that only
the row passes and v that only the background row does, the leaf's share in each effect is known without mixing: the
former get its value times (u - 1)! v! / (u + v)!, the latter lose it times u! (v - 1)! / (u + v)!. Background rows
that pass the same features of a leaf are one, so a leaf is a few products of matrices for a batch of rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .explain import BACKGROUND
from .models import Features, estimator, inner_split

#: Nodes of an explained model, at most: what every task is sent.
NODES = 2_000_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, categories array<double>, left int, right int, value double"


def node_table(model: object) -> DataFrame:
    """NODE_SCHEMA of a fitted forest, boosted model or tree: its saved form, as a table. Values are scaled to add up over trees.

    feature is -1 in leaves; categories, of a categorical split, are those that go left.
    """
    spark = SparkSession.active()
    path = scratch_path(spark)
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata")
        tree, _, weight = weights.columns
        scale = F.col("__w") if isinstance(model, GBTRegressionModel) else F.lit(1.0 / len(model.trees))
        data = data.join(F.broadcast(weights.select(F.col(tree).alias("treeID"), F.col(weight).alias("__w"))), "treeID").select(F.col("treeID").alias("tree"), "nodeData.*", scale.alias("scale"))  # a row for each tree
    else:
        data = data.withColumns({"tree": F.lit(0), "scale": F.lit(1.0)})
    split = F.col("split")
    continuous = split["numCategories"] < 0
    left = split["leftCategoriesOrThreshold"]
    return data.select(
        "tree", F.col("id").alias("node"), F.when(F.col("leftChild") < 0, -1).otherwise(split["featureIndex"]).alias("feature"), F.when(continuous, F.get(left, F.lit(0))).alias("threshold"),
        F.when(~continuous & (F.col("leftChild") >= 0), left).alias("categories"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), (F.col("prediction") * F.col("scale")).alias("value"))


class Leaf(NamedTuple):
    """What a leaf adds to a prediction, the features on its path, and by feature the (split, whether left) that it takes."""

    value: float
    features: np.ndarray
    turns: list[list[tuple[int, bool]]]
    #: Distinct rows of which features background rows pass, and the share of background rows of each.
    passed: np.ndarray
    share: np.ndarray


class Walk:
    """The leaves of a model against a background, as tasks need them."""

    def __init__(self, nodes: list, ground: np.ndarray) -> None:
        trees = defaultdict(dict)
        for r in nodes:
            trees[r["tree"]][r["node"]] = r
        self.splits = [r for t in trees.values() for r in t.values() if r["feature"] >= 0]
        number = {(r["tree"], r["node"]): i for i, r in enumerate(self.splits)}
        self.splits = [(r["feature"], r["threshold"], None if r["categories"] is None else np.array(r["categories"])) for r in self.splits]
        left, self.leaves, self.base = self.turned(ground), [], 0.0
        for t, own in trees.items():
            todo = [(0, {})]
            while todo:
                node, path = todo.pop()
                r = own[node]
                if r["feature"] >= 0:
                    for child, goes in ((r["left"], True), (r["right"], False)):
                        todo.append((child, {**path, r["feature"]: [*path.get(r["feature"], []), (number[t, node], goes)]}))
                    continue
                turns = list(path.values())
                patterns, counts = np.unique(self.passing(left, turns), axis=0, return_counts=True) if turns else (np.ones((1, 0)), np.array([len(ground)]))
                leaf = Leaf(r["value"], np.array(list(path), dtype=np.int64), turns, patterns.astype(float), counts / len(ground))
                self.base += leaf.value * leaf.share[patterns.all(axis=1)].sum()
                self.leaves.append(leaf)
        most = 1 + max((len(x.features) for x in self.leaves), default=0)
        of = lambda a, b: factorial(a) * factorial(b) / factorial(a + b + 1)
        self.gains = np.array([[of(u - 1, v) if u else 0.0 for v in range(most)] for u in range(most)])

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Whether each row (rows, splits) goes left."""
        out = np.zeros((len(x), len(self.splits)), bool)
        for i, (f, threshold, categories) in enumerate(self.splits):
            out[:, i] = x[:, f] <= threshold if categories is None else np.isin(x[:, f], categories)
        return out

    @staticmethod
    def passing(left: np.ndarray, turns: list[list[tuple[int, bool]]]) -> np.ndarray:
        """Whether each row passes each feature of a leaf's path."""
        out = np.ones((len(left), len(turns)), bool)
        for i, own in enumerate(turns):
            for split, goes in own:
                out[:, i] &= left[:, split] == goes
        return out

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effects by row and feature, predictions)."""
        left, out, predicted = self.turned(x), np.zeros(x.shape), np.zeros(len(x))
        for leaf in self.leaves:
            own = self.passing(left, leaf.turns).astype(float)
            predicted += leaf.value * own.all(axis=1)
            if not len(leaf.features):
                continue
            ground = leaf.passed
            u, v = (own @ (1 - ground).T).astype(np.int64), ((1 - own) @ ground.T).astype(np.int64)
            open_ = ((1 - own) @ (1 - ground).T == 0) * leaf.share
            gain, loss = (self.gains[u, v] * open_) @ (1 - ground), (self.gains[v, u] * open_) @ ground
            out[:, leaf.features] += leaf.value * (own * gain - (1 - own) * loss)
        return out, predicted


def tree_effects(rows: DataFrame, key: str, nodes: DataFrame, background: DataFrame, names: list[str]) -> DataFrame:
    """(key, feature, effect, base, predicted): a row for each named feature of each row; key is unique.

    rows and background have `features`, an array of doubles. names name its places; effects of places of one name,
    such as those of an encoded column, are added up. Base and effects add up to the prediction.
    """
    spark = rows.sparkSession
    ground = np.array([r[0] for r in background.select("features").limit(BACKGROUND + 1).collect()], dtype=float)
    if not 0 < len(ground) <= BACKGROUND:
        raise ValueError(f"the background needs 1 to {BACKGROUND} rows")
    table = nodes.limit(NODES + 1).collect()
    if len(table) > NODES:
        raise ValueError(f"a model of more than {NODES} nodes")
    shared = spark.sparkContext.broadcast(Walk(table, ground))
    raw = list(dict.fromkeys(names))
    place = np.array([raw.index(n) for n in names])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                effects, predicted = walk.effects(x)
                summed = np.zeros((len(x), len(raw)))
                np.add.at(summed.T, place, effects.T)
                each = np.repeat(np.arange(len(x)), len(raw))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(each)), pa.array(raw * len(x)), pa.array(summed.ravel()), pa.array(np.full(len(each), walk.base)), pa.array(predicted[each])],
                    names=[key, "feature", "effect", "base", "predicted"])

    return rows.select(key, "features").mapInArrow(explain, f"{key} {dict(rows.dtypes)[key]}, feature string, effect double, base double, predicted double")


def encoded_names(df: DataFrame, raw: list[str], vector: str = "features") -> list[str]:
    """For each place of an assembled vector the raw column it comes of: that whose name, and a separator, is the longest that the place's name starts with."""
    attributes = df.schema[vector].metadata["ml_attr"]
    found = sorted((a["idx"], a["name"]) for kind in attributes["attrs"].values() for a in kind)
    of = lambda name: max((c for c in raw if name == c or name.startswith(f"{c}__")), key=len, default=name)
    return [of(name) for _, name in found]


def model_effects(bundle, rows: DataFrame, key: str, background: DataFrame) -> DataFrame:
    """tree_effects of a saved bundle's forest or boosted model, by raw feature. Of a logged target, effects are on its logarithm."""
    prepared = bundle.features(rows)
    named = encoded_names(prepared, bundle.metadata["feature_names"])
    arrays = lambda df: df.withColumn("features", vector_to_array("features"))
    return tree_effects(arrays(prepared), key, node_table(bundle.model), arrays(bundle.features(background)), named)


# Boosting that stops early


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds to keep, whether the search is over): the first round of least error before `patience` rounds without a lesser one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of a boosted model's first n rounds."""
    spark = SparkSession.active()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    every = model._java_obj.trees()
    for i in range(n):
        trees[i], weights[i] = every[i], model.treeWeights[i]
    out = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{n}", trees, weights))
    return out.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


class Stopped(NamedTuple):
    """A boosted model of its best number of rounds, what prepares its rows, and the held-out groups' error after each round."""

    features: Features
    model: GBTRegressionModel
    rounds: int
    errors: list[float]


def stopped_boosting(train: DataFrame, features: list[str], target: str, group: str, rounds: int = 200, patience: int = 20, share: float = 0.9, fold: int = 0, logged: bool = False, prepare: Callable | None = None, **options) -> Stopped:
    """Boosting on a share of train's groups, of as many rounds as suit the others best by mean absolute error.

    The rows of `train` alone are looked at. A round depends only on those before it, so the model is fitted on twice
    as many rounds until `patience` of them bring nothing, and its first rounds are kept.
    """
    label = F.log(F.col(target)) if logged else F.col(target).cast("double")
    split = inner_split(train, group, share, fold).persist()
    try:
        fit, stop = (split.where(F.col("inner") == kind).drop("inner") for kind in ("fit", "stop"))
        made = (prepare or Features)(fit, features)
        fit, stop = made(fit).withColumn("__target", label).persist(), made(stop).withColumn("__target", label).persist()
        tried = min(rounds, max(2, 2 * patience))
        while True:
            model = estimator("boosted", **{**options, "maxIter": tried}).fit(fit)
            errors = list(model.evaluateEachIteration(stop, "absolute"))
            n, over = best_round(errors, patience)
            if over or tried == rounds:
                break
            tried = min(rounds, 2 * tried)
        fit.unpersist()
        stop.unpersist()
    finally:
        split.unpersist()
    return Stopped(made, first_rounds(model, n), n, errors)


def stopped_fit_predict(target: str, group: str, logged: bool = False, **options) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """A callback for grouped_cv: boosting that stops early, on groups held out of the training rows."""

    def run(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
        found = stopped_boosting(train, features, target, group, logged=logged, **options)
        out = found.model.transform(found.features(rows))
        p = F.exp("__prediction") if logged else F.greatest(F.col("__prediction"), F.lit(0.0))
        return out.select(*rows.columns, F.col(target).cast("double").alias("actual"), p.alias("predicted"))

    return run
