"""Regression models over mixed columns, with grouped cross-validation and audits. Fits are Spark ML's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .aggregates import errors_by, fold_summary
from .quality import numeric_columns, text_columns
from .splits import group_folds, group_split, permuted

RARE = "__infrequent__"


class Features:
    """Imputation, rare levels and encoding, fitted on training rows only."""

    def __init__(self, train: DataFrame, features: list[str], min_frequency: int = 5, scale: bool = False) -> None:
        self.numeric = [c for c in numeric_columns(train) if c in features]
        self.text = [c for c in text_columns(train) if c in features]
        modes = train.agg(*(F.mode(c, True).alias(c) for c in self.text)).first().asDict() if self.text else {}
        self.modes = {c: modes[c] if modes[c] is not None else "" for c in self.text}
        own = self._filled(train)
        self.levels = {c: [r[0] for r in own.groupBy(c).count().where(F.col("count") >= min_frequency).select(c).collect()] for c in self.text}
        stages = []
        if self.numeric:
            stages.append(Imputer(strategy="median", inputCols=self.numeric, outputCols=[f"{c}__n" for c in self.numeric], relativeError=0.0001))
        if self.text:
            stages.append(StringIndexer(inputCols=self.text, outputCols=[f"{c}__i" for c in self.text], handleInvalid="keep", stringOrderType="alphabetAsc"))
            stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in self.text], outputCols=[f"{c}__o" for c in self.text], dropLast=True))
        parts = [f"{c}__n" for c in self.numeric] + [f"{c}__o" for c in self.text]
        stages.append(VectorAssembler(inputCols=parts, outputCol="raw" if scale else "features"))
        if scale:
            stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
        self.model: PipelineModel = Pipeline(stages=stages).fit(self._rare(own))

    def _filled(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: F.col(c).cast("double") for c in self.numeric}) if self.numeric else df
        return out.fillna(self.modes) if self.text else out

    def _rare(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(c).isin(*keep), F.col(c)).otherwise(RARE) for c, keep in self.levels.items()}) if self.levels else df

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._rare(self._filled(df)))


def estimator(kind: str, **options):
    """forest, boosted or linear, with the settings that carry over."""
    made = {"forest": RandomForestRegressor, "boosted": GBTRegressor, "linear": LinearRegression}[kind]
    defaults = {"forest": {"numTrees": 40, "maxDepth": 10, "featureSubsetStrategy": "0.5", "minInstancesPerNode": 1, "seed": 42}, "boosted": {"maxIter": 30, "maxDepth": 5, "seed": 42}, "linear": {"elasticNetParam": 0.0, "standardization": False}}[kind]
    return made(featuresCol="features", labelCol="__target", predictionCol="__prediction", **(defaults | options))


def fit_predict(kind: str = "forest", target: str = "price", logged: bool = False, min_frequency: int = 5, **options) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """A callback: fit on the first table, and the second with `actual` and `predicted`."""

    def run(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
        prepare = Features(train, features, min_frequency, kind == "linear")
        label = F.log(F.col(target)) if logged else F.col(target).cast("double")
        model = estimator(kind, **options).fit(prepare(train).withColumn("__target", label))
        out = model.transform(prepare(rows))
        p = F.exp("__prediction") if logged else F.greatest(F.col("__prediction"), F.lit(0.0))
        return out.select(*rows.columns, F.col(target).cast("double").alias("actual"), p.alias("predicted"))

    return run


def grouped_cv(df: DataFrame, group: str, features: list[str], callback, k: int = 4, folded: bool = False) -> DataFrame:
    """Out-of-fold predictions of all rows, with fold and errors. Groups stay whole. folded: df has its fold already."""
    rows = df
    if not folded:
        path = scratch_path(df.sparkSession)
        df.join(group_folds(df, group, k).select(group, "fold"), group).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
    parts = []
    for i in range(k):
        parts.append(callback(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), features))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"absolute_error": F.abs(F.col("actual") - F.col("predicted")), "signed_error": F.col("predicted") - F.col("actual")})


def cv_summary(predictions: DataFrame) -> DataFrame:
    return fold_summary(errors_by(predictions, ["fold"]), ["mae", "rmse", "r2", "median_ae"])


def ranked_candidates(df: DataFrame, group: str, target: str, candidates: list[dict], k: int = 4) -> list[dict]:
    """Candidates (name, kind, features, options) by grouped-CV MAE, then RMSE, then number of features."""
    found = []
    for c in candidates:
        s = cv_summary(grouped_cv(df, group, c["features"], fit_predict(c.get("kind", "forest"), target, **c.get("options", {})), k)).first()
        found.append(c | {"mae": s["mae_mean"], "rmse": s["rmse_mean"]})
    return sorted(found, key=lambda c: (c["mae"], c["rmse"], len(c["features"])))


def inner_split(train: DataFrame, group: str, share: float = 0.9, fold: int = 0) -> DataFrame:
    """train with `inner`: `fit`, or `stop` for the groups that early stopping is judged by."""
    return train.join(group_split(train, group, (share,), ("fit", "stop"), f"inner{fold}").withColumnRenamed("split", "inner"), group)


def permutation_importance(df: DataFrame, features: list[str], columns: list[str], key: str, callback, train: DataFrame, within: list[str]) -> dict[str, float]:
    """By how much the MAE grows as a column's values are dealt out anew within groups."""
    mae = lambda rows: callback(train, rows, features).agg(F.avg(F.abs(F.col("actual") - F.col("predicted")))).first()[0]
    base = mae(df)
    return {c: mae(permuted(df, c, key, within)) - base for c in columns}


def shuffled_target(train: DataFrame, target: str, key: str) -> DataFrame:
    """train with its targets dealt out anew: what is learnt from it is worth nothing."""
    return permuted(train, target, key, [])


def log_uniform_search(space: dict[str, tuple[float, float] | list], n: int, seed: int = 42) -> list[dict]:
    """n distinct random configurations: log-uniform of a pair, a choice of a list."""
    import json
    import math
    import random

    r, out = random.Random(seed), {}
    for _ in range(50 * n):
        c = {k: math.exp(r.uniform(math.log(v[0]), math.log(v[1]))) if isinstance(v, tuple) else r.choice(v) for k, v in space.items()}
        out.setdefault(json.dumps(c, sort_keys=True), c)
        if len(out) == n:
            break
    return list(out.values())


def forest_ranges(df: DataFrame, trees: str, prediction: str, rmse: float, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """df with a calibrated band and the quantiles of its array of single trees' predictions."""
    from ..functions.numeric import sorted_quantile
    from .market import confidence_band

    if not 0 < low < 0.5 < high < 1:
        raise ValueError("quantiles must lie on both sides of the median")
    a, b = confidence_band(F.col(prediction), rmse)
    return df.withColumns({"calibrated_low": a, "calibrated_high": b, "ensemble_low": F.greatest(sorted_quantile(F.col(trees), low), F.lit(0.0)), "ensemble_high": sorted_quantile(F.col(trees), high)})


def tree_predictions(df: DataFrame, forest, features: str = "features") -> DataFrame:
    """df with `trees`: what each tree of a fitted forest predicts, by its own transform."""
    out = df
    for i, tree in enumerate(forest.trees):
        out = tree.copy().setPredictionCol(f"__tree_{i}").setFeaturesCol(features).transform(out)
    names = [f"__tree_{i}" for i in range(len(forest.trees))]
    return out.withColumn("trees", F.array(*names)).drop(*names)


def pruning_sweep(df: DataFrame, group: str, features: list[str], importances: DataFrame, callback, shares: tuple[float, ...] = (0.1, 0.2, 0.3), k: int = 4) -> list[dict]:
    """Grouped-CV MAE with the least important share of features left out, for each share."""
    from .selection import least_important

    out = []
    for share in shares:
        gone = {r[0] for r in least_important(importances, "feature", "importance", share).collect()}
        kept = [f for f in features if f not in gone]
        out.append({"share": share, "kept": len(kept), "mae": cv_summary(grouped_cv(df, group, kept, callback, k)).first()["mae_mean"]})
    return out
