"""Fitted models kept with what is needed to ask them, and the answers of a service over them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even, to_euros
from .market import error_scale
from .models import Features, estimator, forest_ranges, tree_predictions

VERSION = 1
DEVELOPMENT, FULL = "train_plus_validation", "train_plus_validation_plus_test"
# The quantiles that a request may ask for, and those it gets unasked.
LOW, HIGH = (0.01, 0.49), (0.51, 0.99)
DEFAULT_LOW, DEFAULT_HIGH = 0.10, 0.90
_READERS = {"forest": RandomForestRegressionModel, "boosted": GBTRegressionModel, "linear": LinearRegressionModel}


@dataclass
class Bundle:
    """A model, its features and its metadata. reference: the rows it was fitted on, for comparable listings."""

    metadata: dict
    features: Features
    model: object
    reference: DataFrame | None = field(default=None, repr=False)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `predicted`, in euros and never below 0."""
        out = self.model.transform(self.features(df))
        return out.select(*df.columns, to_euros(F.col("__prediction"), self.metadata["logged"], self.metadata["largest_target"]).alias("predicted"))

    def ranges(self, df: DataFrame, low: float = DEFAULT_LOW, high: float = DEFAULT_HIGH) -> DataFrame:
        """df with predicted, calibrated and, of a forest, ensemble ranges. Columns that are no feature go."""
        if low >= high:
            raise ValueError("the lower quantile must be smaller than the upper one")
        wanted = self.metadata["feature_names"]
        missing = sorted(set(wanted) - set(df.columns))
        if missing:
            raise ValueError(f"required fields are missing: {', '.join(missing)}")
        own = df.select(*wanted)
        euros = lambda c: to_euros(c, self.metadata["logged"], self.metadata["largest_target"])
        out = self.model.transform(self.features(own))
        if self.metadata["kind"] == "forest":
            out = tree_predictions(out, self.model).withColumn("trees", F.transform("trees", euros))
        else:
            out = out.withColumn("trees", F.array(euros(F.col("__prediction"))))
        out = out.withColumn("predicted", euros(F.col("__prediction"))).select(*wanted, "predicted", "trees")
        out = forest_ranges(out, "trees", "predicted", error_scale(self.metadata["metrics"]), low, high)
        return out.drop("trees").withColumns({"range_width": F.col("calibrated_high") - F.col("calibrated_low"), "ensemble_width": F.col("ensemble_high") - F.col("ensemble_low")})


def fitted(rows: DataFrame, features: list[str], target: str = "price", kind: str = "forest", logged: bool = False, metrics: dict[str, float] | None = None, split: str = FULL, name: str = "", variant: str = "", **options) -> Bundle:
    """A model of target fitted on rows. metrics: held-out errors, of which one scales the calibrated range."""
    made = Features(rows, features, scale=kind == "linear")
    label = F.log(F.col(target)) if logged else F.col(target).cast("double")
    model = estimator(kind, **options).fit(made(rows).withColumn("__target", label))
    n, most = rows.agg(F.count("*"), F.max(F.col(target).cast("double"))).first()
    metadata = {"version": VERSION, "kind": kind, "split": split, "name": name, "variant": variant, "logged": logged, "target": target, "feature_names": list(features), "feature_count": len(features), "options": options, "fit_rows": n, "largest_target": most, "metrics": dict(metrics or {})}
    return Bundle(metadata, made, model, rows.select(*features, target))


def save_bundle(bundle: Bundle, path: str) -> None:
    """Writes below path, through Spark throughout, so any store that Spark can write will do."""
    f = bundle.features
    spark = bundle.reference.sparkSession if bundle.reference is not None else SparkSession.active()
    bundle.model.write().overwrite().save(f"{path}/model")
    f.model.write().overwrite().save(f"{path}/features")
    if bundle.reference is not None:
        bundle.reference.write.mode("overwrite").parquet(f"{path}/reference")
    whole = {"metadata": bundle.metadata, "numeric": f.numeric, "text": f.text, "modes": f.modes, "levels": f.levels, "has_reference": bundle.reference is not None}
    spark.range(1).select(F.lit(json.dumps(whole, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    rows = spark.read.text(f"{path}/metadata").collect()
    whole = json.loads(rows[0][0])
    own = Features.__new__(Features)  # as it was fitted, not fitted again
    own.numeric, own.text, own.modes, own.levels = whole["numeric"], whole["text"], whole["modes"], whole["levels"]
    own.model = PipelineModel.load(f"{path}/features")
    model = _READERS[whole["metadata"]["kind"]].load(f"{path}/model")
    reference = spark.read.parquet(f"{path}/reference") if whole["has_reference"] else None
    return Bundle(whole["metadata"], own, model, reference)


def export_bundles(train: DataFrame, validation: DataFrame, test: DataFrame, path: str, features: list[str], **settings) -> dict[str, Bundle]:
    """Two bundles below path: `development` from train and validation, for checks on test, and `full` from all."""
    held = train.select(*features, settings.get("target", "price"))
    same = lambda df: df.select(*held.columns)
    out = {}
    for name, rows, split in (("development", held.unionByName(same(validation)), DEVELOPMENT), ("full", held.unionByName(same(validation)).unionByName(same(test)), FULL)):
        out[name] = fitted(rows, features, split=split, **settings)
        save_bundle(out[name], f"{path}/{name}")
    return out


# The service's answers, as plain Python. Any web layer can serve them.


def health(bundle: Bundle) -> dict:
    """GET /health."""
    return {"status": "ok", **{k: bundle.metadata[k] for k in ("kind", "split", "name")}}


def model_info(bundle: Bundle) -> dict:
    """GET /model-info."""
    return dict(bundle.metadata)


def predict(bundle: Bundle, request: dict) -> tuple[int, dict]:
    """POST /predict: (200, the answer), (422, why) for quantiles out of bounds, or (400, why) for a request that does not fit.

    request: rows (a list of maps), and low and high quantiles if other than the usual. Answers come
    in the order of rows, with values rounded half to even at two places.
    """
    rows = request.get("rows")
    if not isinstance(rows, list) or not rows:
        return 400, {"detail": "rows must be a list of one or more rows"}
    low, high = request.get("lower_quantile", DEFAULT_LOW), request.get("upper_quantile", DEFAULT_HIGH)
    if not (LOW[0] <= low <= LOW[1] and HIGH[0] <= high <= HIGH[1]):
        return 422, {"detail": f"quantiles lie in [{LOW[0]}, {LOW[1]}] and [{HIGH[0]}, {HIGH[1]}]"}
    wanted = bundle.metadata["feature_names"]
    missing = sorted({f for f in wanted if any(f not in r for r in rows)})
    if missing:
        return 400, {"detail": f"required fields are missing: {', '.join(missing)}"}
    spark = SparkSession.active()
    shown = {c: "double" if c in bundle.features.numeric else "string" for c in wanted}
    try:
        typed = [tuple(None if r[c] is None else float(r[c]) if t == "double" else str(r[c]) for c, t in shown.items()) + (i,) for i, r in enumerate(rows)]
    except (TypeError, ValueError) as e:
        return 400, {"detail": str(e)}
    df = spark.createDataFrame(typed, ", ".join(f"`{c}` {t}" for c, t in shown.items()) + ", `__row` long")
    names = ("predicted", "calibrated_low", "calibrated_high", "range_width", "ensemble_low", "ensemble_high", "ensemble_width")
    ordered = _keeping(bundle, df, low, high).orderBy("__row").select(*(half_even(F.col(c)).alias(c) for c in names))
    return 200, {**{k: bundle.metadata[k] for k in ("kind", "split", "variant", "name")}, "predictions": [r.asDict() for r in ordered.collect()]}


def _keeping(bundle: Bundle, df: DataFrame, low: float, high: float) -> DataFrame:
    """Ranges of a request's rows with their place in it: the bundle's features are unchanged by one column more."""
    wide = Bundle(bundle.metadata | {"feature_names": [*bundle.metadata["feature_names"], "__row"]}, bundle.features, bundle.model)
    return wide.ranges(df, low, high)
