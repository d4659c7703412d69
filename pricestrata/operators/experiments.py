"""Experiments on a fixed split: a grid of settings and feature lists, its reports, and the winner's errors on rows that no choice saw."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, to_euros
from ..sources.files import write_report
from .aggregates import errors_by, regression_metrics
from .models import Features, estimator, fit_predict
from .selection import accounted, variants


class Variant(NamedTuple):
    """A list of features by name. Only trusted ones may win: the others show what a leak is worth."""

    features: list[str]
    trusted: bool = True


class Config(NamedTuple):
    """Settings of a model. logged: it learns the target's logarithm."""

    kind: str = "forest"
    logged: bool = False
    min_frequency: int = 5
    options: dict = {}
    note: str = ""


RESULT = "variant string, config string, priority int, trusted boolean, features array<string>, missing array<string>, kind string, logged boolean, options string, note string, rows long, mae double, rmse double, r2 double"


def usable(wanted: dict[str, Variant], columns: list[str]) -> dict[str, Variant]:
    """What of each list is there. Lists of nothing go, and of lists with equal columns the first stays."""
    there = {n: accounted(list(dict.fromkeys(v.features)), columns)["available"] for n, v in wanted.items()}
    every = sorted({c for own in there.values() for c in own})
    first = variants(every, {n: set(every) - set(own) for n, own in there.items()})
    return {n: Variant(there[n], wanted[n].trusted) for n in first}


def grid(train: DataFrame, validation: DataFrame, target: str, wanted: dict[str, Variant], configs: dict[str, Config]) -> DataFrame:
    """A row for each feature list and setting, best first: errors on validation, `place`, and `selected` for the winner.

    Order: trusted lists first, then MAE, RMSE and the lists' own order. If no list is trusted, all compete. Rows are encoded once for each list
    and way of encoding, which all its settings share. The driver holds a row for each candidate.
    """
    lists = usable(wanted, train.columns)
    if not lists or not configs:
        raise ValueError("no list of features has a column of the table, or there are no settings")
    rows = []
    for priority, (name, variant) in enumerate(lists.items(), 1):
        ways: dict[tuple[int, bool], list[str]] = {}
        for c, config in configs.items():
            ways.setdefault((config.min_frequency, config.kind == "linear"), []).append(c)
        for (least, scaled), own in ways.items():
            encode = Features(train, variant.features, least, scaled)
            fit, held = (encode(df).select("features", F.col(target).cast("double").alias("actual")).persist() for df in (train, validation))
            largest = fit.agg(F.max("actual")).first()[0]
            for c in own:
                config = configs[c]
                label = F.log("actual") if config.logged else F.col("actual")
                model = estimator(config.kind, **config.options).fit(fit.withColumn("__target", label))
                out = model.transform(held).withColumn("predicted", to_euros(F.col("__prediction"), config.logged, largest))
                e = out.agg(*regression_metrics()).first()
                missing = accounted(list(dict.fromkeys(wanted[name].features)), train.columns)["missing"]
                rows.append((name, c, priority, variant.trusted, variant.features, missing, config.kind, config.logged, json.dumps({"min_frequency": least, **config.options}, sort_keys=True), config.note, e["n"], e["mae"], e["rmse"], e["r2"]))
            fit.unpersist()
            held.unpersist()
    order = Window.orderBy(F.desc("trusted"), "mae", "rmse", "priority", "config")  # a row for each candidate
    return train.sparkSession.createDataFrame(rows, RESULT).withColumn("place", F.row_number().over(order)).withColumn("selected", F.col("place") == 1).orderBy("place")


def write_reports(results: DataFrame, folds: DataFrame, path: str) -> dict:
    """Below path: `comparison` (the grid) and `folds` (errors by fold) as CSV with a header, and `best` as JSON. Returns the best.

    Lists are written as JSON texts. All tables are of a row for each candidate, or candidate and fold.
    """
    for name, df in (("comparison", results), ("folds", folds)):
        lists = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith("array")}
        (df.withColumns(lists) if lists else df).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    best = results.where("selected").first().asDict()
    write_report(results.sparkSession, best, f"{path}/best")
    return best


def read_best(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/best").first()[0])


def held_out(train: DataFrame, validation: DataFrame, test: DataFrame, target: str, best: dict, kind: str | None = None) -> DataFrame:
    """One row: errors on test of the winner fitted once on train and validation, with what was fitted.

    best: what `read_best` gives. kind: an error if the winner is of another kind.
    """
    if kind and best["kind"] != kind:
        raise ValueError(f"the report is of a {best['kind']} model")
    options = json.loads(best["options"])
    own = [*best["features"], target]
    fit = train.select(*own).unionByName(validation.select(*own))
    least = options.pop("min_frequency")
    out = fit_predict(best["kind"], target, best["logged"], least, **options)(fit, test.select(*own), best["features"])
    said = {"variant": best["variant"], "config": best["config"], "feature_count": len(best["features"]), "fit_rows": fit.count()}
    return errors_by(out, []).withColumnRenamed("n", "test_rows").withColumns({n: F.lit(v) for n, v in said.items()})


def feature_audit(df: DataFrame, target: str, before: list[str], excluded: dict[str, str], leaking: dict[str, str]) -> DataFrame:
    """(feature, status, reason, filled_share): why each column is, or is not, a feature; null as a share if the table has no such column.

    status: `kept`, `new` (kept, and not in the list before), `excluded`, `leaking`, or `missing` (listed before, and not in the table).
    """
    rows = [(c, "excluded", excluded[c]) for c in sorted(excluded)] + [(c, "leaking", leaking[c]) for c in sorted(leaking) if c not in excluded]
    gone = {target, *excluded, *leaking}
    rows += [(c, "kept" if c in before else "new", "in the list before" if c in before else "in the table and not in the list before") for c in df.columns if c not in gone]
    rows += [(c, "missing", "in the list before and not in the table") for c in before if c not in df.columns and c not in gone]
    spark = df.sparkSession
    told = spark.createDataFrame(rows, "feature string, status string, reason string")
    filled = df.agg(*(ratio(F.count(F.col(f"`{c}`")), F.count("*")).alias(c) for c in df.columns))  # one pass, one row
    shares = filled.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("filled_share")) for c in df.columns))).alias("s")).select("s.*")
    return told.join(shares, "feature", "left")
