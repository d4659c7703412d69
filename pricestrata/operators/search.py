"""A search for settings: screening on held-out rows, refinement around the best, group folds for the finalists, and a last fit."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import scratch_path
from .aggregates import errors_by
from .models import cv_summary, fit_predict, grouped_cv, log_uniform_search
from .selection import finalists
from .splits import group_folds

Space = dict[str, "tuple[float, float] | list"]


class Found(NamedTuple):
    """winner: (variant, options) of the least cross-validated MAE; screened and ranked: tables of all candidates and of the finalists."""

    winner: dict
    screened: DataFrame
    ranked: DataFrame
    #: fits the winner on rows and predicts others
    refit: Callable[[DataFrame, DataFrame], DataFrame]


def refined(config: dict, space: Space, n: int, reach: float = 0.5, seed: int = 42) -> list[dict]:
    """n distinct settings near one: a number times a factor within e to the power of reach either way, clamped to its range; of a list the value or one beside it."""
    r, out = random.Random(f"{seed}:{json.dumps(config, sort_keys=True)}"), {json.dumps(config, sort_keys=True): None}
    for _ in range(50 * n):
        near = {}
        for k, v in space.items():
            if isinstance(v, tuple):
                near[k] = min(max(config[k] * math.exp(r.uniform(-reach, reach)), v[0]), v[1])
            else:
                near[k] = v[min(max(v.index(config[k]) + r.choice((-1, 0, 1)), 0), len(v) - 1)]
        out.setdefault(json.dumps(near, sort_keys=True), near)
        if len(out) > n:
            break
    return [c for c in out.values() if c is not None]


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "variant string, options string, round string, mae double, rmse double, r2 double")


def searched(train: DataFrame, validation: DataFrame, group: str, target: str, variants: dict[str, list[str]], space: Space, kind: str = "forest", n: int = 8, keep: int = 3, near: int = 2, k: int = 4, seed: int = 42, callback: Callable | None = None, **fixed) -> Found:
    """Every variant of features with n settings is fitted on train and judged on validation; the best `keep` get `near` settings
    around each; of all these the finalists (the best of each variant first) are ranked by group folds of train.

    Settings come of a seed, so a search is the same each time if its fits are. Folds are written once, and all finalists share them. The driver
    holds a row for each candidate; the errors are worked out where the rows are.
    """
    spark = train.sparkSession
    make = callback or (lambda options: fit_predict(kind, target, **fixed, **options))
    seen: dict[tuple[str, str], tuple] = {}

    def screen(variant: str, options: dict, turn: str) -> None:
        key = (variant, json.dumps(options, sort_keys=True))
        if key not in seen:
            s = errors_by(make(options)(train, validation, variants[variant]), []).first()
            seen[key] = (*key, turn, s["mae"], s["rmse"], s["r2"])

    for variant in variants:
        for options in log_uniform_search(space, n, seed):
            screen(variant, options, "screening")
    for variant, options, *_ in sorted(seen.values(), key=lambda r: (r[3], r[4], r[0], r[1]))[:keep]:
        for other in refined(json.loads(options), space, near, seed=seed):
            screen(variant, other, "refinement")
    screened = _table(spark, list(seen.values()))
    path = scratch_path(spark)
    train.join(group_folds(train, group, k).select(group, "fold"), group).write.parquet(path)
    folded = spark.read.parquet(path)
    ranked = []
    for r in finalists(screened, "variant", "options", ["mae", "rmse"], keep).collect():
        s = cv_summary(grouped_cv(folded, group, variants[r["variant"]], make(json.loads(r["options"])), k, folded=True)).first()
        ranked.append((r["variant"], r["options"], "cross-validation", s["mae_mean"], s["rmse_mean"], s["r2_mean"]))
    ranked.sort(key=lambda r: (r[3], r[4], len(variants[r[0]]), r[0], r[1]))
    variant, options = ranked[0][:2]
    winner = {"variant": variant, "options": json.loads(options), "features": variants[variant], "mae": ranked[0][3]}
    return Found(winner, screened, _table(spark, ranked), lambda rows, others: make(winner["options"])(rows, others, winner["features"]))
