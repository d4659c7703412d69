"""What each feature adds to a prediction: Shapley values by sampled orders of the features.

A draw is an order of the features and a background row. Features turn one after another from the
background row's values into the explained row's; the step at which one turns is its effect there.
Draws come in pairs of an order and its reverse. Within a draw the steps add up to the difference
of both predictions, so base and effects add up to the prediction exactly, whatever the number of draws.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import rolled_up
from .ranges import with_quantiles

#: Background rows held by the driver, at most: the bound of what every task is sent.
BACKGROUND = 1000
# Bounds of a sound explanation.
LARGEST, LEAST_ERROR, ERROR_SHARE = 1e6, 1.0, 0.05


def orders(n: int, pairs: int, seed: int = 42) -> list[list[int]]:
    """Random orders of n features, each followed by its reverse."""
    r, out = random.Random(seed), []
    for _ in range(pairs):
        one = r.sample(range(n), n)
        out += [one, one[::-1]]
    return out


def effects(rows: DataFrame, key: str, features: list[str], background: DataFrame, predict: Callable[[DataFrame], DataFrame], pairs: int = 12, seed: int = 42) -> DataFrame:
    """(key, feature, effect, base, predicted): one row for each feature of each row; key is unique.

    predict adds the column `predicted`. background's rows are taken in turn, each for a pair of
    draws; a null value is a value like any other. No row, or no feature, gives an empty result.
    """
    n = len(features)
    ground = background.select(*features).limit(BACKGROUND + 1).collect()
    if not ground or len(ground) > BACKGROUND:
        raise ValueError(f"the background needs 1 to {BACKGROUND} rows")
    turns = orders(n, pairs, seed)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    place = F.col("__step") % (n + 1)
    at = lambda values, i: F.get(F.array(*values), i)
    draw = F.floor(F.col("__step") / (n + 1)).cast("int")
    hybrid = []
    for i, c in enumerate(features):
        turned = at([F.lit(t.index(i)) for t in turns], draw) < place
        hybrid.append(F.when(turned, F.col(c)).otherwise(at([F.lit(ground[d // 2 % len(ground)][c]).cast(kinds[c]) for d in range(len(turns))], draw)).alias(c))
    steps = rows.select(key, *features).withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(len(turns) * (n + 1) - 1))))
    out = predict(steps.select(key, "__step", *hybrid)).select(key, draw.alias("draw"), place.alias("place"), F.col("predicted").cast("double").alias("p"))
    named = F.array(*(F.array(*(F.lit(features[i]) for i in t)) for t in turns))
    own = F.get(named, F.col("draw"))
    part = lambda at, sign: F.struct(F.get(own, at).alias("feature"), (sign * F.col("p")).alias("v"))
    parts = out.select(key, "p", "place", F.explode(F.array(part(F.col("place") - 1, 1), part(F.col("place"), -1))).alias("s"))
    by = parts.groupBy(key, F.col("s.feature").alias("feature")).agg(
        (F.sum("s.v") / len(turns)).alias("effect"),
        (F.sum(F.when(F.col("place") == 0, F.col("p"))) / len(turns)).alias("base"),
        (F.sum(F.when(F.col("place") == n, F.col("p"))) / len(turns)).alias("predicted"),
    )
    # The first and the last step have no feature on one side: that group holds both ends of every draw.
    ends = by.where("feature is null").select(key, "base", "predicted")
    return by.where("feature is not null").select(key, "feature", "effect").join(ends, key)


def checked(explained: DataFrame, key: str) -> DataFrame:
    """(rows, not_finite, too_large, worst_error, allowed_error, sound): one row.

    Sound effects are finite, not above LARGEST, and with the base rebuild every prediction to within
    LEAST_ERROR or ERROR_SHARE of the largest prediction. No rows are not sound.
    """
    bad = F.col("effect").isNull() | F.isnan("effect") | (F.abs("effect") == float("inf"))
    by = explained.groupBy(key).agg(F.sum(bad.cast("long")).alias("bad"), F.max(F.abs("effect")).alias("most"), (F.sum("effect") + F.first("base")).alias("rebuilt"), F.first("predicted").alias("predicted"))
    one = by.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite"),
        F.count(F.when(F.col("most") > LARGEST, 1)).alias("too_large"),
        F.max(F.abs(F.col("rebuilt") - F.col("predicted"))).alias("worst_error"),
        F.greatest(F.lit(LEAST_ERROR), ERROR_SHARE * F.max(F.abs("predicted"))).alias("allowed_error"),
    )
    return one.withColumn("sound", F.coalesce((F.col("rows") > 0) & (F.col("not_finite") == 0) & (F.col("too_large") == 0) & (F.col("worst_error") <= F.col("allowed_error")), F.lit(False)))


def raw_feature(encoded: Column, raw: list[str]) -> Column:
    """The raw feature of an encoded column's name: `num__` and a feature, or `cat__`, a feature, `_` and a level.

    The longest feature that fits is taken, as names and levels may hold `_`; what fits none is its own feature.
    """
    level = F.when(F.startswith(encoded, F.lit("cat__")), F.substring(encoded, F.lit(6), F.length(encoded)))
    out = level
    for f in sorted(raw, key=len):  # the longest last, and so asked first
        out = F.when((level == f) | F.startswith(level, F.lit(f"{f}_")), f).otherwise(out)
    return F.when(F.startswith(encoded, F.lit("num__")), F.substring(encoded, F.lit(6), F.length(encoded))).otherwise(F.coalesce(out, encoded))


def raw_effects(encoded: DataFrame, key: str, raw_of: Column, effect: str = "effect") -> DataFrame:
    """(key, feature, effect): effects of encoded columns summed by the raw feature that raw_of names."""
    return encoded.groupBy(key, raw_of.alias("feature")).agg(F.sum(effect).alias("effect"))


def importances(explained: DataFrame) -> DataFrame:
    """(feature, mean_abs, mean, median_abs, share) over all explained rows, the largest first."""
    by = explained.groupBy("feature").agg(F.avg(F.abs("effect")).alias("mean_abs"), F.avg("effect").alias("mean"))
    by = with_quantiles(by, explained, ["feature"], {"abs": F.abs("effect")}, {"median": 0.5}).withColumnRenamed("abs_median", "median_abs")
    total = F.sum("mean_abs").over(Window.partitionBy())  # a row for each feature
    return by.withColumn("share", F.coalesce(F.when(total != 0, F.col("mean_abs") / total), F.lit(0.0))).orderBy(F.desc("mean_abs"), "feature")


def group_importances(explained: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(group, mean_abs, share): mean absolute effects by group of features."""
    return rolled_up(importances(explained), "feature", groups, "mean_abs")


def long_table(explained: DataFrame, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """explained with each feature's own value as text."""
    values = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features))).alias("s")).select(key, "s.*")
    return explained.join(values, [key, "feature"], "left").withColumn("abs_effect", F.abs("effect"))


def local_table(table: DataFrame, key: str, which: object, k: int | None = None) -> DataFrame:
    """One row's part of the long table, the largest effects first; k: a report of so many."""
    out = table.where(F.col(key) == which).orderBy(F.desc("abs_effect"), "feature")
    return out.limit(k) if k else out
