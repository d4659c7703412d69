"""How far a model's metrics can be trusted: integrity checks, ablations, and what single features know of the target."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import correlation, errors_by
from .catalogue import DYNAMICS, LEAKING, OFFSETS
from .quality import numeric_columns, text_columns
from .splits import hashed, sampled

# Names that a target has, and the correlation from which on a number is the target itself.
TARGETS, SAME = ("price", "target", "y", "eur_price"), 0.999
#: Rows that nearest-neighbour estimates are made of, at most; and neighbours.
ROWS, NEIGHBOURS = 5000, 3


def integrity(splits: dict[str, DataFrame], features: list[str], target: str, group: str, leaking: tuple[str, ...] = LEAKING, dynamics: tuple[str, ...] = DYNAMICS, offsets: tuple[str, ...] = OFFSETS) -> DataFrame:
    """(check, status, hits, detail): six checks of the rows and features of a model; the first split is the training rows.

    hits counts groups that several splits share, equal rows by pair of splits, or features; detail names the features.
    Splits share a group, a row of equal features and target, or nothing: both are counted by keys, in one
    pass over all splits, and nulls equal nulls in rows only.
    """
    train = next(iter(splits.values()))
    columns = [c for c in dict.fromkeys([*features, target]) if c in train.columns]
    whole = None
    for name, df in splits.items():
        own = df.select(F.lit(name).alias("__split"), F.col(group).alias("__group"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)))
        whole = own if whole is None else whole.unionByName(own)
    pairs = lambda k: F.coalesce(F.sum(k * (k - 1) / 2), F.lit(0.0)).cast("long")
    shared = whole.dropna(subset=["__group"]).groupBy("__group").agg(F.count_distinct("__split").alias("k")).agg(pairs(F.col("k")).alias("hits"))
    again = whole.groupBy(*(f"__c{i}" for i in range(len(columns)))).agg(F.count_distinct("__split").alias("k")).agg(pairs(F.col("k")).alias("hits"))
    numbers = [c for c in numeric_columns(train) if c in features and c != target]
    ties = F.array(*(F.struct(F.lit(c).alias("c"), F.abs(correlation(F.col(c), F.col(target))).alias("r")) for c in numbers)) if numbers else F.array().cast("array<struct<c:string,r:double>>")
    same = train.agg(ties.alias("t")).select(F.transform(F.filter("t", lambda x: x["r"] >= SAME), lambda x: x["c"]).alias("names"))
    named = lambda check, names, bad="FAIL": (check, sorted(names), bad)
    known = [
        named("target_in_features", {c for c in features if c == target or c.lower() in TARGETS}),
        named("future_or_listing_history_columns", set(features) & {*leaking, *dynamics}),
        named("split_specific_preparation", set(features) & set(offsets), "WARN"),
    ]
    spark = train.sparkSession
    lists = spark.createDataFrame(known, "check string, names array<string>, bad string").unionByName(same.select(F.lit("deterministic_or_near_target_numeric_features").alias("check"), F.array_sort("names").alias("names"), F.lit("FAIL").alias("bad")))
    counted = shared.select(F.lit("group_overlap").alias("check"), "hits").unionByName(again.select(F.lit("cross_split_exact_duplicates").alias("check"), "hits")).select("check", "hits", F.lit("").alias("detail"), F.lit("FAIL").alias("bad"))
    every = counted.unionByName(lists.select("check", F.size("names").cast("long").alias("hits"), F.array_join("names", ";").alias("detail"), "bad"))
    return every.select("check", F.when(F.col("hits") > 0, F.col("bad")).otherwise("PASS").alias("status"), "hits", "detail")


def verdict(checks: dict[str, str], real_r2: float, shuffled_r2: float | None = None, tiny_r2: float | None = None, suspicious: int = 0) -> tuple[str, str]:
    """(verdict, reason) of statuses by check and of three refits: inflated, doubtful or sound.

    shuffled_r2 is that of a model of shuffled targets, tiny_r2 the best one of very few features.
    """
    failed, warned = (sorted(c for c, s in checks.items() if s == kind) for kind in ("FAIL", "WARN"))
    if failed:
        return "inflated", f"failed: {', '.join(failed)}"
    if shuffled_r2 is not None and shuffled_r2 > max(0.25, real_r2 - 0.50):
        return "inflated", f"shuffled targets kept an R2 of {shuffled_r2:.4f}, against {real_r2:.4f}"
    if warned or suspicious or tiny_r2 is not None and tiny_r2 > 0.90:
        return "doubtful", f"warnings: {', '.join(warned)}; suspicious features: {suspicious}; R2 of few features: {tiny_r2}"
    return "sound", "all checks passed"


def ablations(df: DataFrame, features: list[str], groups: dict[str, list[str]], baseline: list[str]) -> dict[str, list[str]]:
    """Named feature lists: all, all but each group, the baseline, the baseline with each group, each group alone, texts and numbers. Empty ones go."""
    texts, numbers = text_columns(df), numeric_columns(df)
    out = {"all": list(features)}
    out |= {f"without_{g}": [f for f in features if f not in own] for g, own in groups.items()}
    base = [f for f in baseline if f in features]
    out |= {"baseline_only": base}
    out |= {f"baseline_and_{g}": list(dict.fromkeys([*base, *(f for f in own if f in features)])) for g, own in groups.items()}
    out |= {f"{g}_only": [f for f in features if f in own] for g, own in groups.items()}
    out |= {"categorical_only": [f for f in features if f in texts], "numeric_only": [f for f in features if f in numbers]}
    return {n: own for n, own in out.items() if own}


def ablated(train: DataFrame, rows: DataFrame, variants: dict[str, list[str]], callback) -> DataFrame:
    """(variant, features, and errors on rows) of a model for each feature list, the best R2 first."""
    parts = None
    for name, own in variants.items():
        by = errors_by(callback(train, rows, own), []).select(F.lit(name).alias("variant"), F.lit(len(own)).alias("features"), "n", "mae", "rmse", "r2", "median_ae")
        parts = by if parts is None else parts.unionByName(by)
    return parts.orderBy(F.desc("r2"), "mae", "variant")


# Mutual information by nearest neighbours


def _digamma(n: np.ndarray) -> np.ndarray:
    """At whole numbers from 1 on."""
    sums = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, max(2, int(n.max(initial=1)) + 1)))))
    return sums[n - 1] - np.euler_gamma


def _within(sorted_values: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted values lie nearer to each place than its radius, by their differences."""
    n, s = len(sorted_values), np.append(sorted_values, np.inf)
    low, high = np.searchsorted(sorted_values, at - radius), np.searchsorted(sorted_values, at + radius, "right")
    # A sum may round to the other side of a value that lies on the border.
    for step, moves in ((1, lambda: (low < high) & (at - s[low] >= radius)), (-1, lambda: (low > 0) & (at - s[low - 1] < radius))):
        while (m := moves()).any():
            low = low + step * m
    for step, moves in ((-1, lambda: (high > low) & (s[high - 1] - at >= radius)), (1, lambda: (high < n) & (s[high] - at < radius))):
        while (m := moves()).any():
            high = high + step * m
    return high - low


def continuous_terms(x: np.ndarray, y: np.ndarray, first: int, last: int, k: int = NEIGHBOURS) -> float:
    """The part of rows first to last in the sum of digamma(nearer in x) + digamma(nearer in y), a row itself counted.

    A row's radius is the distance of its k-th neighbour, the larger of both coordinates' differences; what is
    nearer than that is counted in each coordinate by itself.
    """
    total, xs, ys = 0.0, np.sort(x), np.sort(y)
    for i in range(first, last, 256):
        at = slice(i, min(i + 256, last))
        away = np.maximum(np.abs(x[at, None] - x[None]), np.abs(y[at, None] - y[None]))
        radius = np.partition(away, k, axis=1)[:, k]
        total += sum((_digamma(np.maximum(_within(s, v[at], radius), 1))).sum() for s, v in ((xs, x), (ys, y)))
    return float(total)


def discrete_information(label: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """Of labels with a number: a row's radius is that of its k-th neighbour of its own label; labels of one row do not count."""
    _, kind, counts = np.unique(label, return_inverse=True, return_counts=True)
    use = counts[kind] > 1
    kind, y = kind[use], y[use]
    if not len(y):
        return 0.0
    whole, own_k, radius = np.sort(y), np.zeros(len(y), np.int64), np.zeros(len(y))
    order = np.lexsort((y, kind))
    starts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(y)]):
        at, v = order[a:b], y[order[a:b]]
        j = min(k, len(v) - 1)
        own_k[at] = j
        # The k nearest of a sorted row lie in the window of k on either side.
        window = np.clip(np.arange(len(v))[:, None] + np.arange(-j, j + 1)[None], 0, len(v) - 1)
        real = (np.arange(len(v))[:, None] + np.arange(-j, j + 1)[None]) == window
        radius[at] = np.sort(np.where(real, np.abs(v[window] - v[:, None]), np.inf), axis=1)[:, j]
    near = np.maximum(_within(whole, y, radius), 1)
    return max(0.0, float(_digamma(np.array([len(y)]))[0] + _digamma(own_k).mean() - _digamma(counts[kind]).mean() - _digamma(near).mean()))


def mutual_information(df: DataFrame, features: dict[str, Column], target: Column, key: str, rows: int = ROWS, k: int = NEIGHBOURS, noise: float = 1e-10) -> DataFrame:
    """(feature, rows, mutual_information) in nats, by nearest neighbours: numbers with the target as two coordinates, texts as labels.

    Made of `rows` rows with a target, those of the least hashes, as such estimates are: their columns are sent to every task, and blocks
    of rows of each feature are tasks. A number's gaps take its median and coordinates are divided by their deviations; noise, in
    that unit, parts equal values by a hash of the key. A null text is a label of its own.
    """
    spark = df.sparkSession
    kinds = dict(df.select(*(c.alias(n) for n, c in features.items())).dtypes)
    own = df.select(F.col(key).alias("__key"), target.cast("double").alias("__y"), *((c if kinds[n] == "string" else c.cast("double")).alias(n) for n, c in features.items())).where("__y is not null and not isnan(__y)")
    salted = [F.conv(F.substring(hashed(F.col("__key"), n), 1, 8), 16, 10).cast("double").alias(f"__n{i}") for i, n in enumerate(["__y", *features])]
    table = sampled(own, "__key", rows).select("*", *salted).orderBy("__key").toArrow()
    n = table.num_rows

    def column(name: str, place: int) -> np.ndarray:
        v = table.column(name).to_numpy().astype(float)
        known = v[~np.isnan(v)]
        v = np.where(np.isnan(v), np.median(known) if len(known) else 0.0, v)
        v = v / (v.std() or 1.0)
        return v + noise * max(1.0, np.abs(v).mean()) * (table.column(f"__n{place}").to_numpy() / 2**32 - 0.5)

    if n <= k + 1:
        return spark.createDataFrame([(f, n, 0.0) for f in features], "feature string, rows long, mutual_information double")
    named = list(features)
    data = {f: np.array([str(v) if v is not None else "\0" for v in table.column(f).to_pylist()]) if kinds[f] == "string" else column(f, i + 1) for i, f in enumerate(named)}
    shared = spark.sparkContext.broadcast((data, column("__y", 0)))  # `rows` rows at most
    blocks = -(-n // 1024)
    base = float(_digamma(np.array([n]))[0] + _digamma(np.array([k]))[0])
    tasks = [(f, b * 1024, min(n, b * 1024 + 1024)) for f in named for b in range(blocks) if kinds[f] != "string" or b == 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, y = shared.value
        for b in batches:
            out = []
            for f, first, last in zip(*(b.column(i).to_pylist() for i in range(3))):
                out.append(discrete_information(columns[f], y, k) if kinds[f] == "string" else continuous_terms(columns[f], y, first, last, k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["feature", "part"])

    parts = spark.createDataFrame(tasks, "feature string, first int, last int").repartition(len(tasks)).mapInArrow(run, "feature string, part double")
    texts = F.col("feature").isin(*(f for f in named if kinds[f] == "string")) if any(kinds[f] == "string" for f in named) else F.lit(False)
    total = F.sum("part")
    return parts.groupBy("feature").agg(total.alias("t")).select("feature", F.lit(n).cast("long").alias("rows"), F.when(texts, F.col("t")).otherwise(F.greatest(F.lit(base) - F.col("t") / n, F.lit(0.0))).alias("mutual_information"))

