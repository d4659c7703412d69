"""Choosing rows, features and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascaded(df: DataFrame, key: str, selectors: list[tuple[str, Column, list[Column]]], n: int) -> DataFrame:
    """(selector, place, key): of each selector (name, condition, order) in turn its first n keys that none before it took.

    A selector can lose n keys to each one before it, so its n times its turn first keys suffice: the
    chosen come from a table of n * (1 + 2 + ...) rows.
    """
    parts = []
    for i, (name, condition, order) in enumerate(selectors):
        best = df.where(condition).withColumn("__o", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__o = 1").drop("__o")
        top = best.orderBy(*order, key).limit(n * (i + 1))
        parts.append(top.select(F.lit(i).alias("turn"), F.lit(name).alias("selector"), F.row_number().over(Window.orderBy(*order, key)).alias("order"), F.col(key)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    taken, chosen = set(), []
    for r in sorted(rows.collect(), key=lambda r: (r["turn"], r["order"])):
        if r[key] not in taken and sum(c[0] == r["selector"] for c in chosen) < n:
            taken.add(r[key])
            chosen.append((r["selector"], sum(c[0] == r["selector"] for c in chosen) + 1, r[key]))
    return df.sparkSession.createDataFrame(chosen, f"selector string, place int, {key} {dict(df.dtypes)[key]}")


def finalists(df: DataFrame, variant: str, name: str, order: list[str], k: int) -> DataFrame:
    """k candidates: the best of each variant first, then the best of the rest; none twice."""
    best = F.row_number().over(Window.partitionBy(variant).orderBy(*order, name))
    ranked = df.dropDuplicates([variant, name]).withColumn("later", (best > 1).cast("int"))
    return ranked.orderBy("later", *order, variant, name).limit(k).drop("later")


def least_important(df: DataFrame, feature: str, value: str, share: float) -> DataFrame:
    """The share of features of least importance, one at least; halves round to even."""
    n = max(1, round(df.count() * share))
    return df.orderBy(value, F.desc(feature)).limit(n).select(feature)


def top_drivers(df: DataFrame, feature: str, value: str, n: int = 6) -> DataFrame:
    """The n features of the largest effects, either way, and one row `other` for what is left."""
    place = F.row_number().over(Window.orderBy(F.desc(F.abs(value)), feature))
    named = df.select(feature, value).withColumn("place", place).withColumn(feature, F.when(F.col("place") <= n, F.col(feature)).otherwise("other"))
    return named.groupBy(feature).agg(F.sum(value).alias(value), F.min("place").alias("place"))


def variants(columns: list[str], drops: dict[str, set[str]]) -> dict[str, list[str]]:
    """Named feature lists: all columns but those each variant drops; of equal lists the first name stays."""
    out: dict[str, list[str]] = {}
    seen: set[tuple[str, ...]] = set()
    for name, gone in drops.items():
        own = tuple(c for c in columns if c not in gone)
        if own and own not in seen:
            seen.add(own)
            out[name] = list(own)
    return out


def token_groups(columns: list[str], tokens: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """Columns by the tokens that their names hold."""
    return {g: [c for c in columns if any(t in c.lower() for t in ts)] for g, ts in tokens.items()}


def accounted(wanted: list[str], there: list[str]) -> dict[str, list[str]]:
    return {"requested": list(wanted), "available": [c for c in wanted if c in there], "missing": [c for c in wanted if c not in there]}


def verdict(checks: dict[str, str]) -> str:
    """Of checks that are PASS, WARN or FAIL: sound, doubtful or inflated."""
    found = set(checks.values())
    return "inflated" if "FAIL" in found else "doubtful" if "WARN" in found else "sound"


def compared(base: DataFrame, other: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, base, other, delta) of a metric in two runs."""
    a, b = base.select(key, F.col(metric).alias("base")), other.select(key, F.col(metric).alias("other"))
    return a.join(b, key).withColumn("delta", F.col("other") - F.col("base"))
