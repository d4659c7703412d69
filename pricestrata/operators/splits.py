"""Splits and folds that keep groups whole, and what proves it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import sequenced

SEED = 42


def hashed(group: Column, salt: object = SEED) -> Column:
    return F.md5(F.concat_ws(":", group.cast("string"), F.lit(str(salt))).cast("binary"))


def group_split(df: DataFrame, group: str, shares: tuple[float, ...] = (0.7, 0.15), names: tuple[str, ...] = ("train", "validation", "test"), salt: object = SEED) -> DataFrame:
    """(group, split): groups in the order of a hash; exact counts, rounded half to even, the rest last."""
    groups = df.select(group).dropna().distinct()
    n = groups.count()
    ends, at = [], 0
    for s in shares:
        at += round(s * n)
        ends.append(at)
    # Ranks without one task for all: places within hash prefixes, plus what earlier prefixes hold.
    own = groups.withColumn("h", hashed(F.col(group), salt)).withColumn("p", F.substring("h", 1, 2))
    starts = own.groupBy("p").agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", group))
    ranked = own.withColumn("place", place).join(F.broadcast(starts.select("p", "start")), "p")  # 256 prefixes
    rank = F.col("start") + F.col("place")
    split = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names))):
        split = F.when(rank <= end, name).otherwise(split)
    return ranked.select(group, split.alias("split"))


def group_folds(df: DataFrame, group: str, k: int = 4) -> DataFrame:
    """(group, n, fold): the largest groups first (ties by key), each to the fold of fewest rows so far.

    The greedy rule needs sizes only, so the driver sees a row for each distinct size and not for each
    group. Once no two folds differ by a size or more, groups of it go round the folds in one order.
    """
    sizes = df.dropna(subset=[group]).groupBy(group).agg(F.count("*").alias("n"))
    counts = sorted(((r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True)
    load, runs = [0] * k, []
    for n, groups in counts:
        at = 0
        while at < groups and max(load) - min(load) >= n:
            i = load.index(min(load))
            runs.append((n, at, at + 1, [i]))
            load[i] += n
            at += 1
        if at < groups:
            order = sorted(range(k), key=lambda i: (load[i], i))
            runs.append((n, at, groups, order))
            for j, i in enumerate(order):
                load[i] += n * len(range(at + j, groups, k))
    sizes = sequenced(sizes, ["n"], [group]).withColumn("place", F.col("place") - 1)
    table = df.sparkSession.createDataFrame(runs, "n long, first long, last long, folds array<int>")
    ranked = sizes.join(table, "n").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("last")))
    return ranked.select(group, "n", F.get("folds", ((F.col("place") - F.col("first")) % F.size("folds")).cast("int")).alias("fold"))


def overlaps(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """(overlap): how many distinct values of columns occur in more than one part."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count_distinct(part).alias("k")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("overlap"))


def fold_report(df: DataFrame, fold: str, group: str, row_key: str) -> DataFrame:
    """(group_overlap, row_overlap, group_check, row_check): shared groups fail, shared rows warn."""
    a = overlaps(df, fold, [group]).withColumnRenamed("overlap", "group_overlap").first()[0]
    b = overlaps(df, fold, [row_key]).withColumnRenamed("overlap", "row_overlap").first()[0]
    return df.sparkSession.range(1).select(F.lit(a).alias("group_overlap"), F.lit(b).alias("row_overlap"), F.lit("FAIL" if a else "PASS").alias("group_check"), F.lit("WARN" if b else "PASS").alias("row_check"))


def sampled(df: DataFrame, key: str, n: int, salt: object = SEED) -> DataFrame:
    """n rows, by the order of a hash."""
    return df.orderBy(hashed(F.col(key), salt), key).limit(n)


def permuted(df: DataFrame, column: str, key: str, within: list[str], salt: object = SEED) -> DataFrame:
    """df with a column's values dealt out anew within groups, by ranks of hashes. Without groups, within all rows."""
    own = sequenced(df, within, [key], place="__to")
    shuffled = sequenced(df.select(*within, key, F.col(column).alias("__value"), hashed(F.col(key), salt).alias("__h")), within, ["__h", key], place="__from")
    values = shuffled.select(*(F.col(c).alias(f"__w{i}") for i, c in enumerate(within)), "__from", "__value")
    met = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(within)), F.col("__to") == F.col("__from"))
    return own.join(values, met).select(*(F.col("__value").alias(c) if c == column else F.col(c) for c in df.columns))
