"""Point-in-time histories of snapshots: what was known at each observation, and over all of them.

All windows share one partitioning by entity, so the plan has one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def ordered(entity: str, date: str, *ties: str):
    return Window.partitionBy(entity).orderBy(F.asc_nulls_last(date), *ties)


def changed(now: Column, before: Column) -> Column:
    return F.coalesce(now.isNotNull() & before.isNotNull() & (now != before), F.lit(False))


def point_in_time(df: DataFrame, entity: str, date: str, price: str, *ties: str) -> DataFrame:
    """Observations so far, days since the first, and price changes so far, at every row.

    The first price is the first known by then: no row looks ahead.
    """
    w = ordered(entity, date, *ties)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(entity)
    p = F.col(price)
    out = df.withColumns({"observations_so_far": F.row_number().over(w), "days_since_first_seen": F.datediff(F.col(date), F.min(date).over(whole)), "first_price": F.first(price, ignorenulls=True).over(so_far), "price_change_event": changed(p, F.lag(price).over(w)).cast("int")})
    out = out.withColumn("price_changes_so_far", F.sum("price_change_event").over(so_far))
    return out.withColumns({"price_changed_so_far": (F.col("price_changes_so_far") > 0).cast("int"), "absolute_change_so_far": p - F.col("first_price"), "relative_change_so_far": F.when(F.col("first_price") != 0, ratio(p - F.col("first_price"), F.col("first_price")) * 100)})


def full_history(df: DataFrame, entity: str, date: str, price: str, *ties: str) -> DataFrame:
    """One row for each entity: times observed, first and last day, span, and changes between known prices."""
    w = ordered(entity, date, *ties)
    known = F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = df.withColumn("__event", changed(F.col(price), known).cast("int")).withColumn("__place", F.row_number().over(w))
    has = F.col(price).isNotNull()
    out = own.groupBy(entity).agg(F.count("*").alias("times_observed"), F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.sum("__event").alias("price_changes"), F.min_by(price, F.when(has, F.col("__place"))).alias("first_price"), F.max_by(price, F.when(has, F.col("__place"))).alias("last_price"), (F.count_distinct(price) > 1).cast("int").alias("price_changed"))
    change = F.col("last_price") - F.col("first_price")
    return out.withColumns({"span_days": F.datediff("last_seen", "first_seen"), "absolute_change": change, "percent_change": F.when(F.col("first_price") != 0, ratio(change, F.col("first_price")) * 100)})


def with_day_offsets(frames: dict[str, DataFrame], dates: dict[str, str], reference: str) -> dict[str, DataFrame]:
    """frames, each with the days of its dates (name: date column) since the first `reference` day of all of them."""
    every = None
    for df in frames.values():
        least = df.agg(F.min(reference).alias("d"))
        every = least if every is None else every.unionAll(least)
    first = every.agg(F.min("d")).first()[0]
    return {n: df.withColumns({name: F.datediff(F.col(c), F.lit(first)) for name, c in dates.items()}) for n, df in frames.items()}


def fullest_per_day(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with most values, then the earliest."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(filled.desc(), order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")
