"""Summaries: groups, shares, lifecycles, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .ranges import with_quantiles


def group_summary(df: DataFrame, keys: list[str], measures: list[str], shares: dict[str, Column] | None = None, keep_nulls: bool = True) -> DataFrame:
    """Rows, mean and median of measures and shares of conditions by group. A null condition counts as no."""
    own = df if keep_nulls else df.dropna(subset=keys)
    from ..functions.numeric import share

    by = own.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"{m}_mean") for m in measures), *(share(c).alias(n) for n, c in (shares or {}).items()))
    return with_quantiles(by, own, keys, {m: F.col(m) for m in measures}, {"median": 0.5})


def with_shares(df: DataFrame, n: str, parent: list[str]) -> DataFrame:
    """df with n's share of the grand total and of its parent group's."""
    return df.withColumn("share_of_total", F.col(n) / F.sum(n).over(Window.partitionBy())).withColumn("share_of_parent", F.col(n) / F.sum(n).over(Window.partitionBy(*parent)))


def lifecycle(df: DataFrame, keys: list[str], year: str, count: str, recent: tuple[int, int] = (2021, 2025), old: int = 2018) -> DataFrame:
    """Total, recent and old shares, mean year, span of years and the peak row; all but the total null where it is 0.

    The peak is the largest single row; of equal ones the earliest year holds.
    """
    n, y = F.col(count), F.col(year)
    out = df.groupBy(*keys).agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.sum(F.when(y.between(*recent), n)).alias("r"), F.sum(F.when(y <= old, n)).alias("o"), F.sum(n * y).alias("ny"), (F.max(F.when(n > 0, y)) - F.min(F.when(n > 0, y))).alias("span"), F.max(F.struct(n.alias("n"), (-y).alias("y"))).alias("peak"))
    if_any = lambda c: F.when(F.col("total") > 0, c)
    return out.select(*keys, "total", if_any(ratio(F.coalesce("r", F.lit(0)), F.col("total"))).alias("recent_share"), if_any(ratio(F.coalesce("o", F.lit(0)), F.col("total"))).alias("old_share"), if_any(ratio(F.col("ny"), F.col("total"))).alias("mean_year"), if_any(F.col("span")).alias("year_span"), if_any(-F.col("peak.y")).alias("peak_year"), if_any(F.col("peak.n")).alias("peak_count"))


def value_counts(df: DataFrame, columns: list[str], top: int | None = None, keep_nulls: bool = True) -> DataFrame:
    """Counts of values, largest first; ties by value. top: a report of so many."""
    own = (df if keep_nulls else df.dropna(subset=columns)).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)
    return own.limit(top) if top else own


def described(df: DataFrame, column: str, percents: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """count, mean, std, min, percentiles and max of a column: one row."""
    one = df.agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    names = {f"p{round(100 * p)}": p for p in percents}
    out = with_quantiles(one, df, [], {"q": F.col(column)}, names)
    return out.select("count", "mean", "std", "min", *(F.col(f"q_{n}").alias(n) for n in names), "max")


def correlation(a: Column, b: Column) -> Column:
    """Of two numbers over rows that have both (an aggregate); null if either is constant."""
    x, y = (F.when(a.isNotNull() & b.isNotNull(), c.cast("double")) for c in (a, b))
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    top = n * F.sum(x * y) - sx * sy
    low = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (low > 0), top / F.sqrt(low))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs of columns, over rows that have both; null if either is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("correlation")) for i, (a, b) in enumerate(pairs)))).alias("r")).select("r.*")


def regression_metrics(y: str = "actual", p: str = "predicted") -> list[Column]:
    """Aggregates: n, mae, rmse, r2, spreads and two relative errors."""
    e = F.col(y) - F.col(p)
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(F.var_pop(y) > 0, 1 - F.sum(e * e) / (F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(y).alias("target_mean"), F.stddev_pop(y).alias("target_std"), F.stddev_pop(p).alias("prediction_std"), F.avg(F.abs(e) / F.greatest(F.col(y), F.lit(1.0))).alias("mape"), F.avg(-e).alias("bias")]


def errors_by(df: DataFrame, keys: list[str], y: str = "actual", p: str = "predicted", *more: Column) -> DataFrame:
    """Regression metrics by keys, and median_ae, the exact median of absolute errors."""
    by = df.groupBy(*keys).agg(*regression_metrics(y, p), *more)
    return with_quantiles(by, df, keys, {"ae": F.abs(F.col(y) - F.col(p))}, {"median": 0.5}).withColumnRenamed("ae_median", "median_ae")


def group_errors(df: DataFrame, group: str, y: str, p: str, least: int = 20, within: tuple[int, ...] = (10, 20, 50)) -> DataFrame:
    """Errors by group of `least` rows or more, the worst first."""
    ae = F.abs(F.col(y) - F.col(p))
    shares = [F.avg((ae <= w).cast("int")).alias(f"within_{w}") for w in within]
    enough = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    own = df.join(enough, F.col(group).eqNullSafe(F.col("__group")), "left_semi")
    return errors_by(own, [group], y, p, *shares).orderBy(F.desc("mae"), F.desc("n"), group)


def error_bands(df: DataFrame, band: Column, y: str = "actual", p: str = "predicted") -> DataFrame:
    """(band, n, mae, mape): errors by band; the relative error is of rows whose actual value is above 1."""
    ae = F.abs(F.col(y) - F.col(p))
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(ae).alias("mae"), F.avg(F.when(F.col(y) > 1, ae / F.col(y))).alias("mape"))


def with_empty(counts: DataFrame, values: dict[str, list], n: str = "n") -> DataFrame:
    """counts with a row, of n 0, for each combination of the given values that it lacks."""
    grid = counts.sparkSession.range(1).select()
    for c, own in values.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, own))).alias(c))
    kinds = dict(counts.dtypes)
    grid = grid.select(*(F.col(c).cast(kinds[c]).alias(c) for c in values))
    return grid.join(counts, list(values), "full").withColumn(n, F.coalesce(n, F.lit(0).cast(kinds[n]))).select(*counts.columns)


def fold_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, population deviation, least and largest of each metric over folds: one row."""
    return df.agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def rolled_up(df: DataFrame, raw: str, groups: dict[str, str], value: str) -> DataFrame:
    """(group, value, share) of importances summed by raw feature and then by group; all shares 0 if the total is."""
    group = F.lit("other")
    for k, g in groups.items():
        group = F.when(F.col(raw) == k, g).otherwise(group)
    by = df.groupBy(raw).agg(F.sum(value).alias(value)).groupBy(group.alias("group")).agg(F.sum(value).alias(value))
    total = F.sum(value).over(Window.partitionBy())
    return by.withColumn("share", F.coalesce(F.when(total != 0, F.col(value) / total), F.lit(0.0)))


def unambiguous(df: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owners, owner): owner where there is just one."""
    return df.dropna(subset=[key]).groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("o")).select(key, "owners", F.when(F.col("owners") == 1, F.col("o")).alias(owner))


def mi_binned(df: DataFrame, features: dict[str, Column], target: Column) -> DataFrame:
    """(feature, rows, mutual_information) in nats, of bins of features with bins of the target.

    A histogram estimate over all rows, where others sample rows and use nearest neighbours: it is
    comparable between features of as many bins. Rows with a null on either side go; a feature
    without any is missing from the result. Counts of bins are all that is shuffled twice.
    """
    pairs = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("string").alias("x")) for n, c in features.items()))
    n = df.select(target.cast("string").alias("y"), F.explode(pairs).alias("s")).select("s.*", "y").dropna().groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    p = F.col("n") / over()
    parts = n.select("feature", "n", (p * F.log(F.col("n") * over() / (over("x") * over("y")))).alias("v"))
    return parts.groupBy("feature").agg(F.sum("n").alias("rows"), F.greatest(F.sum("v"), F.lit(0.0)).alias("mutual_information"))
