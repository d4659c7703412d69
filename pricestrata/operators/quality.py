"""Guards, profiles, de-duplication and column handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import correlation, mi_binned
from .ranges import quantile_table


def equal_filters(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows whose columns equal the given values as texts; None, "", "Any" and NaN ask for nothing."""
    asked = {k: v for k, v in wanted.items() if v not in (None, "", "Any") and v == v}
    return reduce(lambda out, kv: out.where(F.col(kv[0]).cast("string") == str(kv[1])), asked.items(), df)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def conceptual_types(df: DataFrame, most: int = 30) -> dict[str, str]:
    """What each column is: target, id, date, numeric, text or categorical, by name, type and number of values."""
    left = [c for c, t in df.dtypes if not _by_name(c, t)]
    n = df.agg(*(F.count_distinct(c).alias(c) for c in left)).first().asDict() if left else {}
    return {c: _by_name(c, t) or ("categorical" if n[c] <= most else "text") for c, t in df.dtypes}


def _by_name(column: str, kind: str) -> str | None:
    name = column.lower()
    if name == "price":
        return "target"
    if name.endswith("_id"):
        return "id"
    if kind.startswith(("date", "timestamp")):
        return "date"
    if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
        return "numeric"
    tokens = name.split("_")
    if {"date", "time"} & set(tokens):
        return "date"
    return "text" if {"name", "description", "comment", "text", "number"} & set(tokens) else None


def reordered(df: DataFrame, core: list[str], last_prefixes: tuple[str, ...]) -> DataFrame:
    """core, then all else, then the columns of each prefix in turn."""
    late = [c for p in last_prefixes for c in df.columns if c.startswith(p) and c not in core]
    return df.select(*[c for c in core if c in df.columns], *[c for c in df.columns if c not in core and c not in late], *dict.fromkeys(late))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with exactly these columns, in this order; extra ones go, missing ones are an error that names them."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no two rows have equal keys."""
    again = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"keys repeat: {[tuple(r)[:-1] for r in again]}")
    return df


def require_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    n = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns)).first().asDict()
    if bad := {c: k for c, k in n.items() if k}:
        raise ValueError(f"nulls: {bad}")
    return df


def lookup_join(df: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], unique_left: bool = False, marker: str | None = None) -> DataFrame:
    """A left join to a table of unique keys; marker says `both` or `left_only`. Rows of df are neither lost nor repeated.

    Columns of the right-hand table whose names df has, too, are kept as <name>_right.
    """
    require_unique(right.dropna(subset=right_keys), right_keys)
    if unique_left:
        require_unique(df, left_keys)
    keys = [F.col(c).alias(f"__key_{i}") for i, c in enumerate(right_keys)]
    others = [F.col(c).alias(f"{c}_right" if c in df.columns else c) for c in right.columns if c not in right_keys]
    renamed = right.dropna(subset=right_keys).select(*keys, *others, F.lit(True).alias("__found"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__key_{i}") for i, c in enumerate(left_keys)])
    out = df.join(renamed, on, "left").drop(*(f"__key_{i}" for i in range(len(right_keys))))
    return (out.withColumn(marker, F.when(F.col("__found"), "both").otherwise("left_only")) if marker else out).drop("__found")


def member(df: DataFrame, keys: list[str], other: DataFrame, other_keys: list[str], flag: str) -> DataFrame:
    """df with a flag: whether its keys are among another table's. Null keys are not."""
    return lookup_join(df, other.select(*other_keys).dropna().distinct(), keys, other_keys, marker=flag).withColumn(flag, F.col(flag) == "both")


def require_matched(df: DataFrame, marker: str, keys: list[str]) -> DataFrame:
    """df, a join with a marker, without it, if every row has found its key."""
    lost = df.where(F.col(marker) == "left_only").select(*keys).limit(5).collect()
    if lost:
        raise ValueError(f"keys without a match: {[tuple(r) for r in lost]}")
    return df.drop(marker)


def coverage_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """(column, missing, missing_percent, missing_before, delta) of two profiles; a column that one run lacks has nulls there."""
    old = before.select("column", F.col("missing").alias("missing_before"), F.col("missing_percent").alias("__p"))
    both = now.select("column", "missing", "missing_percent").join(old, "column", "full")
    return both.select("column", "missing", "missing_percent", "missing_before", (F.col("missing_percent") - F.col("__p")).alias("delta"))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def repeats(df: DataFrame, keys: list[str], flag: str = "repeated") -> DataFrame:
    return df.withColumn(flag, F.count("*").over(Window.partitionBy(*keys)) > 1)


def distinct_labels(df: DataFrame, label: str, raw: str) -> DataFrame:
    """Labels that stand for several raw values get the raw value in brackets."""
    w = Window.partitionBy(label)
    return df.withColumn(label, F.when(F.min(raw).over(w) != F.max(raw).over(w), F.concat(F.col(label), F.lit(" ["), F.col(raw), F.lit("]"))).otherwise(F.col(label)))


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, missing, missing_percent, distinct, least, largest, mean, median): a row for each column."""
    numeric = set(numeric_columns(df))
    aggregates = [F.count("*").alias("rows")]
    for c in df.columns:
        n = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        aggregates.append(F.struct(F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.count_distinct(c).alias("distinct"), F.min(F.col(c).cast("string") if c not in numeric else n.cast("string")).alias("least_text"), F.min(n).alias("least"), F.max(n).alias("largest"), F.avg(n).alias("mean")).alias(f"s_{c}"))
    wide = df.agg(*aggregates)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("s")) for c in df.columns)))
    if wanted := [c for c in df.columns if c in numeric]:
        medians = quantile_table(df, [], {c: F.col(c) for c in wanted}, {"median": 0.5})
        median = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(f"{c}_median").alias("median")) for c in wanted))).alias("m")
        out = wide.select("rows", rows.alias("r")).join(F.broadcast(medians.select(median).select("m.*")), F.col("r.column") == F.col("of"), "left")  # a row for each column
    else:
        out = wide.select("rows", rows.alias("r"), F.lit(None).cast("double").alias("median"))
    return out.select("r.column", "rows", "r.s.missing", F.try_divide(100.0 * F.col("r.s.missing"), F.col("rows")).alias("missing_percent"), "r.s.distinct", "r.s.least", "r.s.largest", "r.s.mean", "median")


def coerced(df: DataFrame, fragments: tuple[str, ...], convert) -> DataFrame:
    """df with the columns whose names hold a fragment converted."""
    return df.select(*(convert(F.col(c)).alias(c) if any(f in c for f in fragments) else F.col(c) for c in df.columns))


def date_spans(df: DataFrame, split: str, column: str) -> DataFrame:
    """(split, rows, missing, first, last, days): the dates of each split."""
    c = F.col(column)
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.count(F.when(c.isNull(), 1)).alias("missing"), F.min(c).alias("first"), F.max(c).alias("last"), F.count_distinct(c).alias("days"))


# What makes a feature suspicious, and from which value on (of unique_ratio: above it).
SUSPICIONS = {"very_high_cardinality": ("unique_ratio", 0.50), "very_high_target_correlation": ("abs_corr_with_target", 0.95), "high_mutual_information": ("mutual_information", 1.0)}


def suspicion(train: DataFrame, others: dict[str, DataFrame], features: list[str], target: str, target_bin: Column) -> DataFrame:
    """A row for each feature: its values, gaps, values unseen by training rows, ties with the target, and flags joined by semicolons.

    Numbers have a correlation with the target, texts the population deviation of the target's medians by
    value (null is a value of its own there). Mutual information is that of values with target_bin, over all
    rows. What is joined are counts of (feature, value), so no set of values is held in one place.
    """
    numeric = [c for c in features if c in numeric_columns(train)]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in features))).alias("s")

    def counted(df: DataFrame) -> DataFrame:
        return df.select(pairs).select("s.*").groupBy("feature", "value").agg(F.count("*").alias("n"))

    texts = train.select(pairs, F.col(target).cast("double").alias("y")).select("s.*", "y").where(~F.col("feature").isin(numeric))
    medians = quantile_table(texts, ["feature", "value"], {"y": F.col("y")}, {"median": 0.5}).toDF("f", "v", "median")
    own = counted(train).join(medians, (F.col("feature") == F.col("f")) & F.col("value").eqNullSafe(F.col("v")), "left").drop("f", "v")
    out = own.groupBy("feature").agg(
        F.count("value").alias("unique_count"),
        (F.count("value") / F.sum("n")).alias("unique_ratio"),
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("missing_fraction"),
        F.stddev_pop("median").alias("category_median_std"),
    )
    seen = own.dropna(subset=["value"]).select("feature", "value", F.lit(True).alias("seen"))
    for name, df in others.items():
        there = counted(df).dropna(subset=["value"]).join(seen, ["feature", "value"], "left")
        unseen = F.sum(F.when(F.col("seen").isNull(), F.col("n")).otherwise(0)) / F.sum("n")
        out = out.join(there.groupBy("feature").agg(unseen.alias(f"{name}_unseen_fraction")), "feature", "left")
    tied = F.array(*(F.struct(F.lit(c).alias("feature"), (F.abs(correlation(F.col(c), F.col(target))) if c in numeric else F.lit(None).cast("double")).alias("abs_corr_with_target")) for c in features))
    out = out.join(train.agg(tied.alias("s")).select(F.explode("s").alias("s")).select("s.*"), "feature", "left")
    out = out.join(mi_binned(train, {c: F.col(c) for c in features}, target_bin).drop("rows"), "feature", "left")
    found = [F.when((F.col(c) > least) if c == "unique_ratio" else (F.col(c) >= least), flag) for flag, (c, least) in SUSPICIONS.items()]
    return out.withColumn("suspicion_flags", F.concat_ws(";", *found))


def same_columns(*frames: DataFrame) -> bool:
    return all(set(f.columns) == set(frames[0].columns) for f in frames)
