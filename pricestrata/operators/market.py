"""What comparable listings say of a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import sequenced

ENOUGH, NEAREST = 5, 50
# The least half-width of a range, as a share and in euros, and that of the fallback.
SHARE, EUROS, FALLBACK = 0.10, 15.0, 75.0
LEVELS = (
    ("part_name", "brand", "model", "quality_grade"),
    ("part_name", "brand", "model"),
    ("part_name", "brand"),
    ("part_name",),
    ("subcategory", "brand"),
)


def comparable_range(queries: DataFrame, reference: DataFrame, levels: tuple[tuple[str, ...], ...] = LEVELS, order: str = "ref_id") -> DataFrame:
    """queries (query_id, the key columns, mileage, prediction) with low, high, comparables and source.

    Levels are tried from narrow to broad, blank inputs left out; the first with ENOUGH rows holds. Its
    NEAREST rows by mileage (by order, without a mileage) give the 10th and 90th percentile, widened
    around the prediction. Keys with ENOUGH rows are counted first, so a query looks at the one level that it takes.

    Queries and rows are merged in one order of (key, mileage), upwards and downwards, in ranges; a query
    then takes the NEAREST places after its own on either side. So it meets twice NEAREST rows with a mileage at most, and
    NEAREST others, however many rows its key has.
    """
    text = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    named = lambda i, keys: F.to_json(F.array(F.lit(str(i)), *(text(k) for k in keys))).alias("__key")
    ref = reference.where("price is not null")
    asked = rows = None
    for i, keys in enumerate(levels):
        a, r = queries, ref
        for k in keys:
            a = a.where(F.coalesce(text(k), F.lit("")) != "")
            r = r.where(text(k).isNotNull())
        a = a.select("query_id", F.lit(i).alias("level"), F.col("mileage").cast("double").alias("__m"), named(i, keys))
        r = r.select(named(i, keys), F.col(order).alias("__order"), "price", F.col("mileage").cast("double").alias("__rm"))
        asked, rows = (a, r) if asked is None else (asked.unionAll(a), rows.unionAll(r))
    enough = rows.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") >= ENOUGH).select("__key")
    first = asked.join(enough, "__key").groupBy("query_id").agg(F.min(F.struct("level", "__m", "__key")).alias("s")).select("query_id", "s.*")
    own = rows.join(first.select("__key").distinct(), "__key", "left_semi")
    # One order for both: of equal mileages rows upwards come after a query, and downwards before it.
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = dict(rows.dtypes) | dict(first.dtypes)
    a = own.where("__rm is not null").select("__key", sides, "__order", "price", "__rm", nothing("query_id", kinds["query_id"]), nothing("level", "int"), F.lit(1).alias("is_row"))
    b = first.where("__m is not null").select("__key", sides, nothing("__order", kinds["__order"]), nothing("price", kinds["price"]), F.col("__m").alias("__rm"), "query_id", "level", F.lit(0).alias("is_row"))
    merged = a.unionAll(b).withColumns({"value": F.col("side") * F.col("__rm"), "flag": F.when(F.col("is_row") == 1, 0).otherwise(-F.col("side"))})
    merged = sequenced(merged, ["__key", "side"], ["value", "flag", "__order"], ("is_row",))
    placed = merged.where("is_row = 1").select("__key", "side", (F.col("before_is_row") + 1).alias("at"), "__order", "price", "__rm")
    wanted = merged.where("is_row = 0").select("query_id", "level", "__key", "side", F.col("__rm").alias("__m"), F.explode(F.sequence(F.col("before_is_row") + 1, F.col("before_is_row") + NEAREST)).alias("at"))
    near = wanted.join(placed, ["__key", "side", "at"]).select("query_id", "level", "__order", "price", F.abs(F.col("__m") - F.col("__rm")).alias("away"))
    # Rows without a mileage come last, and a query without one takes any: the first of each key will do.
    start = F.row_number().over(Window.partitionBy("__key").orderBy("__order"))
    for some, who in ((own.where("__rm is null"), F.col("__m").isNotNull()), (own, F.col("__m").isNull())):
        few = some.select("__key", "__order", "price").withColumn("k", start).where(F.col("k") <= NEAREST).drop("k")
        near = near.unionAll(first.where(who).join(few, "__key").select("query_id", "level", "__order", "price", nothing("away", "double")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("away"), "__order"))
    near = near.withColumn("place", place).where(F.col("place") <= NEAREST)
    by = near.groupBy("query_id", "level").agg(F.percentile("price", 0.1).alias("p10"), F.percentile("price", 0.9).alias("p90"), F.count("*").alias("comparables"))
    least = F.greatest(SHARE * F.col("prediction"), F.lit(EUROS))
    out = queries.join(by, "query_id", "left")
    low = F.when(F.col("level").isNull(), F.col("prediction") - FALLBACK).otherwise(F.least("p10", F.col("prediction") - least))
    high = F.when(F.col("level").isNull(), F.col("prediction") + FALLBACK).otherwise(F.greatest("p90", F.col("prediction") + least))
    return out.select(*queries.columns, F.greatest(low, F.lit(0.0)).alias("low"), high.alias("high"), F.coalesce("comparables", F.lit(0)).alias("comparables"), F.when(F.col("level").isNull(), "fallback").otherwise("comparable_rows").alias("source"))


def support_label(n: Column) -> Column:
    return F.when(n >= 20, "Strong").when(n >= 8, "Moderate").otherwise("Limited")


def completed_input(reference: DataFrame, given: dict[str, object], order: str) -> dict[str, object]:
    """A full input: the first reference row that agrees with all five keys, or else with one, or any; then what was given."""
    keys = [k for k in ("brand", "model", "category", "part_name", "subcategory") if given.get(k) not in (None, "", "Any")]
    same = lambda k: F.col(k).cast("string") == str(given[k])
    tier = F.lit(99)
    for i, k in reversed(list(enumerate(k for k in ("brand", "model", "category", "part_name") if k in keys))):
        tier = F.when(same(k), i + 1).otherwise(tier)
    if len(keys) == 5:
        whole = same(keys[0])
        for k in keys[1:]:
            whole = whole & same(k)
        tier = F.when(whole, 0).otherwise(tier)
    row = reference.orderBy(tier, order).limit(1).collect()[0].asDict()
    row |= {k: v for k, v in given.items() if v is not None}
    if row.get("year_start") is not None and row.get("year_end") is not None:
        row |= {"year_span": row["year_end"] - row["year_start"], "year_mid": (row["year_start"] + row["year_end"]) / 2}
    return row | {"mileage_missing_flag": row.get("mileage") is None}


def options(reference: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not blank, sorted."""
    return reference.select(F.col(column).cast("string").alias("option")).where("option is not null and trim(option) <> ''").distinct().orderBy("option")


def confidence_band(p: Column, rmse: float, z: float = 1.645) -> tuple[Column, Column]:
    return F.greatest(p - z * rmse, F.lit(0.0)), p + z * rmse


def error_scale(metrics: dict[str, float]) -> float:
    for name in ("test_RMSE", "validation_RMSE", "test_MAE", "validation_MAE"):
        if metrics.get(name) is not None:
            return metrics[name]
    raise ValueError("no error metric")
