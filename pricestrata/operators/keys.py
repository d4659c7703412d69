"""Resolving and repairing keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_word, null_if
from .aggregates import unambiguous
from .quality import member
from .ranges import quantile_table

# Words that tell a part's category from a vehicle's model.
TAXONOMY = r"engine|brake|fuel|airbag|suspension|gear ?box|axle|electric|databox|sensor|transmitter|vehicle exterior|drive axle|middle axle"
STATUSES = ("original_valid", "repaired_from_brand_model_family", "ambiguous_unrepaired", "invalid_part_taxonomy_in_model", "unknown_brand_model")


def longest_prefix(df: DataFrame, label: str, aliases: DataFrame) -> DataFrame:
    """df with brand and model: the longest of aliases (alias, brand) that label starts with, and what follows it.

    Labels and aliases are keys (lower case, single spaces). A label is joined by its first word, so
    candidates are few and no pattern is tried on every row. Unresolved labels are models of no brand.
    """
    first = lambda c: F.get(F.split(F.col(c), "[ -]"), F.lit(0))
    plain = lambda c: F.concat(F.regexp_replace(c, "[ -]+", " "), F.lit(" "))
    own = df.select(F.col(label).alias("__label")).distinct().withColumn("__first", first("__label"))
    names = aliases.select("alias", F.col("brand").alias("__brand"), first("alias").alias("__first"))
    hit = F.coalesce(F.startswith(plain("__label"), plain("alias")), F.lit(False))
    longest = F.max(F.when(hit, F.struct(F.length("alias").alias("n"), "alias", "__brand"))).alias("b")
    best = own.join(names, "__first", "left").groupBy("__label").agg(longest)
    rest = null_if(F.btrim(F.substring(F.col("__label"), F.col("b.n") + 1, F.length("__label")), F.lit(" -")), "")
    found = best.select("__label", F.col("b.__brand").alias("brand"), F.when(F.col("b").isNull(), F.col("__label")).otherwise(rest).alias("model"))
    kept = df.withColumn("__own", F.col(label)).drop("brand", "model")
    out = kept.join(found, F.col("__own").eqNullSafe(F.col("__label")), "left")
    return out.select(*(c for c in df.columns if c not in ("brand", "model")), "brand", "model")


def looks_like_taxonomy(df: DataFrame, model: str, category: str, subcategory: str) -> DataFrame:
    """df with model_is_taxonomy: the model is one of the table's categories or subcategories, or names a part."""
    terms = df.select(F.col(category).alias("term")).union(df.select(F.col(subcategory).alias("term"))).dropna().distinct()
    out = member(df, [model], terms, ["term"], "__term")
    return out.withColumn("model_is_taxonomy", F.col("__term") | contains_word(F.col(model), TAXONOMY)).drop("__term")


def repaired(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """df (brand, model, model_is_taxonomy) with key_status, key_brand and key_model against pairs (brand, model).

    In order: the pair is known; the brand is really a model family of one brand, and the model a part's
    category; the family belongs to several brands; the model is a category; the pair is unknown.
    """
    known = pairs.select("brand", "model").dropna().distinct()
    owners = unambiguous(known.select(F.col("model").alias("family"), F.col("brand").alias("owner")), "family", "owner")
    out = member(df, ["brand", "model"], known, ["brand", "model"], "__valid")
    out = out.join(owners.withColumnRenamed("family", "__family"), F.col("brand") == F.col("__family"), "left")
    taxonomy = F.coalesce(F.col("model_is_taxonomy"), F.lit(False))
    repairable = F.col("owner").isNotNull() & taxonomy
    status = F.when(F.col("__valid"), STATUSES[0]).when(repairable, STATUSES[1]).when(F.coalesce(F.col("owners") > 1, F.lit(False)), STATUSES[2]).when(taxonomy, STATUSES[3]).otherwise(STATUSES[4])
    out = out.withColumn("key_status", status)
    fixed = F.col("key_status") == STATUSES[1]
    out = out.withColumns({"key_brand": F.when(fixed, F.col("owner")).otherwise(F.col("brand")), "key_model": F.when(fixed, F.col("__family")).otherwise(F.col("model"))})
    return out.drop("__valid", "__family", "owners", "owner")


def assert_clean(df: DataFrame, makers: DataFrame) -> DataFrame:
    """df, if every repaired brand is a maker's and no key is a status word."""
    bad = df.where((F.col("key_status") == STATUSES[1])).join(makers, F.col("key_brand") == makers[makers.columns[0]], "left_anti")
    words = df.where(F.col("key_model").isin(*STATUSES))
    if not (bad.isEmpty() and words.isEmpty()):
        raise ValueError("repaired keys are contaminated")
    return df


def match_share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def median_lookup(train: DataFrame, rows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """rows with `predicted`: the median target of equal keys in train (nulls equal nulls), or of all of train."""
    by = quantile_table(train, keys, {"y": F.col(target)}, {"median": 0.5}).toDF(*(f"__{k}" for k in keys), "__median")
    found = quantile_table(train, [], {"y": F.col(target)}, {"median": 0.5}).first()
    whole = found[0] if found else None
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(by, reduce(lambda a, b: a & b, on), "left")
    return joined.withColumn("predicted", F.coalesce("__median", F.lit(whole))).drop("__median", *(f"__{k}" for k in keys))


def unseen_share(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(column, unseen_share): the share of rows whose value, as text, train has not."""
    return member(rows.withColumn("__v", F.col(column).cast("string")), ["__v"], train.select(F.col(column).cast("string").alias("v")), ["v"], "__seen").agg(F.lit(column).alias("column"), F.avg((~F.col("__seen")).cast("double")).alias("unseen_share"))


def nearest(df: DataFrame, column: str, value: float, k: int, *ties: str) -> DataFrame:
    """The k rows nearest to a value; nulls come last."""
    return df.orderBy(F.asc_nulls_last(F.abs(F.col(column) - value)), *ties).limit(k)


