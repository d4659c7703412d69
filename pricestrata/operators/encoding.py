"""Encodings of text columns whose levels may be many: they are tables that rows join, and never lists on the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch_path
from .models import estimator
from .quality import numeric_columns, text_columns
from .ranges import quantile_table, sequenced
from .splits import SEED, hashed


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))).alias("s")).select("s.*")


class FrozenLevels:
    """The levels of text columns as training rows have them, numbered from 0 in their order; others become missing.

    levels: a table (column, level, code).
    """

    def __init__(self, columns: list[str], levels: DataFrame) -> None:
        self.columns, self.levels = list(columns), levels

    @classmethod
    def of(cls, train: DataFrame, columns: list[str]) -> FrozenLevels:
        levels = _pairs(train, columns).dropna().distinct()
        placed = sequenced(levels, ["column"], ["level"])
        return cls(columns, placed.select("column", "level", (F.col("place") - 1).alias("code")))

    def __call__(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        """df with <column>_code beside each of its columns: null for null and for levels that training rows do not have."""
        out = df
        for c in self.columns:
            own = self.levels.where(F.col("column") == c).select(F.col("level").alias("__level"), F.col("code").cast("double").alias(f"{c}{suffix}"))
            out = out.join(own, F.col(c).cast("string") == F.col("__level"), "left").drop("__level")
        return out

    def save(self, path: str) -> None:
        self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        self.levels.sparkSession.createDataFrame([(i, c) for i, c in enumerate(self.columns)], "place int, column string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FrozenLevels:
        columns = [r["column"] for r in spark.read.parquet(f"{path}/columns").orderBy("place").collect()]
        return cls(columns, spark.read.parquet(f"{path}/levels"))


def ordered_statistics(df: DataFrame, category: str, target: str, key: str, weight: float = 1.0, salt: object = SEED, name: str = "statistic") -> DataFrame:
    """df with the smoothed mean target of the rows of its category that come before it in the order of a hash of key.

    Of n rows before with a target: (their sum + weight * the mean of all rows) / (n + weight). A row's own target thus
    never counts. A null category is one like any other. Running sums go by ranges, so a category of most rows is many tasks.
    """
    mean = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    y = F.col(target).cast("double")
    own = df.withColumns({"__y": y, "__one": y.isNotNull().cast("long"), "__h": hashed(F.col(key), salt)})
    out = sequenced(own, [category], ["__h", key], ("__y", "__one"), "__place")
    statistic = (F.col("before___y") + weight * F.lit(mean)) / (F.col("before___one") + weight)
    return out.withColumn(name, statistic).select(*df.columns, name)


class OrderedFeatures:
    """Numbers with exact medians for gaps, and ordered target statistics of text columns, assembled as `features`.

    train holds the training rows, each encoded by the rows before it alone; other rows get statistics of all training rows.
    """

    def __init__(self, train: DataFrame, features: list[str], target: str, key: str, weight: float = 1.0) -> None:
        self.numeric = [c for c in numeric_columns(train) if c in features]
        self.text = [c for c in text_columns(train) if c in features]
        row = quantile_table(train, [], {c: F.col(c) for c in self.numeric}, {"median": 0.5}).first() if self.numeric else None
        self.medians = {c: row[f"{c}_median"] if row and row[f"{c}_median"] is not None else 0.0 for c in self.numeric}
        self.mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
        y = F.col(target).cast("double")
        if self.text:
            path = scratch_path(train.sparkSession)
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in self.text)))
            by = train.select(pairs.alias("s"), y.alias("y")).groupBy("s.column", "s.level").agg(((F.coalesce(F.sum("y"), F.lit(0.0)) + weight * self.mean) / (F.count("y") + weight)).alias("statistic"))
            by.write.parquet(path)
            self.levels = train.sparkSession.read.parquet(path)
        own = train
        for c in self.text:
            own = ordered_statistics(own, c, target, key, weight, name=f"{c}__t")
        self.train = self._assembled(own)

    def _assembled(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"{c}__n": F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c]))) for c in self.numeric}) if self.numeric else df
        return VectorAssembler(inputCols=[f"{c}__n" for c in self.numeric] + [f"{c}__t" for c in self.text], outputCol="features").transform(filled)

    def __call__(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.text:
            own = self.levels.where(F.col("column") == c).select(F.col("level").alias("__level"), F.col("statistic").alias(f"{c}__t"))
            out = out.join(own, F.col(c).eqNullSafe(F.col("__level")), "left").drop("__level")
            out = out.withColumn(f"{c}__t", F.coalesce(f"{c}__t", F.lit(float(self.mean))))
        return self._assembled(out)


def ordered_fit_predict(target: str, key: str, logged: bool = False, weight: float = 1.0, **options) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """A callback for grouped_cv: boosting over ordered target statistics of text columns."""

    def run(train: DataFrame, rows: DataFrame, features: list[str]) -> DataFrame:
        label = F.log(F.col(target)) if logged else F.col(target).cast("double")
        made = OrderedFeatures(train.withColumn("__target", label), features, "__target", key, weight)
        model = estimator("boosted", **options).fit(made.train)
        p = F.exp("__prediction") if logged else F.greatest(F.col("__prediction"), F.lit(0.0))
        return model.transform(made(rows)).select(*rows.columns, F.col(target).cast("double").alias("actual"), p.alias("predicted"))

    return run
