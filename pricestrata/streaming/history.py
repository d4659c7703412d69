"""The same histories over a stream of snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import point_in_time

#: Parts of the entities that a stream's histories are kept in; a batch makes those anew that it has rows of.
BUCKETS = 64


def snapshots(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder; files: so many a batch at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def once_a_day(stream: DataFrame, entity: str, time: str, late: str = "7 days") -> DataFrame:
    """Without repeats of an entity's row of one moment that arrive within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([entity, time])


def daily_summary(stream: DataFrame, key: str, time: str, value: str, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Rows, mean, least and largest value by key and window, once late rows can no longer come."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest")).select(F.col("window.start").alias("start"), key, "n", "mean", "least", "largest")


def _merged(path: str, history: Callable[[DataFrame], DataFrame], entity: str, buckets: int) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        touched = [r[0] for r in spark.read.parquet(f"{path}/rows/batch={number}").select("bucket").distinct().collect()] if not own.isEmpty() else []
        if touched:
            rows = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(*touched)).drop("batch")  # so few that it prunes folders
            made = history(rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int"))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/history")

    return merge


def keep_histories(stream: DataFrame, path: str, entity: str, date: str, price: str, *ties: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps point-in-time histories below path up to date with a stream, whatever order its rows come in.

    Late rows change what was known after them, so they cannot be folded into a state: a batch's rows are added to
    those kept, and the histories of the buckets of entities that it touches are made anew from all their rows.
    A batch that is tried again writes over what it wrote. Runs over what is there, and ends.
    """
    merge = _merged(path, lambda rows: point_in_time(rows, entity, date, price, *ties), entity, buckets)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def histories(spark: SparkSession, path: str) -> DataFrame:
    """What keep_histories has kept."""
    return spark.read.parquet(f"{path}/history").drop("bucket")
