"""What a crawl reaches: rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch_path


def reached(links: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, round): every node that links (src, dst) lead to from seeds (node), and the round that meets it first; seeds have 0.

    A round follows the links of the last round's new nodes alone, and takes what no round before had. Rounds are tables:
    the driver sees whether one is empty, and no more. Without a bound it ends when nothing new is met. Nulls lead nowhere.
    """
    spark = links.sparkSession
    own = links.select("src", "dst").dropna().distinct()
    path = scratch_path(spark)
    own.write.parquet(f"{path}/links")
    own = spark.read.parquet(f"{path}/links")
    at, schema = 0, f"node {dict(seeds.dtypes)['node']}, round int"
    seeds.select("node").dropna().distinct().withColumn("round", F.lit(0)).write.parquet(f"{path}/rounds/at=0")
    met = lambda i: spark.read.schema(schema).parquet(*(f"{path}/rounds/at={k}" for k in i))
    while (rounds is None or at < rounds) and not met([at]).isEmpty():
        new = own.join(met([at]).select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new.join(met(range(at + 1)).select("node"), "node", "left_anti").withColumn("round", F.lit(at + 1)).write.parquet(f"{path}/rounds/at={at + 1}")
        at += 1
    return met(range(at + 1))
