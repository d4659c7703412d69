"""Reading snapshots whose headers drift, and writing tables and reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a listing file, and those that it must have.
LISTING = ("product_id", "part_name", "price", "quality_grade", "year", "oem_number", "engine_code", "mileage", "brand", "model", "category", "subcategory", "scrape_date", "scrape_timestamp")
REQUIRED = ("part_name", "price", "quality_grade", "year", "oem_number", "mileage", "brand", "model", "category", "subcategory", "engine_code")
# Fixed value: a header's misspelling.
RENAMED = {"roduct_id": "product_id"}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or a folder of this machine where that is unset (tests)."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='pricestrata-')).rstrip('/')}/table-{uuid.uuid4().hex}"


def header_name(c: str) -> str:
    return "_".join(c.replace("﻿", "").strip().lower().split())


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8", named: bool = True, **options: str) -> DataFrame:
    """All columns as texts, with normalised names (or, not named, the file's path too); rows that do not parse go."""
    df = spark.read.options(header=True, sep=sep, encoding=encoding, inferSchema=False, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, quote='"', escape='"', **options).csv(path)
    return df.toDF(*map(header_name, df.columns)) if named else df.select("*", F.col("_metadata.file_path").alias("source_file"))


def encoding_of(spark: SparkSession, path: str) -> str:
    """utf-8 if all bytes are, or else latin-1. Reads through Spark, so that any store will do."""
    decodes = F.col("content").cast("string").isNotNull() & F.is_valid_utf8(F.col("content").cast("string"))
    ok = spark.read.format("binaryFile").load(path).agg(F.min(decodes.cast("int"))).first()[0]
    return "UTF-8" if ok else "ISO-8859-1"


def snapshot_paths(spark: SparkSession, root: str, excluding: str = "/merged/") -> list[str]:
    """The CSV files below root, sorted."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv").load(root).select("path").where(~F.contains("path", F.lit(excluding)))
    return sorted(r["path"] for r in found.collect())


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All listing files below root with LISTING columns and source_file: files of one header are read together.

    Files without a required column are left out; a missing optional column is null and extra ones go.
    """
    by: dict[tuple[str, ...], list[str]] = {}
    for path in snapshot_paths(spark, root):
        first = spark.read.text(path).limit(1).collect()
        names = tuple(RENAMED.get(n, n) for n in map(header_name, first[0][0].split(","))) if first else ()
        if set(REQUIRED) <= set(names):
            by.setdefault(names, []).append(path)
    frames = []
    for names, paths in by.items():
        df = read_csv(spark, paths, named=False)
        df = df.toDF(*names, "source_file")
        frames.append(df.select(*(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in LISTING), "source_file"))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*LISTING, "source_file")))
    return reduce(DataFrame.unionByName, frames)


def routed(df: DataFrame, words: tuple[str, ...], column: str = "source_file") -> DataFrame:
    """df with `route`: the first word that the file's path holds."""
    out = F.lit(None).cast("string")
    for w in reversed(words):
        out = F.when(F.contains(F.lower(column), F.lit(w)), w).otherwise(out)
    return df.withColumn("route", out)


def read_splits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet tables together; a path given twice is an error."""
    if len(set(paths)) < len(paths):
        raise ValueError("a path is given twice")
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_reports(spark: SparkSession, pattern: str, order: list[str]) -> DataFrame:
    """One row for each JSON report that a pattern finds."""
    return spark.read.option("multiLine", True).json(pattern).orderBy(*order)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON line, through Spark's writer."""
    spark.range(1).select(F.lit(json.dumps(report, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def round_trip(df: DataFrame, path: str) -> bool:
    """Whether a written table reads back as it was."""
    write_table(df, path)
    back = df.sparkSession.read.parquet(path)
    return back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
