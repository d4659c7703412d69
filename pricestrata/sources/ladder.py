"""Delimited files of unknown encodings and drifting headers, read line by line; what does not parse is kept apart."""

from __future__ import annotations

import csv
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import sequenced
from .files import header_name, scratch_path

# The characters of the bytes 0x80 to 0x9F that windows-1252 has and ISO-8859-1 has not.
_HIGH = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


class Read(NamedTuple):
    """rows: texts by normalised header, with source_file and line; quarantine: (source_file, line, encoding, text) of lines that have not as many fields as their header."""

    rows: DataFrame
    quarantine: DataFrame
    encodings: DataFrame


def decoded(value: Column, encoding: Column) -> Column:
    """The text of a line's bytes."""
    single = F.decode(value, "ISO-8859-1")
    high = F.translate(single, "".join(a for a, _ in _HIGH), "".join(b for _, b in _HIGH))
    return F.when(encoding == "utf-8", value.cast("string")).when(encoding == "cp1252", high).otherwise(single)


def read_ladder(spark: SparkSession, paths: str | list[str], sep: str = ",") -> Read:
    """All lines of files, whatever encoding each is in; records do not span lines.

    A file is UTF-8 (with or without a mark) if all its lines are; or else cp1252 if it has bytes that ISO-8859-1 has no
    characters for, and ISO-8859-1 otherwise. Executors try all files in one job, lines of a large one in many tasks.
    Lines are numbered by ranges, so one of another encoding or a broken one is found again by file and number.
    The driver sees one header for each distinct one.
    """
    lines = spark.read.text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    placed = sequenced(lines, ["source_file"], ["__start", "__at"], place="line").drop("__start", "__at")
    single = F.decode("value", "ISO-8859-1")
    encodings = placed.groupBy("source_file").agg(F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("__utf8"), F.bool_or(single.rlike("[\u0080-\u009f]")).alias("__high"))
    encodings = encodings.select("source_file", F.when(F.col("__utf8"), "utf-8").when(F.col("__high"), "cp1252").otherwise("iso-8859-1").alias("encoding"))
    text = F.regexp_replace(decoded(F.col("value"), F.col("encoding")), "^﻿|\r$", "")
    own = placed.join(encodings, "source_file").select("source_file", "line", "encoding", text.alias("text"))
    path = scratch_path(spark)
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    heads = own.where("line = 1").select("source_file", F.col("text").alias("head"))
    rows = bad = None
    for head in sorted(r[0] for r in heads.select("head").distinct().collect()):
        names = [header_name(c) for c in next(csv.reader([head], delimiter=sep), [])]
        some = own.where("line > 1 and trim(text) <> ''").join(heads.where(F.col("head") == head).select("source_file"), "source_file", "left_semi")
        schema = ", ".join([*(f"`c{i}` string" for i in range(len(names))), "`__bad` string"])
        some = some.withColumn("r", F.from_csv("text", schema, {"sep": sep, "columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))
        fine, broken = some.where("r.__bad is null"), some.where("r.__bad is not null").select("source_file", "line", "encoding", "text")
        fine = fine.select("source_file", "line", *(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))
        rows = fine if rows is None else rows.unionByName(fine, allowMissingColumns=True)
        bad = broken if bad is None else bad.unionAll(broken)
    if rows is None:
        rows, bad = own.select("source_file", "line").limit(0), own.limit(0)
    return Read(rows, bad, encodings)


def keep_quarantine(read: Read, path: str) -> None:
    """Adds the lines that did not parse to a table below path."""
    read.quarantine.write.mode("append").parquet(path)
