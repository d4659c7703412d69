"""Places, running sums and quantiles within groups of any size, by range partitions.

A window by a key sorts all of the key's rows in one task. Here rows are dealt out by ranges of (key,
order), numbered within their partition in one pass, and a partition that goes on with the key of the one
before gets that key's count and sums so far as an offset. There is one such offset for each border of two
partitions at most, so joining them is a broadcast of a proven bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch_path


def _starts(keys: list[pa.Array], last: list[pa.Array] | None) -> np.ndarray:
    """Where a row's key isn't that of the row before it; last: the keys, in arrays of one, of the batch before."""
    n = len(keys[0]) if keys else 0
    out = np.zeros(n, bool)
    for i, c in enumerate(keys):
        before = pa.concat_arrays([last[i] if last else c.slice(0, 1), c.slice(0, n - 1)])
        other = pc.fill_null(pc.not_equal(c, before), False)
        if pa.types.is_floating(c.type):
            other = pc.and_(other, pc.invert(pc.fill_null(pc.and_(pc.is_nan(c), pc.is_nan(before)), False)))
        out |= pc.or_(other, pc.not_equal(pc.is_null(c), pc.is_null(before))).to_numpy(zero_copy_only=False)
    if n and not last:
        out[0] = True
    return out


def _running(values: np.ndarray, start: np.ndarray, held) -> tuple[np.ndarray, object]:
    """(sum of the values before each row in its run, sum at the end); held: what the first run has so far."""
    total = np.cumsum(values)
    before = total - values
    first = np.maximum.accumulate(np.where(start, np.arange(len(values)), -1))
    out = np.where(first < 0, before + held, before - before[np.maximum(first, 0)])
    return out, out[-1] + values[-1]


def sequenced(df: DataFrame, keys: list[str], order: list[str | Column], sums: tuple[str, ...] = (), place: str = "place", parts: int | None = None) -> DataFrame:
    """df with its place (from 1) within keys in an order, and before_<c>, the sum of the rows before, of each of sums.

    The order should leave no ties, or its ties be alike. A null key is a key like any other; a null in a column
    of sums counts as 0. Sums are of longs for whole numbers and of doubles otherwise. The result is a written
    table, so that every reader sees one numbering.
    """
    spark = df.sparkSession
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {c: "long" if isinstance(df.schema[c].dataType, whole) else "double" for c in sums}
    own = df.select(*df.columns, *(F.coalesce(F.col(c).cast(k), F.lit(0).cast(k)).alias(f"before_{c}") for c, k in kinds.items()))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    at = [own.columns.index(k) for k in keys]
    width = len(df.columns)
    names = [*df.columns, place, *(f"before_{c}" for c in sums), "__part"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, [0] * (1 + len(sums))
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i) for i in range(len(b.columns))]
            start = _starts([columns[i] for i in at], last) if at else np.arange(b.num_rows) == (0 if last is None else -1)
            last = [columns[i].slice(b.num_rows - 1, 1) for i in at]
            out = []
            for j, values in enumerate([np.ones(b.num_rows, np.int64), *(c.to_numpy(zero_copy_only=False) for c in columns[width:])]):
                own, held[j] = _running(values, start, held[j])
                out.append(pa.array(own + 1 if j == 0 else own))
            yield pa.RecordBatch.from_arrays([*columns[:width], *out, pa.array(np.full(b.num_rows, part, np.int32))], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField(place, T.LongType()), *(T.StructField(f"before_{c}", T.LongType() if k == "long" else T.DoubleType()) for c, k in kinds.items()), T.StructField("__part", T.IntegerType())])
    path = scratch_path(spark)
    dealt.mapInArrow(number, schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    values = {place: F.count("*"), **{f"before_{c}": F.sum(F.col(c).cast(kinds[c])) for c in sums}}
    runs = out.groupBy("__part", *keys).agg(*(F.coalesce(v, F.lit(0)).alias(f"__{c}") for c, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col("__part").alias("__of"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.sum(f"__{c}").over(earlier).alias(f"__{c}") for c in values)).where(F.col(f"__{place}").isNotNull())
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__of"))
    joined = out.join(F.broadcast(offsets), on, "left")  # a row for each border of partitions at most
    return joined.select(*df.columns, *((F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in values))


def quantile_table(df: DataFrame, keys: list[str], measures: dict[str, Column], fractions: dict[str, float]) -> DataFrame:
    """keys, and <measure>_<name> for each fraction by name: exact quantiles, interpolated between neighbours.

    Nulls and NaNs of a measure do not count; a group without any value has nulls. Equal values are counted before anything
    is sorted, so a value that very many rows share is one row.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("__m"), F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias("__v")) for m, c in measures.items()))).alias("__s")
    named = df.select(*keys, pairs).select(*keys, "__s.*")
    counts = named.where("__v is not null").groupBy(*keys, "__m", "__v").agg(F.count("*").alias("__n"))
    placed = sequenced(counts, [*keys, "__m"], ["__v"], ("__n",), "__place")
    by = [f"__g{i}" for i in range(len(keys))]
    totals = placed.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, by)), F.col("__m").alias("__gm")).agg(F.sum("__n").alias("__all"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, by)), F.col("__m") == F.col("__gm"))
    rows = placed.join(totals, on).select(*keys, "__m", "__v", F.col("before___n").alias("__b"), (F.col("before___n") + F.col("__n")).alias("__e"), "__all")
    found = []
    for name, q in fractions.items():
        at = (F.col("__all") - 1) * F.lit(float(q))
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            rows = rows.withColumn(f"__{side}_{name}", F.when((F.col("__b") <= place) & (place < F.col("__e")), F.col("__v")))
        rows = rows.withColumn(f"__part_{name}", at - F.floor(at))
    for m in measures:
        for name in fractions:
            pick = lambda c, m=m: F.max(F.when(F.col("__m") == m, F.col(c)))
            low, high, part = pick(f"__low_{name}"), pick(f"__high_{name}"), pick(f"__part_{name}")
            found.append((low * (1 - part) + high * part).alias(f"{m}_{name}"))
    needed = reduce(lambda a, b: a | b, (F.col(f"__{s}_{n}").isNotNull() for n in fractions for s in ("low", "high")))
    return rows.where(needed).groupBy(*keys).agg(*found)  # of each measure and fraction a row or two


def with_quantiles(summary: DataFrame, df: DataFrame, keys: list[str], measures: dict[str, Column], fractions: dict[str, float]) -> DataFrame:
    """A summary by keys with the quantiles of df beside it."""
    table = quantile_table(df, keys, measures, fractions)
    names = [c for c in table.columns if c not in keys]
    if not keys:
        return summary.withColumn("__one", F.lit(1)).join(table.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")
    renamed = table.select(*(F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)), *names)
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__q{i}")) for i, k in enumerate(keys)))
    return summary.join(renamed, on, "left").select(*summary.columns, *names)


def edges(df: DataFrame, column: Column, parts: int = 5) -> list[float]:
    """The distinct edges of `parts` bins of equal numbers of rows; none of a column without values."""
    names = {str(i): i / parts for i in range(parts + 1)}
    row = quantile_table(df, [], {"q": column}, names).first()
    return sorted({row[f"q_{n}"] for n in names if row[f"q_{n}"] is not None}) if row else []


def dense_ranked(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """df with a dense rank for each (name, column): the place of its value among the distinct ones, nulls first."""
    out = df
    for name, c in ranks.items():
        values = sequenced(df.select(F.col(c).alias("__value")).distinct(), [], ["__value"], place=name)
        out = out.join(values, F.col(c).eqNullSafe(F.col("__value")), "left").drop("__value")
    return out
