"""Whitening of embeddings by an exact integer scatter.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT. Tasks subtract the shift again and
add up counts, sums and cross-products as whole numbers of any size; Spark adds those up in pieces of
30 bits, which a long never overflows. The scatter n * X'X - S S' is then exact, and only that is
converted to floating point and decomposed. The driver sees one number for each pair of dimensions.

Rows whose vector is null, empty or holds a null or a non-finite entry take no part, nor do those of
another length than most (of equally many, the greater). Repeated rows count each time, and a null id
is kept. A component whose variance is zero up to rounding (the vectors span fewer dimensions) has no
whitened value: null. deviation is null where a long can't hold it; deviation_text always has it. Of
an empty table, or one without usable vectors, the result is empty. Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a piece of a whole number, as tasks send them.
PIECE = 30
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def lattice(c: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c): of int64 where that holds it with room to spare, of Python's own numbers otherwise."""
    if not c.size or np.abs(c).max() < 2.0**40 / scale:
        return np.floor(c * scale).astype(np.int64)
    return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(c)


def products(y: np.ndarray) -> np.ndarray:
    """y'y as Python's own numbers. Blocks of rows whose products a double holds exactly are multiplied as doubles."""
    d = y.shape[1]
    out = np.zeros((d, d), dtype=object)
    largest = int(np.abs(y).max()) if y.size else 0
    if largest**2 >= 2**53:
        return out + y.astype(object).T.dot(y.astype(object))
    rows = max(1, 2**53 // max(1, largest**2))
    for i in range(0, len(y), rows):
        part = y[i : i + rows].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def pieces(cells: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(cell, place, value): cells[cell] is the sum of value << PIECE * place."""
    at: list[tuple[int, int, int]] = []
    for cell, whole in enumerate(cells):
        left, sign, place = abs(whole), -1 if whole < 0 else 1, 0
        while left:
            at.append((cell, place, sign * (left & ((1 << PIECE) - 1))))
            left >>= PIECE
            place += 1
    return [a for a, _, _ in at], [b for _, b, _ in at], [c for _, _, c in at]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, c) of the rows that take part, and how long their vectors are (0: there are none)."""
    fine = F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("c") > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c")).where(F.coalesce(fine, F.lit(False)))
    widths = rows.groupBy(F.size("c").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return rows.where(F.size("c") == width), width


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scatter(rows: DataFrame, width: int, scale: int = SCALE) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, n * Y'Y - S S') of the whole numbers without their shift, all of them exact."""
    upper = np.triu_indices(width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for b in batches:
            if b.num_rows:
                y = lattice(_matrix(b.column(0)), scale)
                n, s, p = n + len(y), s + y.sum(axis=0).astype(object), p + products(y)
        if n:
            cell, place, value = pieces([n, *s, *p[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], names=["cell", "place", "value"])

    cells = [0] * (1 + width + len(upper[0]))
    for r in rows.select("c").mapInArrow(summed, "cell int, place int, value long").groupBy("cell", "place").agg(F.sum("value").alias("value")).collect():
        cells[r["cell"]] += r["value"] << PIECE * r["place"]
    n, sums = cells[0], cells[1 : width + 1]
    cross = np.zeros((width, width), dtype=object)
    cross[upper] = cells[width + 1 :]
    cross.T[upper] = cross[upper]
    s = np.array(sums, dtype=object)
    return n, sums, n * cross - np.outer(s, s)


def components(n: int, scattered: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(unit eigenvectors in rows, variances, explained shares, bits) of the k largest; values are divided by 2 ** bits first.

    Values are scaled down by a power of two only where a double could not hold a variance.
    """
    bits = max(0, (max(abs(int(v)) for v in scattered.flat).bit_length() - 2 * n.bit_length() - 900) // 2)
    covariance = np.array([[int(v) / (n * n << 2 * bits) for v in line] for line in scattered])
    values, vectors = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[:k]
    chosen = vectors.T[first]
    signs = np.sign(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(axis=1)])
    trace = np.trace(covariance)
    found = np.where(values[first] > len(values) * np.finfo(float).eps * max(values.max(), 0.0), values[first], 0.0)
    return chosen * signs[:, None], found, np.maximum(values[first], 0) / trace if trace > 0 else np.full(len(first), np.nan), bits


def _whole(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows: of decimals, each rounded to 20 digits after the point."""
    return F.sum(value.cast("decimal(38,20)"))


def whitened(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component, of SCHEMA."""
    spark = vectors.sparkSession
    rows, width = usable(vectors)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    n, sums, scattered = scatter(rows, width, scale)
    axes, variances, explained, bits = components(n, scattered, k)
    with np.errstate(divide="ignore", invalid="ignore"):
        turned = np.where(variances[:, None] > 0, axes / np.sqrt(variances)[:, None], np.nan)
    largest = max(map(abs, sums))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                y = lattice(_matrix(b.column(1)), scale)
                small = y.dtype == np.int64 and n * int(np.abs(y).max()) + largest < 2**62
                away = n * y - np.array(sums, dtype=np.int64) if small else n * y.astype(object) - np.array(sums, dtype=object)
                wide = small and int(np.abs(away).max()) ** 2 * width < 2**63
                deviation = [int(v) for v in ((away * away).sum(axis=1) if wide else (away.astype(object) ** 2).sum(axis=1))]
                centred = away / n if small and not bits else np.array([[int(v) / (n << bits) for v in line] for line in away])
                # Summed row by row and not as a matrix product, whose last bits depend on the batch.
                out = (centred[:, None, :] * turned[None]).sum(axis=2)
                flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), flat)
                fits = pa.array([v if v < 2**63 else None for v in deviation], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), fits, values, pa.array(map(str, deviation), pa.string())], names=["vec_id", "deviation", "whitened", "deviation_text"])

    out = kept(rows.select("vec_id", "c").mapInArrow(turn, "vec_id long, deviation long, whitened array<double>, deviation_text string"))
    at = [(i, j) for i in range(len(variances)) for j in range(i, len(variances))]
    column = lambda i: F.col("whitened")[i]
    sums = out.agg(*(_whole(column(i)).alias(f"s{i}") for i in range(len(variances))), *(_whole(column(i) * column(j)).alias(f"p{i}_{j}") for i, j in at)).first().asDict()
    mean = {k: Fraction(v) / n for k, v in sums.items() if v is not None}
    errors = [abs(float(mean[f"p{i}_{j}"] - mean[f"s{i}"] * mean[f"s{j}"] - (i == j))) for i, j in at if f"p{i}_{j}" in mean]
    shares = F.array(*(F.lit(float(v)) if v == v else F.lit(None).cast("double") for v in explained))
    each = out.select("vec_id", "deviation", "deviation_text", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"),
        F.lit(max(errors) if errors else None).cast("double").alias("identity_error"), "deviation_text")
