"""Nearest neighbours by inner product, through shifted Hilbert orderings of projected vectors.

Each of ORDERS orderings projects the vectors on DIMS random directions, shifts and squashes them into a
grid, and sorts all rows by their place on the grid's Hilbert curve: a range partitioning in Spark. The
sorted rows are cut into windows of equal numbers of rows. A query visits the window of its own key and
as many neighbouring ones as hold a share of the rows; exact inner products rerank each window, and the
best of all orderings merge. The k-th best score of the home windows is a bound: neighbouring windows
send back only what reaches it.

For inner products rows are ordered in bands of norms, a factor of two each; a further coordinate brings
a band's vectors to the length of its longest. Queries have unit length and 0 there, so their nearest vector is the one
of the largest product. Long vectors thus don't squeeze others into a corner; every band is searched.

The share of rows that a query is held against over all orderings is SHARE at 500 rows of a band and
falls with the rows to the power FALL: the more rows, the nearer the nearest. It is large because the
vectors at hand are isotropic: twenty neighbours at cosines of 0.4 to 0.5 in 64 dimensions share little of
any few projections. The README has recall and products; a corpus with real structure needs less.

Rows whose vector is null, zero or holds a null or a non-finite component take no part, nor do those of
another length than most (of equally many, the greater). Ties go to the smaller vec_id. Of rows of one
vec_id the smallest vector counts. Equal vectors ask once, and of equal vectors only those of the
smallest k + 1 ids are candidates, as no others can be among anyone's nearest k. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

K = 20
ORDERS = 16
DIMS = 6
BITS = 5
#: A query is held against SHARE * (500 / rows) ** FALL of a band's rows, over all orderings.
SHARE, FALL = 1.6, 0.17
#: Windows on each side of a query's own, unless those would hold more than ROWS rows: then there are more of them.
HALO, ROWS = 2, 2048
#: Norms below 2 ** -LAST_BAND of the longest are one band.
LAST_BAND = 20
SEED = 7


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows, dims): the transpose form, untangled bit by bit."""
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def frames(width: int, orders: int = ORDERS, dims: int = DIMS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(directions, shift) of each ordering. Directions are orthonormal; orderings take different ones while there are any."""
    r = np.random.default_rng(seed)
    columns: list[np.ndarray] = []
    while len(columns) < orders * dims:
        columns += list(np.linalg.qr(r.standard_normal((width, width)))[0].T)
    return [(np.array(columns[i * dims : (i + 1) * dims]).T, r.uniform(-0.25, 0.25, dims)) for i in range(orders)]


def keys(vectors: np.ndarray, frame: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> np.ndarray:
    """Hilbert keys of vectors of length about 1."""
    directions, shift = frame
    z = vectors @ directions * np.sqrt(vectors.shape[1]) + shift
    return hilbert(np.clip((0.5 + 0.5 * np.tanh(0.8 * z)) * (1 << bits), 0, (1 << bits) - 1), bits)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v keeps an element type of float, and is of doubles otherwise."""
    v = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] != "array<float>":
        v = v.cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k nearest of rows that score least or more; equal rows score equal to the last bit."""
    for i in range(0, len(queries), 256):
        rough = queries[i : i + 256] @ rows.T
        for j, line in enumerate(rough):
            n = min(k, len(line))
            bound = max(np.partition(line, len(line) - n)[len(line) - n], least[i + j])
            at = np.flatnonzero(line >= bound - 1e-9 * max(1.0, abs(bound)))
            exact = (rows[at] * queries[i + j]).sum(axis=1)
            first = np.lexsort((ids[at], -exact))[:n]
            first = first[exact[first] >= least[i + j]]
            yield query_ids[i + j], ids[at[first]], exact[first]


def windows_of(rows: int, orders: int) -> tuple[int, int]:
    """(rows of a window, windows on each side of its own that a query visits) of a band of so many rows."""
    share = min(1.0, SHARE * (500 / max(rows, 1)) ** FALL / orders)
    size = min(ROWS, max(1, -(-int(share * rows) // (2 * HALO + 1))))
    return size, max(HALO, round((share * rows / size - 1) / 2))


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, orders: int = ORDERS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (rows for which is_query holds)."""
    spark = vectors.sparkSession
    own = usable(vectors).withColumn("width", F.size("v"))
    widths = own.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["width"]
    own = own.where(F.col("width") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    own = kept(own.withColumn("n2", norm2(F.col("v"))).withColumn("query", is_query))
    kind = dict(own.dtypes)["v"]
    longest = float(own.agg(F.max("n2")).first()[0]) ** 0.5
    planes = frames(width + 1, orders)

    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    band = F.least(F.floor(F.log2(longest / F.sqrt("n2")) + 1e-12), F.lit(LAST_BAND)).cast("int")
    told = own.withColumn("order", order).where(F.col("order") <= k + 1).select("vec_id", "v", "n2", F.greatest(band, F.lit(0)).alias("band"), F.lit(False).alias("asks"))
    told = kept(told)
    bands = {r["band"]: (r["n"], float(r["m"]) ** 0.5) for r in told.groupBy("band").agg(F.count("*").alias("n"), F.max("n2").alias("m")).collect()}
    rows_of = {b: n for b, (n, _) in bands.items()}
    lengths = np.array([bands[b][1] if b in bands else 1.0 for b in range(max(bands) + 1)])
    asked = kept(own.where("query").groupBy("v").agg(F.min("vec_id").alias("asker")))
    queries = asked.select(F.col("asker").alias("vec_id"), "v", norm2(F.col("v")).alias("n2"), F.explode(F.array(*map(F.lit, sorted(rows_of)))).alias("band"), F.lit(True).alias("asks"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n2, band = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            asks = b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            v = _matrix(b.column(1)) / np.where(asks, np.sqrt(n2), lengths[band])[:, None]
            v = np.column_stack((v, np.where(asks, 0, np.sqrt(np.clip(1 - (v * v).sum(axis=1), 0, None)))))
            for o, plane in enumerate(planes):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((band * orders + o).astype(np.int32)), pa.array(keys(v, plane)), b.column(4)], names=["vec_id", "v", "ordering", "key", "asks"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of each row among its partition's rows of its ordering; a query's is that of the next row."""
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            group, asks = b.column(2).to_numpy(), b.column(4).to_numpy(zero_copy_only=False).astype(bool)
            place = np.zeros(len(group), dtype=np.int64)
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                count = np.cumsum(~asks[at])
                place[at] = seen.get(int(g), 0) + count - ~asks[at]
                seen[int(g)] = seen.get(int(g), 0) + int(count[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(np.full(len(group), part, np.int32)), pa.array(place)], names=["vec_id", "v", "ordering", "asks", "part", "place"])

    placed = kept(told.unionAll(queries).mapInArrow(place, f"vec_id long, v {kind}, ordering int, key long, asks boolean"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(parts, "ordering", "key", "vec_id").sortWithinPartitions("ordering", "key", "vec_id")
    numbered = kept(ranged.mapInArrow(number, f"vec_id long, v {kind}, ordering int, asks boolean, part int, place long"))
    # How many rows of each ordering stand in earlier partitions: as many numbers as partitions and orderings.
    counts = numbered.where(~F.col("asks")).groupBy("ordering", "part").agg(F.count("*").alias("n"))
    own_rows = {(r["ordering"], r["part"]): r["n"] for r in counts.collect()}
    offsets: dict[tuple[int, int], int] = {}
    for g in (b * orders + o for b in rows_of for o in range(orders)):
        offsets |= zip(((g, p) for p in range(parts)), accumulate((own_rows.get((g, p), 0) for p in range(parts)), initial=0))
    cut = {b: windows_of(n, orders) for b, n in rows_of.items()}
    sent_as = f"vec_id long, v {kind}, ordering int, window long, asks boolean, least double"

    def send(home: bool):
        """Rows to their own window, and queries to their own one or to its neighbours."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                group, part, place = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
                asks = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
                window, halo, last = (np.zeros(len(group), dtype=np.int64) for _ in range(3))
                for g, p in set(zip(group.tolist(), part.tolist())):
                    at = (group == g) & (part == p)
                    size, halo[at] = cut[g // orders]
                    last[at] = (rows_of[g // orders] - 1) // size
                    window[at] = np.minimum((place[at] + offsets[g, p]) // size, last[at])
                for d in range(-halo.max(initial=0), halo.max(initial=0) + 1):
                    goes = (d == 0) & (~asks | home) | asks & (not home) & (d != 0) & (abs(d) <= halo)
                    at = np.flatnonzero(goes & (window + d >= 0) & (window + d <= last))
                    if len(at):
                        some = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(window[at] + d), some.column(3), some.column(6)], names=["vec_id", "v", "ordering", "window", "asks", "least"])

        return run

    def rerank(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy().astype(bool)
        ids = group.column("vec_id").to_numpy()
        found = []
        if asks.any() and not asks.all():
            v = _matrix(group.column("v").chunk(0))
            least = group.column("least").to_numpy()[asks]
            found = list(best(v[asks], ids[asks], np.where(np.isnan(least), -np.inf, least), v[~asks], ids[~asks], k + 1))
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        query = np.repeat(np.array([q for q, _, _ in found], np.int64), [len(i) for _, i, _ in found])
        return pa.table({"asker": query, "vec_id": flat([i for _, i, _ in found], np.int64), "score": flat([s for _, _, s in found], np.float64)})

    def searched(rows: DataFrame, home: bool) -> DataFrame:
        return rows.mapInArrow(send(home), sent_as).groupBy("ordering", "window").applyInArrow(rerank, "asker long, vec_id long, score double")

    found = kept(searched(numbered.withColumn("least", F.lit(None).cast("double")), True).distinct())
    order = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id"))
    least = found.withColumn("order", order).where(F.col("order") <= k + 1).groupBy("asker").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("least"))
    again = numbered.where("asks").join(least.withColumnRenamed("asker", "vec_id"), "vec_id", "left").select(*numbered.columns, "least")
    found = found.unionAll(searched(again.unionAll(numbered.where(~F.col("asks")).withColumn("least", F.lit(None).cast("double"))), False)).distinct()
    found = found.withColumn("order", order).where(F.col("order") <= k + 1).select("asker", "vec_id", "score")
    each = own.where("query").select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").select("query_id", "asker")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = each.join(found, "asker").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
